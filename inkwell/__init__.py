"""Inkwell: Spark-native analytics for document question answering."""
