"""Sliding sentence chunks and full-text rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences

SIZE, STEP, LEAST_TOKENS = 6, 3, 15


def page_chunks(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """Rows (doc, page, window, n_sent, token_count, chunk): sentence windows of each page by itself, as ``sentence_chunks`` cuts them; no window crosses pages."""
    s = pages.select(doc, page, sentences(F.col(text)).alias("s")).where("s is not null")
    w = s.select(doc, page, F.explode(F.sequence(F.lit(0), F.size("s") - 1, F.lit(STEP))).alias("i"), "s")
    w = w.select(doc, page, F.expr(f"i div {STEP}").alias("window"), F.slice("s", F.col("i") + 1, F.lit(SIZE)).alias("part")).withColumn("chunk", F.array_join("part", " "))
    w = w.withColumn("token_count", F.length("chunk") / 4).where(F.col("token_count") > LEAST_TOKENS)
    return w.select(doc, page, "window", F.size("part").cast("long").alias("n_sent"), "token_count", "chunk")


def sentence_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (chunk_id, id, n_sent, token_count, chunk): windows of SIZE sentences, STEP apart, of more than LEAST_TOKENS tokens at four characters each."""
    s = docs.select(id_col, sentences(F.col(text_col)).alias("s")).where("s is not null")
    w = s.select(id_col, F.explode(F.sequence(F.lit(0), F.size("s") - 1, F.lit(STEP))).alias("i"), "s")
    w = w.select(id_col, "i", F.slice("s", F.col("i") + 1, F.lit(SIZE)).alias("part")).withColumn("chunk", F.array_join("part", " "))
    w = w.withColumn("token_count", F.length("chunk") / 4).where(F.col("token_count") > LEAST_TOKENS)
    return w.select((F.shiftleft(F.col(id_col), 24) + F.expr(f"i div {STEP}")).alias("chunk_id"), id_col, F.size("part").cast("long").alias("n_sent"), "token_count", "chunk")
