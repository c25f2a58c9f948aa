"""Registered documents: labels that tell versions apart, and what a cache must build, keep or drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_labels(docs: DataFrame, path: str = "path", base: str = "base_name", version: str = "version_label") -> DataFrame:
    """Add ``label``: the base name; with its version where names clash; and a hash of the path for all but the first where that clashes too."""
    same = F.count(F.lit(1)).over(Window.partitionBy(base))
    nth = F.row_number().over(Window.partitionBy(base, version).orderBy(path))
    versioned = F.concat(F.col(base), F.lit(" ["), F.col(version), F.lit("]"))
    short = F.concat(F.lit(" ("), F.substring(F.sha2(F.col(path), 256), 1, 6), F.lit(")"))
    return docs.withColumn("_n", same).withColumn("_i", nth).withColumn("label", F.when(F.col("_n") == 1, F.col(base)).when(F.col("_i") == 1, versioned).otherwise(F.concat(versioned, short))).drop("_n", "_i")


def cache_status(current: DataFrame, manifest: DataFrame, key: str = "path", mark: str = "fingerprint") -> DataFrame:
    """Rows (key, status): hit where the manifest has the same fingerprint, miss where it has another or none, stale where only the manifest has the key."""
    c, m = current.select(key, F.col(mark).alias("_now")), manifest.select(key, F.col(mark).alias("_was"))
    status = F.when(F.col("_now").isNull(), "stale").when(F.col("_now") == F.col("_was"), "hit").otherwise("miss")
    return c.join(m, key, "full").select(key, status.alias("status"))


def listing(registry: DataFrame, chunks: DataFrame, doc: str, page: str, section: str, text: str) -> DataFrame:
    """The documents of ``registry`` with pages (the last page's number, from 0 on, and one), chunks, sections and characters; zeros where a document has no chunks."""
    g = chunks.groupBy(doc).agg((F.max(page) + 1).alias("pages"), F.count(F.lit(1)).alias("chunks"), F.countDistinct(section).alias("sections"), F.sum(F.length(text)).alias("chars"))
    return registry.join(g, doc, "left").fillna(0, ["pages", "chunks", "sections", "chars"])


def labels_of(rows: DataFrame, registry: DataFrame, reg_id: str, label: str, order: str) -> DataFrame:
    """Add ``label`` to rows with a document's id: that of the first entry of that id, null where there is none."""
    first = registry.groupBy(reg_id).agg(F.min_by(label, order).alias(label))
    return rows.join(first, reg_id, "left")
