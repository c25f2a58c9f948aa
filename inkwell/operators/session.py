"""Conversation windows, transcript numbering, review queues, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history_window(turns: DataFrame, last: int = 6) -> DataFrame:
    """The last turns of each conversation, pos 1 being the newest."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"))
    return turns.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= last).select("conv_id", "turn", "role", "pos")


def transcript_turns(turns: DataFrame) -> DataFrame:
    """Turn numbers as the transcript gives them: a user row counts what stands before it, an assistant row does not count its question."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    x = turns.where("role in ('user', 'assistant')").withColumn("p", F.row_number().over(w) - 1)
    return x.select("conv_id", F.col("p").cast("long").alias("pos"), "role", (F.expr("p div 2") + F.when(F.col("role") == "user", 1).otherwise(0)).cast("long").alias("turn_no"))


def registry(docs: DataFrame) -> DataFrame:
    """Rows (reg_id, label, n_pages) per source, numbered by name."""
    g = docs.groupBy(F.col("source").alias("label")).agg(F.count(F.lit(1)).alias("n_pages"))
    return g.select(F.concat(F.lit("d"), F.row_number().over(Window.orderBy("label")).cast("string")).alias("reg_id"), "label", "n_pages")


BUCKET = 10_000  # places that are numbered together


def ordered_distinct(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Rows (pos, key): non-blank values trimmed, each at its first place, numbered anew from 1. Places are whole numbers.

    Values are numbered in buckets of BUCKET places; only the buckets' sizes are summed up in one task.
    """
    x = rows.select(F.trim(key).alias(key), pos).where(F.col(key) != "").groupBy(key).agg(F.min(pos).alias("at")).withColumn("bucket", F.expr(f"at div {BUCKET}"))
    sizes = x.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("at", key))
    return x.withColumn("rn", inside).join(sizes, "bucket").select((F.col("before") + F.col("rn")).cast("long").alias("pos"), key)


def checked_batch(rows: DataFrame, key: str, pos: str, most: int = 50) -> DataFrame:
    """A web request's questions: distinct ones in order; none at all, or more than ``most``, is an error: none is left out silently."""
    out = ordered_distinct(rows, key, pos)
    n = out.limit(most + 1).count()
    if not 0 < n <= most:
        raise ValueError(f"the batch holds no question or more than {most}" if n else "the batch holds no question")
    return out
