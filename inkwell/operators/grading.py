"""Graders: consensus of judges, retrieval health, coverage, error tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judge_consensus(scores: DataFrame, key: str) -> DataFrame:
    """Rows (key, mean, median, lower, upper, std) from (key, score); std is the population's. Null scores don't count."""
    s = F.col("score")
    return scores.where(s.isNotNull()).groupBy(key).agg(F.round(F.avg(s), 4).alias("mean"), F.round(F.median(s), 4).alias("median"), F.min(s).alias("lower"), F.max(s).alias("upper"), F.round(F.stddev_pop(s), 4).alias("std"))


def retrieval_quality(hits: DataFrame, key: str, weak: float = 0.40, weak_scaled: float = 0.5) -> DataFrame:
    """Spread of each query's scores, the share of them below ``weak``, and the share below ``weak_scaled`` once they are scaled to their range.

    Where all scores are equal none is weak by the scaled form.
    """
    w = Window.partitionBy(key)
    x = hits.withColumn("hi", F.max("score").over(w)).withColumn("lo", F.min("score").over(w))
    scaled = (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    x = x.withColumn("low", F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise((scaled < weak_scaled).cast("double")))
    share = lambda c: F.round(F.avg(c), 4)
    return x.groupBy(key).agg(
        F.round(F.max("score"), 4).alias("s_max"),
        F.round(F.min("score"), 4).alias("s_min"),
        share("score").alias("s_mean"),
        F.round(F.max("score") - F.min("score"), 4).alias("spread"),
        share((F.col("score") < weak).cast("double")).alias("weak_raw"),
        share("low").alias("weak_rescaled"),
    )


def error_tags(signals: DataFrame) -> DataFrame:
    """Add ``tags`` to rows (has_context, grounding, weak, unsupported, contradicted, judge, uncovered, admits)."""
    c = F.col
    failure = ~c("has_context") | (c("grounding") <= 0.34)
    partial = (c("grounding") < 0.80) | (c("weak") >= 0.50) | (c("unsupported") > 0)
    family: Column = F.when(failure, "retrieval_failure").when(partial, "partial_retrieval").when(c("admits"), "missing_context")
    flagged = failure | partial | c("admits")
    tags = F.array(
        family,
        F.when(c("contradicted") > 0, "contradiction"),
        F.when(~flagged & (c("contradicted") == 0) & (c("unsupported") > 0) & (c("judge") < 0.5), "hallucination"),
        F.when(~flagged & (c("grounding") >= 0.60) & (c("judge") < 0.70), "misinterpretation"),
        F.when(c("uncovered") > 0, "coverage_gap"),
    )
    return signals.withColumn("tags", F.array_join(F.array_compact(tags), ", "))


def error_reasons(tagged: DataFrame) -> DataFrame:
    """Add ``reasons`` to rows of ``error_tags``: one for each tag, in the tags' order, with the figure that it rests on."""
    c = F.col
    pct = lambda x: F.format_number(c(x) * 100, 0)
    said = {
        "retrieval_failure": F.when(~c("has_context"), "no context").otherwise(F.concat(F.lit("grounding "), pct("grounding"), F.lit("%"))),
        "partial_retrieval": F.concat(F.lit("grounding "), pct("grounding"), F.lit("%, weak "), pct("weak"), F.lit("%")),
        "missing_context": F.lit("the answer says that the context lacks it"),
        "contradiction": F.concat(c("contradicted").cast("string"), F.lit(" contradicted claims")),
        "hallucination": F.concat(c("unsupported").cast("string"), F.lit(" unsupported claims")),
        "misinterpretation": F.concat(F.lit("judges "), pct("judge"), F.lit("%")),
        "coverage_gap": F.concat(c("uncovered").cast("string"), F.lit(" requirements uncovered")),
    }
    tags = F.split("tags", ", ")
    return tagged.withColumn("reasons", F.array_join(F.array_compact(F.array(*[F.when(F.array_contains(tags, t), r) for t, r in said.items()])), "; "))
