"""Headline grades, review flags and priorities, coverage of requirements, queues of what waits for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import key_tokens

# The weight of each signal in the overall grade.
WEIGHTS = {"judge": 2.0, "claims": 2.0, "items": 1.5, "semantic": 1.0, "coverage": 1.0, "structure": 0.8, "sections": 0.7}


def overall_grade(weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the signals that are there; null if none is."""
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return F.when(weight > 0, F.round(total / weight, 4))


def review_flags() -> Column:
    """Array of what calls for a look, in fixed order, from (semantic, contradicted, claims, coverage, partial_sections, structure_flags, sufficient)."""
    c = F.col
    flags = F.array(
        F.when(c("semantic") < 0.45, "low_semantic_match"),
        F.when(c("contradicted") > 0, "contradicted_claims"),
        F.when(c("claims") < 0.7, "weak_claim_grounding"),
        F.when(c("coverage") < 0.6, "items_missing_from_answer"),
        F.when(c("partial_sections") > 0, "incomplete_list_section"),
        F.when(c("structure_flags") > 0, "weak_structure"),
        F.when(~c("sufficient"), "context_insufficient"),
    )
    return F.array_compact(flags)


def review_grades(signals: DataFrame) -> DataFrame:
    """Add overall, flags and priority: the grade less a tenth for each flag, 0 at least; the lower, the sooner it is looked at."""
    x = signals.withColumn("overall", overall_grade()).withColumn("_f", review_flags())
    priority = F.when(F.col("overall").isNotNull(), F.round(F.greatest(F.lit(0.0), F.col("overall") - 0.1 * F.size("_f")), 4))
    return x.withColumn("flags", F.array_join("_f", ",")).withColumn("priority", priority).drop("_f")


def review_priority(mean_score: Column, judge: Column, spread: Column) -> Column:
    """Half the mean retrieval score and half the judges' mean, less their spread, within 0 and 1; 0 without context."""
    base = F.when(judge.isNull(), mean_score).otherwise(0.5 * mean_score + 0.5 * judge) - F.coalesce(spread, F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)), F.lit(0.0))


def guidance_priority(mean_score: Column, judge: Column, spread: Column) -> tuple[Column, Column]:
    """``review_priority``, and whether an answer calls for review whatever it is: where it has no context at all."""
    return review_priority(mean_score, judge, spread), mean_score.isNull()


def requirement_coverage(pairs: DataFrame, key: str, requirement: str, answer: str) -> DataFrame:
    """Rows (key, covered, uncovered) over (key, requirement, answer): covered from two shared key tokens on, one where the requirement has two or fewer."""
    r, a = key_tokens(F.col(requirement)), key_tokens(F.col(answer))
    hit = F.size(F.array_intersect(r, a)) >= F.when(F.size(r) <= 2, 1).otherwise(2)
    return pairs.select(key, hit.alias("hit")).groupBy(key).agg(F.count_if("hit").alias("covered"), F.count_if(~F.col("hit")).alias("uncovered"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key: the latest decision counts."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pending_queue(rows: DataFrame, key: str, status: str, priority: str, k: int) -> DataFrame:
    """The k pending rows to look at first, with their place ``pos``: lowest priority first, then by key."""
    top = rows.where(F.col(status) == "pending").orderBy(priority, key).limit(k)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(priority, key)).cast("long"))


def status_rollup(rows: DataFrame, key: str, ok: Column) -> DataFrame:
    """Rows (key, total, ok_count, error_count)."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok_count"), F.count_if(~ok).alias("error_count"))
