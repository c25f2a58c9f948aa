"""A training corpus from ``documents``: toxic ones go, one of each group of near copies stays, benchmark leaks go, personal data is masked, sources are mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import decontaminate, jaccard, mixing, pii, toxicity
from inkwell.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't find toxic; it learns from the labels of those that came in."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group that similar shingle sets link."""
    return jaccard.without_copies(docs, jaccard.jaccard_join(docs))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no benchmark item; null and empty texts hold none."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts masked."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words: their columns, and size, source_size, target and taken."""
    own = ("doc_id", "size", "source_size", "target", "taken")
    return mixing.mix(docs, keep=tuple(c for c in docs.columns if c not in own)).where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("personal_data", mask_personal_data),
    ("mix", mix_sources),
]

#: A trained classifier decides in the first stage, which SQL can't express; tests hold each stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's result is written and read again by the next."""
    docs, at = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = at.put(docs, name)
    return docs
