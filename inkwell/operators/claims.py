"""Graders over text alone: recovered judge scores, claims, numbers, the shape of an answer; dates and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize

# Phrases of claims about the context or the answer itself, and the months.
META = [
    "context does not contain", "does not contain enough information", "not enough information", "insufficient information",
    "context does not provide", "context does not specify", "context does not state", "context does not mention",
    "does not state that", "cannot be determined from", "cannot be answered from", "is not addressed in the",
    "provided context does not", "retrieved passages do not", "no information is provided", "the context is silent",
]
MONTHS = "january february march april may june july august september october november december".split()
SCORE = r"(?i:confidence|score)\D{0,8}(\d*\.?\d+)"
LONG_ANSWER, LONG_PARAGRAPH, LIST_ITEMS = 8, 6, 4


def _share(x: Column) -> Column:
    v = x.try_cast("double")
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v > 1, v / 100).otherwise(v))))


def judge_score(reply: Column) -> Column:
    """The score in a judge's reply, within 0 and 1: from JSON, from the first {...} in prose, or a number after confidence or score; else null."""
    of = lambda j: _share(F.coalesce(F.get_json_object(j, "$.confidence"), F.get_json_object(j, "$.score")))
    block = F.regexp_extract(reply, r"(?s)\{.*?\}", 0)
    return F.coalesce(of(F.when(reply.rlike(r"(?s)^\s*\{.*\}\s*$"), reply)), of(F.nullif(block, F.lit(""))), _share(F.nullif(F.regexp_extract(reply, SCORE, 1), F.lit(""))))


def is_meta(claim: Column) -> Column:
    return F.coalesce(F.lower(normalize(claim)).rlike("|".join(META)), F.lit(False))


def claim_rollup(claims: DataFrame, key: str, claim: str = "claim", verdict: str = "verdict", meta_counts: bool = False) -> DataFrame:
    """Counts of claims by verdict; the ratio is of the supported over all that are not about the context itself, null if there are none.

    With ``meta_counts`` it is over all claims: protocols leave none out. Claims whose check failed count in either.
    """
    kind = F.when(is_meta(F.col(claim)), "meta").otherwise(F.col(verdict))
    names = ["supported", "unsupported", "contradicted", "error", "meta"]
    x = claims.select(key, kind.alias("_k")).groupBy(key).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("_k") == n).alias(n) for n in names])
    rest = F.col("total") - (0 if meta_counts else F.col("meta"))
    return x.withColumn("ratio", F.when(rest > 0, F.round(F.col("supported") / rest, 4)))


def numbers(text: Column) -> Column:
    """Distinct numbers between ASCII word boundaries."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, "[^A-Za-z0-9_.]", " "), F.lit(r"\b(\d+(?:\.\d+)?)\b"), F.lit(1)))


def numeric_consistency(pairs: DataFrame, answer: str = "answer", context: str = "context") -> DataFrame:
    """Add total, grounded, consistency and ungrounded: the answer's distinct numbers and those that the context has."""
    a, c = F.col("_a"), F.col("_c")
    x = pairs.withColumn("_a", numbers(F.col(answer))).withColumn("_c", numbers(F.coalesce(F.col(context), F.lit(""))))
    total, grounded = F.size(a).cast("long"), F.size(F.array_intersect(a, c)).cast("long")
    missing = F.transform(F.array_sort(F.transform(F.array_except(a, c), lambda n: F.struct(F.length(n).alias("l"), n.alias("n")))), lambda s: s["n"])
    return x.withColumn("total", total).withColumn("grounded", grounded).withColumn("consistency", F.when(total > 0, F.round(grounded / total, 4))).withColumn("ungrounded", F.array_join(missing, ",")).drop("_a", "_c")


# Fixed patterns: list marks and headings at the beginning of a line, bold headings, sentence ends.
BULLET, HEAD, BOLD = r"(?m)^\s*([-•*]|\d+[.)]|[a-z][.)])\s+", r"(?m)^\s*[A-Z][^\n]{0,60}:\s*$", r"\*\*[^*]+\*\*"
SENTENCE_END = r"[.;:]\s+[A-Z0-9(]"


def answer_sentences(text: Column) -> Column:
    """An answer's sentences: cut after a stop, semicolon or colon before a capital, a digit or a bracket; blank ones go."""
    parts = F.split(F.trim(text), r"(?<=[.;:])\s+(?=[A-Z0-9(])")
    return F.filter(parts, lambda s: s.rlike(r"\S"))


def _sentence_count(text: Column) -> Column:
    return F.regexp_count(F.trim(text), F.lit(SENTENCE_END)) + 1


def structure_score(answers: DataFrame, text: str = "text", wants_set: str = "wants_set", items: str = "n_items") -> DataFrame:
    """Add n_sentences, n_paragraphs, score and flags; a blank answer has no score. Walls of text and ungrouped sets lose most."""
    t = F.col(text)
    paragraphs = F.filter(F.split(t, r"\n\s*\n"), lambda p: p.rlike(r"\S"))
    bullets, heads = t.rlike(BULLET), t.rlike(HEAD) | t.rlike(BOLD)
    x = answers.withColumn("n_sentences", _sentence_count(t).cast("long")).withColumn("n_paragraphs", F.size(paragraphs).cast("long")).withColumn("_longest", F.array_max(F.transform(paragraphs, _sentence_count))).withColumn("_b", bullets).withColumn("_h", heads)
    c = F.col
    tests = {
        "wall_of_text": (0.45, (c("n_sentences") >= LONG_ANSWER) & (c("n_paragraphs") <= 1) & ~c("_b")),
        "overlong_paragraph": (0.2, (c("_longest") > LONG_PARAGRAPH) & ~c("_b")),
        "set_question_not_grouped": (0.25, c(wants_set) & (c(items) >= LIST_ITEMS) & ~(c("_b") | c("_h") | (c("n_paragraphs") >= 3))),
        "no_visual_structure": (0.1, (c(wants_set) | (c(items) >= LONG_ANSWER)) & ~(c("_b") | c("_h"))),
    }
    off = sum((F.when(test, cost).otherwise(0.0) for cost, test in tests.values()), F.lit(0.0))
    there = t.rlike(r"\S")
    x = x.withColumn("score", F.when(there, F.round(F.greatest(F.lit(0.0), 1 - off), 3)))
    return x.withColumn("flags", F.array_join(F.array_compact(F.array(*[F.when(there & test, name) for name, (_, test) in tests.items()])), ",")).drop("_longest", "_b", "_h")


def internal_date(raw: Column) -> Column:
    """The date of D:YYYYMMDD...; null if there is none or it is no date."""
    return F.try_to_date(F.nullif(F.regexp_extract(raw, r"^D:(\d{8})", 1), F.lit("")), "yyyyMMdd")


def month_year(text: Column) -> Column:
    """The first of the month that the text's first full month name with a year gives."""
    pattern = f"(?i)(?:^|[^A-Za-z0-9_])({'|'.join(MONTHS)})\\s+(\\d{{4}})(?:[^A-Za-z0-9_]|$)"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, pattern, 1)))
    return F.when(month > 0, F.make_date(F.regexp_extract(text, pattern, 2).try_cast("int"), month.cast("int"), F.lit(1)))


def version(docs: DataFrame, created: str, modified: str, text: str, mtime: str) -> DataFrame:
    """Add version_date and version_source: of the creation date, else modification date, else the text, else the file's time."""
    found = {"metadata_creation": internal_date(F.col(created)), "metadata_modification": internal_date(F.col(modified)), "text": month_year(F.col(text)), "file_time": F.col(mtime).cast("date")}
    return docs.withColumn("version_date", F.coalesce(*found.values())).withColumn("version_source", F.coalesce(*[F.when(d.isNotNull(), n) for n, d in found.items()]))
