"""Decisions of reviewers, uploads and replies that must fit a schema, metadata passages, links of items to spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evidence import grounding_label

STATUSES = ("approved", "accepted", "rejected", "skipped")  # fixed values


def checked_decisions(decisions: DataFrame, log: DataFrame, key: str = "entry_id") -> DataFrame:
    """Rows of ``decisions`` with ``error``: an unknown status, a missing id, an id that the log doesn't hold; null if it stands.

    Texts are trimmed, blank ones null; the status is in lower case.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    x = decisions.withColumns({"status": F.lower(F.trim("status")), "reviewer": blank("reviewer"), "comment": blank("comment"), "corrected": blank("corrected")})
    x = x.join(log.select(key, F.lit(True).alias("known")).distinct(), key, "left")
    bad = F.when(F.col("status").isNull() | ~F.col("status").isin(*STATUSES), "status").when(F.col(key).isNull(), "missing id").when(F.col("known").isNull(), "unknown id")
    return x.withColumn("error", bad).drop("known")


def with_decisions(log: DataFrame, decisions: DataFrame, key: str = "entry_id", at: str = "at") -> DataFrame:
    """``log`` with the last decision on each entry that stands; a corrected answer takes the place of the answer."""
    ok = checked_decisions(decisions, log, key).where("error is null")
    last = ok.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), "status"))).where("rn = 1")
    return log.join(last.select(key, "status", "reviewer", "comment", "corrected"), key, "left").withColumn("answer", F.coalesce("corrected", "answer"))


def upload_errors(files: DataFrame) -> DataFrame:
    """Add ``error`` to (name, bytes): a missing or empty name, another kind than .pdf, no bytes; null if the file is taken."""
    name = F.trim("name")
    return files.withColumn("error", F.when(name.isNull() | (name == ""), "no file").when(~F.lower(name).endswith(".pdf"), "not a pdf").when(F.coalesce("bytes", F.lit(0)) == 0, "empty file"))


def parsed_replies(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Add ``answer``, ``confidence`` and ``valid`` from a JSON reply: an answer is required, the confidence lies in 0 to 1."""
    r = F.from_json(F.col(reply), "answer string, confidence double", {"mode": "PERMISSIVE"})
    x = rows.withColumn("answer", r["answer"]).withColumn("confidence", r["confidence"])
    return x.withColumn("valid", F.col("answer").isNotNull() & F.coalesce(F.col("confidence").between(0, 1), F.lit(False)))


def with_metadata(hits: DataFrame, docs: DataFrame, query: str, doc: str) -> DataFrame:
    """``hits`` (query, doc, score, text) and, of each query's documents, a passage with title and date, score 1, marked as synthetic for graders to leave out."""
    meta = hits.select(query, doc).distinct().join(docs.select(doc, "title", "date"), doc)
    extra = meta.select(query, doc, F.lit(1.0).alias("score"), F.concat(F.lit("Title: "), "title", F.lit("\nDate: "), F.coalesce("date", F.lit("unknown"))).alias("text"), F.lit(True).alias("synthetic"))
    return hits.select(query, doc, "score", "text").withColumn("synthetic", F.lit(False)).unionByName(extra)


def linked_items(items: DataFrame, spans: DataFrame, answer: str) -> DataFrame:
    """Rows (answer, no, span_id) of items (answer, no, quote): the first span of the same trimmed quote, else that at the item's place, else null."""
    by_quote = spans.groupBy(answer, F.trim("quote").alias("q")).agg(F.min_by("span_id", "place").alias("same"))
    by_place = spans.groupBy(answer, F.col("place").alias("no")).agg(F.min("span_id").alias("there"))
    x = items.withColumn("q", F.trim("quote")).join(by_quote, [answer, "q"], "left").join(by_place, [answer, "no"], "left")
    return x.select(answer, "no", F.coalesce("same", "there").alias("span_id"))


def evidence_spans(aligned: DataFrame, answer: str, least: int = 12) -> DataFrame:
    """Rows (answer, span_id, doc, start, end, score, label): places of quotes of ``least`` characters and more, each place once, numbered ev1, ev2 ... by their first quote."""
    x = aligned.where(F.length("quote") >= least).groupBy(answer, "doc", "start", "end").agg(F.min("no").alias("no"), F.max("score").alias("score"))
    w = Window.partitionBy(answer).orderBy("no", "doc", "start", "end")
    label = grounding_label(F.col("score"))
    return x.select(answer, F.concat(F.lit("ev"), F.row_number().over(w).cast("string")).alias("span_id"), "doc", "start", "end", "score", label.alias("label"))


def flat_suite(base: DataFrame, graders: list[DataFrame], key: str) -> DataFrame:
    """One row for each answer with all graders' columns; a grader that has nothing on an answer leaves nulls.

    Answers meet in one aggregate over all graders' rows. A grader with two rows on an answer ends the job; two of the same
    column are an error at once.
    """
    names = [c for g in graders for c in g.columns if c != key]
    if len({*names, *base.columns}) < len(names) + len(base.columns):
        raise ValueError(f"graders share columns: {sorted(c for c in {*names} if (names + base.columns).count(c) > 1)}")
    rows = None
    for i, g in enumerate(graders):
        x = g.select(key, F.lit(i).alias("_i"), F.struct(*[c for c in g.columns if c != key]).alias(f"_g{i}"))
        rows = x if rows is None else rows.unionByName(x, allowMissingColumns=True)
    if rows is None:
        return base
    one = [F.when(F.count_if(F.col("_i") == i) > 1, F.raise_error(F.lit(f"grader {i} has two rows on an answer"))).otherwise(F.first(f"_g{i}", True)).alias(f"_g{i}") for i in range(len(graders))]
    flat = rows.groupBy(key).agg(*one).select(key, *[F.col(f"_g{i}")[c].alias(c) for i, g in enumerate(graders) for c in g.columns if c != key])
    return base.join(flat, key, "left")
