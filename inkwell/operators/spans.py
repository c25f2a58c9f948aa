"""Geometry of evidence spans: best documents, sentence snapping, highlights without overlap, places in a view, alignment rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences

BONUS = 1.5


def best_document(alignments: DataFrame, preferred: DataFrame, quote: str, doc: str, score: str) -> DataFrame:
    """Rows (quote, doc, adj_score): the document where each quote aligns best, with a bonus for (quote, doc) in ``preferred``; of equals the first."""
    x = alignments.join(preferred.select(quote, doc).distinct().withColumn("_p", F.lit(BONUS)), [quote, doc], "left")
    x = x.withColumn("adj_score", F.col(score) + F.coalesce("_p", F.lit(0.0)))
    best = x.groupBy(quote).agg(F.max_by(F.struct(doc, "adj_score"), F.struct("adj_score", -F.col(doc))).alias("b"))
    return best.select(quote, F.col(f"b.{doc}").alias(doc), "b.adj_score")


def sentence_spans(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """Rows (doc, s, e): each sentence's place in the document's normal form, 0-based and half-open."""
    x = docs.select(doc, F.posexplode(sentences(F.col(text))).alias("i", "t"))
    before = Window.partitionBy(doc).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("s", F.coalesce(F.sum(F.length("t") + 1).over(before), F.lit(0)).cast("long"))
    return x.select(doc, "s", (F.col("s") + F.length("t")).alias("e"))


def sentence_index(spans: DataFrame, doc: str) -> DataFrame:
    """Rows (doc, start, end): the places of a document's sentences, each once. In the order of start and end one can only lie in the one before it, start for start, if they are equal."""
    return spans.select(doc, "start", "end").distinct()


def line_edges(offsets: DataFrame, lines: DataFrame, doc: str, key: str) -> DataFrame:
    """Rows (doc, key, x): the left edge of the line that each offset ``at`` is on, from lines (doc, start, x); -1 before the first one. One ordered pass a document."""
    none = F.lit(None)
    a = offsets.select(doc, F.col("at").alias("_p"), F.lit(1).alias("_k"), F.col(key), none.cast("double").alias("_x"))
    b = lines.select(doc, F.col("start").alias("_p"), F.lit(0).alias("_k"), none.cast(offsets.schema[key].dataType).alias(key), F.coalesce("x", F.lit(-1.0)).alias("_x"))
    w = Window.partitionBy(doc).orderBy("_p", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("x", F.coalesce(F.last("_x", True).over(w), F.lit(-1.0))).where("_k = 1").select(doc, key, "x")


def snap_to_sentences(spans: DataFrame, docs: DataFrame, doc: str, key: str, text: str = "text") -> DataFrame:
    """Rows (doc, key, start, end): spans grown to the sentences that they overlap; only documents with spans are split."""
    found = sentence_spans(docs.join(spans.select(doc).distinct(), doc, "left_semi"), doc, text)
    x = spans.select(doc, key, "start", "end").join(found, doc, "left").withColumn("_o", (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")))
    lo, hi = F.min(F.when(F.col("_o"), F.col("s"))), F.max(F.when(F.col("_o"), F.col("e")))
    g = x.groupBy(doc, key, "start", "end").agg(lo.alias("lo"), hi.alias("hi"))
    return g.select(doc, key, F.least("start", "lo").alias("start"), F.greatest("end", "hi").alias("end"))


def highlights(spans: DataFrame, doc: str, key: str) -> DataFrame:
    """Rows (doc, key, start, end) of the spans that are shown: by start, each that begins before the last shown one ends is left out.

    A document's spans are cut into islands where one begins at or after the end of all before it; only an island's
    spans, which overlap in a chain, are folded as one array.
    """
    by = Window.partitionBy(doc).orderBy("x")
    reach = F.max("x.end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.select(doc, F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col(key).cast("long").alias("k")).alias("x"))
    begin = F.struct(F.lit(-1).cast("long").alias("last"), F.array().cast("array<struct<start:bigint,end:bigint,k:bigint>>").alias("out"))
    step = lambda acc, x: F.when(x["start"] < acc["last"], acc).otherwise(F.struct(x["end"].alias("last"), F.array_append(acc["out"], x).alias("out")))
    s = s.withColumn("_cut", F.when(F.col("x.start") < reach, 0).otherwise(1))
    s = s.withColumn("_island", F.sum("_cut").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    g = s.groupBy(doc, "_island").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    out = g.select(doc, F.explode(F.aggregate("xs", begin, step, lambda acc: acc["out"])).alias("x"))
    return out.select(doc, F.col("x.k").alias(key), "x.start", "x.end")


def view_segments(merged: DataFrame, doc: str, gap: int = 2) -> DataFrame:
    """Add ``view_start``: where each merged interval begins in a view that shows them in order, ``gap`` characters apart."""
    before = Window.partitionBy(doc).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return merged.withColumn("view_start", F.coalesce(F.sum(F.col("end") - F.col("start") + gap).over(before), F.lit(0)).cast("long"))


def to_view(spans: DataFrame, segments: DataFrame, doc: str, key: str) -> DataFrame:
    """Rows (doc, key, view_from, view_to): document spans as places in the view of ``segments``; cut at their segment's end, one character at least."""
    g = segments.select(doc, F.col("start").alias("_s"), F.col("end").alias("_e"), "view_start")
    x = spans.join(g, doc).where((F.col("_s") <= F.col("start")) & (F.col("start") < F.col("_e")))
    at = F.col("view_start") + F.col("start") - F.col("_s")
    return x.select(doc, key, at.cast("long").alias("view_from"), (at + F.greatest(F.lit(1), F.least("end", "_e") - F.col("start"))).cast("long").alias("view_to"))


def place_of(offsets: DataFrame, starts: DataFrame, doc: str, key: str) -> DataFrame:
    """Rows (doc, key, place): the last ``start`` at or before each ``at``; null before the first. One ordered pass instead of a range join."""
    a = offsets.select(doc, F.col("at").alias("p"), F.lit(1).alias("kind"), F.col(key).alias(key), F.lit(None).cast("long").alias("st"))
    b = starts.select(doc, F.col("start").alias("p"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias(key), F.col("start").cast("long").alias("st"))
    w = Window.partitionBy(doc).orderBy("p", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("place", F.last("st", True).over(w)).where("kind = 1").select(doc, key, "place")


def alignment_rates(quotes: DataFrame, chunks: DataFrame, alignments: DataFrame, question: str, quote: str, chunk: str, score: str, least: float = 80.0) -> DataFrame:
    """Rows (question, rate, utilisation): the share of quotes that align with some chunk of the context, and of chunks with some quote."""
    hits = alignments.where(F.col(score) >= least).join(quotes, quote).join(chunks, [question, chunk])
    found = hits.groupBy(question).agg(F.countDistinct(quote).alias("q"), F.countDistinct(chunk).alias("c"))
    n = quotes.groupBy(question).agg(F.countDistinct(quote).alias("nq")).join(chunks.groupBy(question).agg(F.countDistinct(chunk).alias("nc")), question, "left")
    share = lambda a, b: F.round(F.coalesce(F.col(a), F.lit(0)) / F.col(b), 4)
    return n.join(found, question, "left").select(question, share("q", "nq").alias("rate"), share("c", "nc").alias("utilisation"))


def document_spans(views: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Rows (key, start, end) in the document of spans (key, start, end) in a view of it, cut at the segments' ends.

    ``segments`` has (key, doc_start, doc_end, view_start): stretches of the document that the view shows.
    """
    s = segments.withColumn("view_end", F.col("view_start") + F.col("doc_end") - F.col("doc_start"))
    x = views.withColumnsRenamed({"start": "v0", "end": "v1"}).join(s, key).where("v0 < view_end and view_start < v1")
    shift = F.col("doc_start") - F.col("view_start")
    return x.select(key, (F.greatest("v0", "view_start") + shift).alias("start"), (F.least("v1", "view_end") + shift).alias("end"))
