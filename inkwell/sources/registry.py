"""Chunks registered by document in a folder: vectors and word counts of which a search reads the asked documents' part alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.lexical import best_rows, term_rows
from ..operators.retrieval import inner_product, top_k
from .shared import read_or_empty

SLOTS = 64  # parts of the folder; a document lies in one, by its hash
DENSE, LEXICAL = 10, 40  # chunks of a search by vectors, and by words
LISTING = "doc string, slot int, version long, chunks long"


def _slot(doc: str) -> Column:
    return F.pmod(F.xxhash64(F.col(doc).cast("string")), F.lit(SLOTS)).cast("int")


def registered(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc, slot, version, chunks) of the documents in the registry, each in its last version."""
    x = read_or_empty(spark, f"{folder}/listing", LISTING)
    return x.groupBy("doc").agg(F.max(F.struct("version", "slot", "chunks")).alias("x")).select("doc", "x.slot", "x.version", "x.chunks")


def register(chunks: DataFrame, folder: str, doc: str, item: str, text: str | None = None, embedding: str | None = None) -> None:
    """Append documents, whole, as the chunks (doc, item, text, embedding) of a new version; one that is there already is replaced by it.

    Data are written first and the listing last, so that a reader never sees a document before its chunks, and an append
    that failed is as if it had not been. One writer at a time is assumed. Nothing is rewritten: documents registered
    before stay where they are. Null documents aren't registered. Files hold their documents in order. Vectors of a document meet
    in a task; words are written by the tasks that count them, a row for each chunk.
    """
    spark = chunks.sparkSession
    last = read_or_empty(spark, f"{folder}/listing", LISTING).agg(F.max("version")).first()[0]
    version = F.lit(0 if last is None else last + 1).cast("long")
    x = chunks.where(F.col(doc).isNotNull()).select(F.col(doc).cast("string").alias("doc"), F.col(item).alias("item"), _slot(doc).alias("slot"), version.alias("version"), *[F.col(c).alias(name) for c, name in ((text, "text"), (embedding, "embedding")) if c])
    keep = lambda df, name: df.sortWithinPartitions("slot", "doc").write.mode("append").partitionBy("slot").parquet(f"{folder}/{name}")
    if embedding:
        keep(x.select("doc", "version", "slot", "item", "embedding").repartition("slot", "doc"), "vectors")
    if text:
        keep(term_rows(x, ["doc", "item"]).withColumn("slot", _slot("doc")).withColumn("version", version), "counts")
    x.groupBy("doc", "slot", "version").agg(F.count(F.lit(1)).alias("chunks")).write.mode("append").parquet(f"{folder}/listing")


def _read(spark: SparkSession, folder: str, name: str, picked: DataFrame) -> DataFrame:
    """Rows of the picked documents in their last version. Their slots, SLOTS at most, prune the folder before it is read."""
    of = registered(spark, folder).join(picked.select(F.col("doc").cast("string").alias("doc")).distinct(), "doc", "left_semi")
    slots = [r[0] for r in of.select("slot").distinct().collect()]
    return spark.read.parquet(f"{folder}/{name}").where(F.col("slot").isin(slots)).join(of.select("doc", "version"), ["doc", "version"], "left_semi").drop("slot", "version")


def dense_search(queries: DataFrame, folder: str, q_id: str, doc: str, vector: str, k: int = DENSE) -> DataFrame:
    """Rows (q_id, doc, item, score, rnk): the k chunks of each query's own document whose vectors' product with its vector is highest.

    Queries meet their document's vectors by an equi-join; no other document is scored. An unknown document gives no rows.
    """
    q = queries.select(q_id, F.col(doc).cast("string").alias("doc"), F.col(vector).alias("_q"))
    hits = q.join(_read(queries.sparkSession, folder, "vectors", q), "doc").select(q_id, "doc", "item", F.round(inner_product(F.col("_q"), F.col("embedding")), 6).alias("score"))
    return top_k(hits, q_id, "item", "score", k)


def lexical_search(questions: DataFrame, folder: str, q_id: str, doc: str, text: str = "text", k: int = LEXICAL) -> DataFrame:
    """Rows (q_id, doc, item, score, rnk): the k chunks of each question's own document with the highest BM25 scores, over 0.

    Counts of chunks and of words in chunks are each document's own, as each has its own retriever. A word in more than half of the
    chunks weighs a quarter of the document's mean weight.
    """
    q = questions.where(F.col(doc).isNotNull()).select(q_id, F.col(doc).cast("string").alias("doc"), F.explode(tokens(F.col(text))).alias("t")).distinct()
    rows = _read(questions.sparkSession, folder, "counts", q)
    return best_rows(q, rows, q_id, "item", k, within="doc")
