"""Operator 11: what each of five filters removes, in every order in which they may stand."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import ship

LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 200, 50, 3  # words, and percent of words and of code points
_SYMBOL, _CAPITAL = words.table(b"#$%&*|"), words.table(bytes(range(65, 91)))
_REST = words.table(bytes(range(0x80, 0xC0)))  # bytes of a code point but its first


def distinct_words(x: np.ndarray, lanes: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many different words each row has.

    Hashes of (row, word) are sorted; where neighbours are equal, their rows and bytes are compared. A row in which
    they differ is counted from its words themselves.
    """
    key = words.mixed(words.hashes(x, lanes, starts, ends) ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    true = (row[a] == row[b]) & words.equal(x, lanes, (starts[a], ends[a]), (starts[b], ends[b]))
    n = np.bincount(row, minlength=rows) - np.bincount(row[b], minlength=rows)
    for i in np.unique(np.concatenate((row[a[~true]], row[b[~true]]))):
        own = np.flatnonzero(row == i)
        n[i] = len({x[s:e].tobytes() for s, e in zip(starts[own], ends[own], strict=True)})
    return n


def text_masks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the filters A to D that it fails, as bits 0 to 3."""
    rows = len(offsets) - 1
    starts, ends, row = words.spans(data, offsets, words.BLANK)
    x, lanes = words.padded(data)
    n, distinct = np.bincount(row, minlength=rows), distinct_words(x, lanes, starts, ends, row, rows)
    points = np.diff(offsets) - words.counts(_REST[data], offsets)
    a, b = n < LEAST_WORDS, 100 * distinct < DISTINCT_SHARE * n
    c, d = 100 * words.counts(_CAPITAL[data], offsets) > CAPITAL_SHARE * points, words.counts(_SYMBOL[data], offsets) > 0
    return a + 2 * b + 4 * c + 8 * d


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = words.buffers(b.column(2))
        same = [hashlib.blake2b(data[s:e], digest_size=16).digest() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.binary()), pa.array(text_masks(data, offsets), pa.int32())], names=["id", "part", "same", "mask"])


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows (part, mask, n, n_good, n_toxic): documents by part and by the set of filters that they fail, bit 4 for copies.

    Texts are known by a 128-bit digest. Of the rows of one text only those of the smallest id pass E. Its copies are
    added up before they meet, so a text that a third of all rows hold is no hot key.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    x = docs.select(F.col(id_col).alias("id"), part, F.col(text_col).cast("string").alias("text")).mapInArrow(_scan, f"id {kind}, part string, same binary, mask int")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    x = x.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    x = x.groupBy("same", "mask", "part", "good", "toxic", "id").agg(F.count(F.lit(1)).alias("n"))
    x = x.groupBy("same", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    x = x.groupBy("same", "mask").agg(F.min("first.id").alias("least"), F.collect_list(F.struct("part", "good", "toxic", "n", "no_id", "first")).alias("rows"))
    x = x.select("mask", "least", F.inline("rows"))
    passed = F.col("no_id") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    x = x.select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("mask"), passed.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passed).alias("n")))))
    return x.groupBy("part", "mask").agg(*[F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).alias(c) for c, which in (("n", F.lit(True)), ("n_good", F.col("good") == 1), ("n_toxic", F.col("toxic") == 1))]).where("n > 0")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    Documents are counted by the set of filters they fail, 32 sets a part at most; every order and step is a sum over those
    sets. A filter's Shapley share is in how many of the orders it stands first among the filters that a document fails.

    Null and empty text are the same; null and empty part too. A row without an id is never a copy of another nor has one.
    Repeated rows of one id count each, and none is a copy of the other. Labels may repeat: any of an id's rows marks it.
    Other columns aren't read. A table without rows gives none.
    """
    sets = failures(docs, labels, id_col, text_col, part_col).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("sets"))
    orders = F.array(*[F.struct(F.lit("".join(p)).alias("filter_order"), F.array(*[F.lit(1 << LETTERS.index(c)) for c in p]).alias("bits")) for p in permutations(LETTERS)])
    x = sets.select("part", "sets", F.inline(orders)).select("part", "sets", "filter_order", "bits", F.posexplode("bits").alias("i", "own"))
    x = x.withColumn("earlier", F.aggregate(F.slice("bits", 1, F.col("i")), F.lit(0), lambda acc, b: acc + b))
    fails, taken = lambda s: s["mask"].bitwiseAND(F.col("own")) > 0, lambda s: s["mask"].bitwiseAND(F.col("earlier")) > 0

    def total(value: Callable[[Column], Column], which: Callable[[Column], Column]) -> Column:
        return F.aggregate("sets", F.lit(0).cast("long"), lambda acc, s: acc + F.when(which(s), value(s)).otherwise(F.lit(0).cast("long")))

    removed = lambda s: fails(s) & ~taken(s)
    share = lambda s: s["n"] * F.element_at(F.array(*[F.lit(factorial(len(LETTERS)) // k) for k in range(1, len(LETTERS) + 1)]), F.bit_count(s["mask"]))
    return x.select(
        "part", "filter_order", (F.col("i") + 1).alias("step"),
        total(lambda s: s["n"], lambda s: ~fails(s) & ~taken(s)).alias("kept"),
        total(lambda s: s["n"], removed).alias("removed"),
        total(lambda s: s["n"], lambda s: fails(s) & taken(s)).alias("redundant"),
        total(lambda s: s["n"], lambda s: s["mask"] == F.col("own")).alias("unique_fails"),
        total(lambda s: s["n_good"], removed).alias("good_lost"),
        total(lambda s: s["n_toxic"], removed).alias("toxic_lost"),
        total(share, fails).alias("shapley"),
    )
