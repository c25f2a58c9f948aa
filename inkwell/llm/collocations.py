"""Operator 13: collocations by truncated suffixes that are sorted and counted in shards of their first words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import Scratch
from .vocabulary import STEP, Reader, dealt, frequent, pack, unpack, vocabulary

LEAST, TOP, ABSORBED = 10, 2_000, 50  # times a phrase occurs, phrases a language, percent of a phrase's places in a longer one
SHARD = 2_000_000  # suffixes in a shard, about
_PIECE = words.table(b".,;:!?\x0a\x0b\x0c\x0d")
STOP = _PIECE | words.table(b" \t")


def suffixes(r: Reader, lo: int, hi: int) -> np.ndarray:
    """The ids of the words lo to hi and of the two after each in its piece, 0 past the end: an array of three rows."""
    end = min(hi + 2, len(r.starts))
    ids = r.ids(lo, end)
    piece = np.cumsum(_PIECE[r.data[r.starts[lo] : r.ends[end - 1]]], dtype=np.int64)[r.starts[lo:end] - r.starts[lo]]
    out = np.zeros((3, hi - lo), np.uint64)
    out[0] = ids[: hi - lo]
    for k in (1, 2):
        n = max(0, min(hi - lo, end - lo - k))
        with_ = (piece[:n] == piece[k : n + k]) & (r.row[lo : lo + n] == r.row[lo + k : lo + n + k])
        out[k, :n] = np.where(with_, ids[k : n + k], 0)
    return out


def counted_prefixes(s: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, places, counts) of all prefixes of two and of three words that occur ``least`` times.

    The suffixes stand in reverse lexicographic order, so that each prefix is one run. A run ends where a stack of open
    prefixes would be cut back to less than its length, and what was counted on it since is its count.
    """
    order = np.lexsort((s[2], s[1], s[0]))[::-1]
    s, n = s[:, order], n[order]
    cut = np.ones((3, n.size), bool)  # whether a prefix of 1, 2, 3 words begins here
    for k in range(3):
        cut[k, 1:] = (s[k, 1:] != s[k, :-1]) | (cut[k - 1, 1:] if k else False)
    for k in (1, 2):
        begins = np.flatnonzero(cut[k])
        times = np.add.reduceat(n, begins) if len(begins) else n
        big = (times >= least) & (s[k, begins] > 0)
        yield k + 1, s[: k + 1, begins[big]], times[big]


def phrases(texts: DataFrame, hot: np.ndarray, clashes: np.ndarray, shards: int, least: int = LEAST) -> DataFrame:
    """Rows (h1, h2, h3, a) of phrases of two (h3 null) and three words that occur ``least`` times in ``texts`` (part, text).

    Equal suffixes of a stretch of text are added up first. A suffix goes to the shard of its first word, or, where that is
    ``hot``, to that of its first two: a prefix of two words is whole in either.
    """
    hot = np.sort(hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = Reader(b.column(0), b.column(1), STOP, clashes)
            for lo in range(0, len(r.starts), STEP):
                s = suffixes(r, lo, min(lo + STEP, len(r.starts)))
                s = s[:, s[1] > 0]
                order = np.lexsort((s[2], s[1], s[0]))
                s = s[:, order]
                begins = np.flatnonzero(np.concatenate((np.ones(min(1, s.shape[1]), bool), (s[:, 1:] != s[:, :-1]).any(axis=0))))
                n, s = np.diff(np.append(begins, s.shape[1])).astype("u4"), s[:, begins]
                split = np.zeros(len(n), bool)
                if len(hot):
                    split = hot[np.minimum(np.searchsorted(hot, s[0]), len(hot) - 1)] == s[0]
                key = words.mixed(np.where(split, s[0] + words.mixed(s[1]), s[0])) % np.uint64(shards)
                rows = [(k, pack(*(x[own] for x in s), n[own])) for k, own in dealt(key.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["shard", "block"])

    def count(t: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in t.column("block").to_pylist()]
        s = np.stack([np.concatenate([p[k] for p in parts]) for k in range(3)])
        n = np.concatenate([p[3] for p in parts]).astype(np.int64)
        (_, two, a2), (_, three, a3) = counted_prefixes(s, n, least)
        cols = [np.concatenate((two[k], three[k])).view(np.int64) for k in (0, 1)]
        h3 = pa.array(np.concatenate((np.zeros(len(a2), np.int64), three[2].view(np.int64))), mask=np.arange(len(a2) + len(a3)) < len(a2))
        return pa.table({"h1": pa.array(cols[0]), "h2": pa.array(cols[1]), "h3": h3, "a": pa.array(np.concatenate((a2, a3)))})

    found = texts.select("part", "text").mapInArrow(cut, "shard int, block binary")
    return found.groupBy("shard").applyInArrow(count, "h1 long, h2 long, h3 long, a long")


def cohesion(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (l r)), in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, text_col: str = "text", part_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's phrases of two or three words that hold together best.

    A phrase's score is that of its worst cut; a phrase of two words goes where half of its places are in one of three.
    Every word and suffix of all texts is counted; a word in fewer than ``least`` places is in no phrase, so only the
    others' spellings are joined on. The window keeps each task's first ``top`` rows before they meet.

    Null text has no words, a null language is "und". Repeated rows count each. A text of any length is read in stretches
    of about a million words that share two. Languages without phrases, and empty tables, give no rows. Other columns aren't read.
    """
    at = Scratch(docs.sparkSession, "collocations")
    texts = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("und")).alias("part"), F.col(text_col).cast("string").alias("text"))
    vocab, totals, clashes = vocabulary(texts, at, STOP, least)
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // SHARD))
    ids, n = frequent(vocab)
    counted = at.put(phrases(texts, ids[n * 4 * shards > total], clashes, shards, least), "phrases")
    w = vocab.select("h", "part", "word", F.col("n").alias("c"))
    first, second = (w.select(F.col("h").alias(f"h{k}"), *([F.col("part").alias("lang")] if k == 1 else []), F.col("word").alias(f"w{k}"), F.col("c").alias(f"c{k}")) for k in (1, 2))
    pairs = at.put(counted.where("h3 is null").drop("h3").join(first, "h1").join(second, "h2"), "pairs")
    left = pairs.select("h1", "h2", "lang", F.concat_ws(" ", "w1", "w2").alias("head"), "c1", F.col("a").alias("a12"))
    right = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("w2").alias("w3"), F.col("c2").alias("c3"), F.col("a").alias("a23"))
    triples = counted.where("h3 is not null")
    held = triples.select("h1", "h2", "a").unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a")).groupBy("h1", "h2").agg(F.max("a").alias("within"))
    short = pairs.join(held, ["h1", "h2"], "left").where(f"within is null or 100 * within < {ABSORBED} * a")
    short = short.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("c1").alias("l"), F.col("c2").alias("r"), cohesion(F.col("a"), F.col("c1"), F.col("c2")).alias("score"))
    x = triples.join(left, ["h1", "h2"]).join(right, ["h2", "h3"])
    x = x.withColumn("s1", cohesion(F.col("a"), F.col("c1"), F.col("a23"))).withColumn("s2", cohesion(F.col("a"), F.col("a12"), F.col("c3")))
    early = F.col("s1") <= F.col("s2")
    long_ = x.select("lang", F.concat_ws(" ", "head", "w3").alias("phrase"), "a", F.when(early, F.col("c1")).otherwise(F.col("a12")).alias("l"), F.when(early, F.col("a23")).otherwise(F.col("c3")).alias("r"), F.least("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = short.unionByName(long_).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals.select(F.col("part").alias("lang"), "n"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
