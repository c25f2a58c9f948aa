"""Operator 8: toxicity by a character n-gram linear classifier on naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

BITS = 18
SIZES = (3, 4, 5, 6)  # bytes in an n-gram
WINDOW, STEP = 192, 32  # bytes that are scored together; the highest window is the text's score
SMOOTHING = 10.0
FIT_ROWS = 6_000  # bound on the labelled rows on which the linear weights are fitted; the ratios come from all of them
BUFFER = 1 << 18  # bytes of a long text that are read at once

# ASCII letters in lower case, digits and all bytes beyond ASCII; anything else parts words.
_PLAIN = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def clean_bytes(text: str | None) -> np.ndarray:
    """All words in their own order, in lower case (A-Z only), parted by single spaces."""
    words = (text or "").encode().translate(_PLAIN).split()
    return np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)


def buckets(x: np.ndarray) -> list[np.ndarray]:
    """For each n-gram size, the bucket of the n-gram at each place."""
    out, h, done = [], np.zeros(len(x), np.uint32), 0
    for n in SIZES:
        while done < n:
            m = len(x) - done
            h = h[:m] * np.uint32(0x01000193) + x[done:].astype(np.uint32) if m > 0 else h[:0]
            done += 1
        g = h ^ (h >> np.uint32(15))
        g = (g + np.uint32(n)) * np.uint32(0x85EBCA6B)
        out.append(((g ^ (g >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
    return out


def distinct(b: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Distinct buckets; seen is a work array with a place for each bucket."""
    at = np.arange(len(b), dtype=np.int32)
    seen[b] = at
    return b[seen[b] == at]


def window_sums(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the distinct n-grams that begin in each window, the windows STEP apart and all of x in some window.

    A feature is there or not: an n-gram counts in the windows that hold it but no earlier one of the same bucket.
    """
    n = len(range(0, max(1, len(x) - WINDOW + STEP), STEP))
    change = np.zeros(n + 1)
    for g in buckets(x):
        key = np.sort(g.astype(np.uint64) << np.uint64(32) | np.arange(len(g), dtype=np.uint64))
        at, bucket = (key & np.uint64(0xFFFFFFFF)).astype(np.int64), (key >> np.uint64(32)).astype(np.int64)
        before = np.full(len(at), -1)
        before[1:] = np.where(bucket[1:] == bucket[:-1], at[:-1], -1)
        first, end = np.maximum(np.maximum(before, at - WINDOW) // STEP + 1, 0), np.minimum(at // STEP + 1, n)
        some = first < end
        w = weight[bucket[some]]
        change += np.bincount(first[some], w, n + 1) - np.bincount(end[some], w, n + 1)
    return np.cumsum(change)[:n]


def top_window(text: str | None, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The highest window sum of a whole text and the bytes of that window. Long texts are read piece by piece."""
    x, best, at = clean_bytes(text), -np.inf, 0
    for s in range(0, len(x), BUFFER):
        sums = window_sums(x[s : s + BUFFER + WINDOW], weight)
        i = int(sums.argmax())
        if sums[i] > best:
            best, at = float(sums[i]), s + i * STEP
    return best, x[at : at + WINDOW]


@dataclass
class Model:
    weight: np.ndarray  # for each bucket: its log-count ratio times its linear weight
    bias: float

    def score(self, text: str | None) -> float:
        z = top_window(text, self.weight)[0] + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def clean_words(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, words): each text's clean_bytes, compressed. Features hang on these alone, and they are a part of the text to shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            words = [z.compress(clean_bytes(t.as_py()).tobytes()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary())], names=["doc_id", "words"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, words binary")


def log_count_ratios(train: DataFrame) -> tuple[np.ndarray, int, int]:
    """ln of the share of toxic over the share of clean training rows with a bucket, smoothed toward 0; and the rows of either class.

    Counted over all rows of ``train`` (words, toxic). What reaches the driver is bounded by the number of buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << BITS, np.int32), np.zeros((2, (1 << BITS) + 1), np.int64)
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for words, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                x, found = np.frombuffer(z.decompress(words.as_py()), np.uint8), []
                for s in range(0, len(x), BUFFER):
                    found += [distinct(g, seen) for g in buckets(x[s : s + BUFFER + SIZES[-1]])]
                n[y][distinct(np.concatenate(found), seen)] += 1
                n[y][-1] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0][at]), pa.array(n[1][at])], names=["bucket", "clean", "toxic"])

    sums = train.select("words", "toxic").mapInArrow(run, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    n = np.zeros((2, (1 << BITS) + 1))
    at = sums["bucket"].to_numpy()
    n[0][at], n[1][at] = sums["clean"].to_numpy(), sums["toxic"].to_numpy()
    rows = n[:, -1]
    prior = (rows + 1) / (rows.sum() + 2)
    share = (n[:, :-1] + SMOOTHING * prior[:, None]) / (rows[:, None] + SMOOTHING * prior[:, None] + 1e-9)
    return np.log(share[1]) - np.log(share[0]) if rows.all() else np.zeros(1 << BITS), int(rows[1]), int(rows[0])


def fit_linear(rows: list[tuple[np.ndarray, int]], ratio: np.ndarray, rounds: int = 120, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic weights over the ratio-scaled distinct n-grams of windows (bytes, label), by gradient steps with momentum."""
    seen = np.zeros(1 << BITS, np.int32)
    sets = [distinct(np.concatenate([g for g in buckets(x)] or [np.zeros(0, np.uint32)]), seen) for x, _ in rows]
    size = np.array([len(s) for s in sets])
    used, col = np.unique(np.concatenate(sets), return_inverse=True)
    row, value = np.repeat(np.arange(len(sets)), size), ratio[used][col]
    y = np.array([label for _, label in rows], float)
    scale = max(1e-9, float(np.bincount(row, value**2, len(sets)).mean()))
    w, bias, vw, vb = np.full(len(used), 0.1), -2.0, 0.0, 0.0
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * 0.5 + 0.5 / len(y)
    for _ in range(rounds):
        z = np.bincount(row, value * w[col], len(sets)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        vw = 0.9 * vw + np.bincount(col, value * err[row], len(used)) + ridge * w / len(y)
        vb = 0.9 * vb + err.sum() * 4
        w, bias = w - rate * 20 / scale * vw, bias - rate * vb
    out = np.zeros(1 << BITS)
    out[used] = w * ratio[used]
    return out, float(bias)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from the labelled rows of ``docs`` whose crc32(doc_id) mod 5 is not 0.

    The log-count ratios come from all of those rows, the linear weights from ``fit_rows`` of them, those of the lowest
    hash among the ids that ``docs`` has; labels of other ids count for nothing. Null labels are left out; of several labels of a document the highest counts. Without rows of both classes
    the model gives 0 throughout.
    """
    spark = docs.sparkSession
    ship(spark)
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(~held_out("doc_id"))
    # labels grow with the corpus: one plan at every size, without a broadcast
    ratio, toxic, clean = log_count_ratios(clean_words(docs.where(~held_out("doc_id"))).join(marks.hint("merge"), "doc_id"))
    if not toxic or not clean:
        return Model(np.zeros(1 << BITS), -40.0)
    here = marks.join(docs.select("doc_id"), "doc_id", "left_semi")
    some = F.broadcast(here.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    handle = spark.sparkContext.broadcast(ratio.astype(np.float32))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.maximum(handle.value, 0)
        for b in batches:
            got = [top_window(t.as_py(), weight)[1].tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary()), b.column(2)], names=["doc_id", "bytes", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(some, "doc_id").mapInArrow(windows, f"doc_id {kind}, bytes binary, toxic int").toArrow().sort_by([("doc_id", "ascending"), ("bytes", "ascending")])
    rows = [(np.frombuffer(x, np.uint8), y) for x, y in zip(picked["bytes"].to_pylist(), picked["toxic"].to_pylist(), strict=True)]
    return Model(*fit_linear(rows, ratio))


def held_out(col: str):
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, score, predicted) for every document, from its whole text alone.

    Null text counts as empty and is scored as such. Repeated rows give repeated rows; other columns are not read; an
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    handle = spark.sparkContext.broadcast((model.weight.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*handle.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t.as_py()) for t in b.column(1)], pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, score double")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; all columns stay as they are.

    Null text is scored as empty text; ids are not read; of repeated rows all go or all stay; an empty table stays empty.
    """
    spark = docs.sparkSession
    ship(spark)
    handle = spark.sparkContext.broadcast((model.weight.astype(np.float32), model.bias))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*handle.value)
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py()) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
