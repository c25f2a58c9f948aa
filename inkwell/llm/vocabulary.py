"""Word counts over whole corpora: words are counted by 64-bit ids in tasks, and merged by shards of ids."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import Scratch, partitions, ship

STEP = 1 << 20  # words that are looked at together, whatever the rows
HOT = 65_535  # most words in the list of frequent ones: what a task holds of the vocabulary
_KINDS = ("u1", "u2", "u4", "u8", "f8", "f4", "?")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; the first bytes of all numbers of an array stand together, then the second ones, and so on."""
    out = [bytes([len(arrays)])]
    for a in arrays:
        out += [bytes([_KINDS.index(a.dtype.str[1:] if a.dtype != bool else "?")]), len(a).to_bytes(8, "little")]
    for a in arrays:
        wide = a.dtype.itemsize
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, wide).T).tobytes() if wide > 1 else a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(block: bytes) -> list[np.ndarray]:
    block, out = zstandard.ZstdDecompressor().decompress(block), []
    at = 1 + 9 * block[0]
    for i in range(block[0]):
        kind, n = np.dtype(_KINDS[block[1 + 9 * i]]), int.from_bytes(block[2 + 9 * i : 10 + 9 * i], "little")
        bytes_ = np.frombuffer(block, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(bytes_.T).reshape(-1).view(kind) if kind.itemsize > 1 else bytes_[0].view(kind))
        at += n * kind.itemsize
    return out


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins): an order that sorts ``key``, equal ones by their place, and where in it each value begins.

    The key's upper bits and the place are sorted as one number, which is much faster than sorting places by keys;
    where the bits left out would matter, places are sorted by the whole keys.
    """
    n = np.uint64(max(1, (len(key) - 1).bit_length()))
    mask = (np.uint64(1) << n) - np.uint64(1)
    key = key.astype(np.uint64, copy=False)
    small = not len(key) or int(key.max()) >> (64 - int(n)) == 0
    order = (np.sort((key << n if small else key & ~mask) | np.arange(len(key), dtype=np.uint64)) & mask).astype(np.int64)
    k = key[order]
    if not small and (k[1:] < k[:-1]).any():
        order = np.argsort(key, kind="stable")
        k = key[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))


def dealt(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) for each shard that occurs, places in order."""
    order, begins = runs(shard)
    for b, e in zip(begins, np.append(begins[1:], len(shard)) if len(shard) else begins, strict=True):
        yield int(shard[order[b]]), order[b:e]


class Reader:
    """Words of a batch's texts, A-Z lowered: ``starts``, ``ends`` and ``row`` of each; with ``ended`` an empty word ends each row."""

    def __init__(self, parts: pa.Array, texts: pa.Array, stop: np.ndarray, clashes: np.ndarray, ended: bool = False):
        data, self.offsets = words.buffers(texts)
        self.data, self.stop, self.clashes = words.LOWER[data], stop, clashes
        self.starts, self.ends, self.row = words.spans(self.data, self.offsets, stop)
        if ended:
            n, rows = len(self.starts), len(self.offsets) - 1
            at, own = np.arange(n) + self.row, np.searchsorted(self.row, np.arange(rows), "right") + np.arange(rows)
            for name, last in (("starts", self.offsets[1:]), ("ends", self.offsets[1:]), ("row", np.arange(rows))):
                whole = np.empty(n + rows, np.int64)
                whole[at], whole[own] = getattr(self, name), last
                setattr(self, name, whole)
        self.x, self.lanes = words.padded(self.data)
        self.parts = ["" if p is None else p for p in parts.to_pylist()]
        salts = {p: int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "little") for p in set(self.parts)}
        self.salt = np.array([salts[p] for p in self.parts], np.uint64)

    def hashes(self, lo: int, hi: int, seed: int) -> np.ndarray:
        return words.mixed(words.hashes(self.x, self.lanes, self.starts[lo:hi], self.ends[lo:hi], seed) ^ self.salt[self.row[lo:hi]])

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """The id of each word of lo to hi, by its part too; never 0. Ids that several words would have are hashed otherwise."""
        h = self.hashes(lo, hi, 0)
        if len(self.clashes) and (clash := np.isin(h, self.clashes)).any():
            h[clash] = self.hashes(lo, hi, 2)[clash]
        return np.maximum(h, np.uint64(1))


def vocabulary(texts: DataFrame, at: Scratch, stop: np.ndarray, least: int = 1, ended: bool = False, name: str = "vocabulary") -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(vocabulary, totals, clashes) of ``texts`` (part string, text string).

    vocabulary: rows (h, part, word, n) of words that occur ``least`` times in a part. totals: rows (part, n, v), all words
    of each part and how many differ. Words are counted by their ids; where the second hashes of an id's words differ, the
    count is taken again with ids that keep those words apart.
    """
    spark = texts.sparkSession
    ship(spark)
    clashes = np.zeros(0, np.uint64)
    for turn in range(8):
        got = at.put(_counted(texts, stop, least, ended, clashes, partitions(spark)), f"{name}-{turn}")
        new = got.where("kind = 2").select("h").distinct().toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64)
        if not len(new):
            return got.where("kind = 0").select("h", "part", "word", "n"), got.where("kind = 1").groupBy("part").agg(F.sum("n").alias("n"), F.sum("v").alias("v")), clashes
        clashes = np.concatenate((clashes, new))
    raise ValueError("word ids clash again and again")


def _counted(texts: DataFrame, stop: np.ndarray, least: int, ended: bool, clashes: np.ndarray, shards: int) -> DataFrame:
    def blocks(key: np.ndarray, part: str | None, *arrays: np.ndarray, text: Callable | None = None) -> Iterator[tuple]:
        for s, own in dealt((key % np.uint64(shards)).astype(np.int64)):
            yield s, part, pack(key[own], *(a[own] for a in arrays), *(text(own) if text else ()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, check = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            r, rows = Reader(b.column(0), b.column(1), stop, clashes, ended), []
            for lo in range(0, len(r.starts), STEP):
                hi = min(lo + STEP, len(r.starts))
                h, g = r.ids(lo, hi), r.hashes(lo, hi, 1)
                order, begins = runs(h)
                rep, times = order[begins], np.diff(np.append(begins, len(h)))
                odd = order[g[order] != np.repeat(g[rep], times)]  # another word of the same id
                place = np.searchsorted(known, h[rep])
                old = np.zeros(len(rep), bool)
                old[place < len(known)] = known[place[place < len(known)]] == h[rep][place < len(known)]
                n[place[old]] += times[old]
                told = np.concatenate((rep[~old], odd, rep[old][check[place[old]] != g[rep[old]]]))
                fresh = rep[~old]
                known, n, check = (np.insert(a, place[~old], v) for a, v in ((known, h[fresh]), (n, times[~old]), (check, g[fresh])))
                part = r.row[lo + told]
                for p in np.unique(r.salt[part]):
                    own = told[r.salt[part] == p]

                    def text(i: np.ndarray, own: np.ndarray = own, lo: int = lo, r: Reader = r) -> tuple[np.ndarray, np.ndarray]:
                        s, e = r.starts[lo + own[i]], r.ends[lo + own[i]]
                        got = words.gathered(r.x, s, e)
                        return (e - s).astype("u4"), np.frombuffer(got.buffers()[2], np.uint8)

                    rows += blocks(h[own], r.parts[r.row[lo + own[0]]], g[own], text=text)
            yield _batch(rows)
        yield _batch(list(blocks(known, None, n.astype(np.uint64))))

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "part", "block"])

    def merge(t: pa.Table) -> pa.Table:
        parts, kinds, told, times = t.column("part").to_pylist(), [], [], []
        for p, block in zip(parts, t.column("block").to_pylist(), strict=True):
            if p is None:
                times.append(unpack(block))
            else:
                kinds.append(p)
                told.append(unpack(block))
        h, n = (np.concatenate([x[i] for x in times] or [np.zeros(0, np.uint64)]) for i in (0, 1))
        order, begins = runs(h)
        ids, sums = h[order[begins]], np.add.reduceat(n[order], begins) if len(h) else n
        names = sorted(set(kinds))
        w, g = (np.concatenate([x[i] for x in told] or [np.zeros(0, np.uint64)]) for i in (0, 1))
        part = np.concatenate([np.full(len(x[0]), names.index(p)) for p, x in zip(kinds, told, strict=True)] or [np.zeros(0, np.int64)])
        size = np.concatenate([x[2] for x in told] or [np.zeros(0, np.uint32)]).astype(np.int64)
        data = np.concatenate([x[3] for x in told] or [np.zeros(0, np.uint8)])
        begin = np.cumsum(size) - size
        order, begins = runs(w)
        rep = order[begins]
        clash = np.unique(w[order[g[order] != np.repeat(g[rep], np.diff(np.append(begins, len(w))))]])
        counted = sums[np.searchsorted(ids, w[rep])].astype(np.int64) if len(rep) else np.zeros(0, np.int64)
        all_n, all_v = (np.bincount(part[rep], weights, len(names)).astype(np.int64) for weights in (counted, None))
        rep, counted = rep[counted >= least], counted[counted >= least]
        text = words.gathered(data, begin[rep], begin[rep] + size[rep]).cast(pa.large_string()).cast(pa.string())
        k, none = len(names), [None] * len(names)
        return pa.table({
            "kind": pa.array(np.repeat([0, 1, 2], [len(rep), k, len(clash)]).astype(np.int32)),
            "h": pa.array(np.concatenate((w[rep].view(np.int64), np.zeros(k, np.int64), clash.view(np.int64)))),
            "part": pa.array([names[i] for i in part[rep]] + names + [None] * len(clash), pa.string()),
            "word": pa.concat_arrays([text, pa.array(none + [None] * len(clash), pa.string())]),
            "n": pa.array(np.concatenate((counted, all_n, np.zeros(len(clash), np.int64)))),
            "v": pa.array(np.concatenate((np.zeros(len(rep), np.int64), all_v, np.zeros(len(clash), np.int64)))),
        })

    blocks_ = texts.select("part", "text").mapInArrow(count, "shard int, part string, block binary")
    return blocks_.groupBy("shard").applyInArrow(merge, "kind int, h long, part string, word string, n long, v long")


def frequent(vocab: DataFrame, most: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of the ``most`` words that occur most often, by falling count: what a task may hold of any vocabulary."""
    t = vocab.select("h", "n").orderBy(F.col("n").desc(), "h").limit(most).toArrow()
    return t["h"].to_numpy().astype(np.int64).view(np.uint64), t["n"].to_numpy().astype(np.int64)
