"""Operator 1: removal of long repeated strings by distributed prefix doubling over ranks of byte strings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, meet, ship
from .shingles import mix

LENGTH = 200  # bytes of a string that must not repeat
ANCHOR = 64  # bytes of the strings that are ranked first
STEP = 16  # windows in a block of round 3
PIECE = 1 << 19  # bytes ranked at once; positions in a piece fit into _POS bits
_POS = np.uint64(20)
_LOW = np.uint64((1 << 20) - 1)
_FIRST = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of two strings that follow (or overlap at a fixed distance), from their ranks: equal for equal strings."""
    t = a * np.uint64(0x9E3779B97F4A7C15)
    t += b
    t ^= t >> np.uint64(29)
    t *= np.uint64(0xBF58476D1CE4E5B9)
    t ^= t >> np.uint64(32)
    return t


def ranks(x: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Ranks of the strings of each length from each place on, by doubling: the rank of 2n bytes is that of two of n.

    Other lengths take two strings that overlap. Lengths ascend.
    """
    h, n, out = _FIRST[x], 1, []
    for length in lengths:
        while 2 * n <= length:
            h, n = _pair(h[:-n], h[n:]), 2 * n
        out.append(_pair(h[: len(h) - (length - n)], h[length - n :]) if n < length else h)
    return out


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) in parts of about PIECE bytes; pieces of a text overlap, so each window lies in one of them."""
    part, held = [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(0, len(t) - length + 1), PIECE // 2):
            y = t[s : s + PIECE // 2 + length - 1]
            part.append((i, s, y))
            held += len(y)
            if held >= PIECE // 2:
                yield part
                part, held = [], 0
    if part:
        yield part


def anchors(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Sampled positions: (text, first window, windows less one, distance from there to the anchor, its rank, rank of the whole stretch).

    Each window of ``length`` bytes has as anchor the least-ranked of the ANCHOR-byte strings in it, the first of
    equals. It hangs on the window's bytes alone, so equal windows have equal anchors at equal distances. Windows in a
    row with the same anchor are one stretch; equal stretches have equal ranks and hold equal windows. A stretch that
    goes on in the next piece of its text is held back and joined there, so each anchor has one row.
    """
    width, seam = length - ANCHOR + 1, None
    for part in _pieces(texts, length):
        x = np.frombuffer(b"".join(y for _, _, y in part), np.uint8)
        size = np.array([len(y) for _, _, y in part])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        anchor, whole = ranks(x, ANCHOR, length)
        m = (anchor >> _POS << _POS) | np.arange(len(anchor), dtype=np.uint64)
        n = 1
        while 2 * n <= width:
            m, n = np.minimum(m[:-n], m[n:]), 2 * n
        m = np.minimum(m[: len(m) - (width - n)], m[width - n :]) if n < width else m
        at = (m & _LOW).astype(np.int64)
        inside = np.zeros(len(at) + 1, np.int32)
        np.add.at(inside, begin, 1)
        np.add.at(inside, np.minimum(begin + size - length + 1, len(at)), -1)
        at[np.cumsum(inside[:-1]) == 0] = -1
        cut = np.flatnonzero(np.diff(at, prepend=-2))
        last = np.append(cut[1:], len(at)) - 1
        live = at[cut] >= 0
        cut, last = cut[live], last[live]
        a = at[cut]
        owner = np.searchsorted(begin, cut, "right") - 1
        number, offset = np.array([i for i, _, _ in part]), np.array([s for _, s, _ in part])
        rows = [number[owner], cut - begin[owner] + offset[owner], last - cut, a - cut, anchor[a], whole[cut], whole[last]]
        if seam is not None:
            rows = [np.concatenate(x) for x in zip(seam, rows, strict=True)]
            _, lo, more, off, _, first, _ = rows
            if lo[0] + off[0] == lo[1] + off[1]:
                lo[1], more[1], off[1], first[1] = lo[0], more[0] + more[1] + 1, off[0], first[0]
                rows = [x[1:] for x in rows]
        i, s, _ = part[-1]
        goes_on = s + PIECE // 2 < len(texts[i]) - length + 1
        seam = [x[-1:] for x in rows] if goes_on else None
        i, lo, more, off, v, first, end = [x[:-1] for x in rows] if goes_on else rows
        yield i, lo, more, off, v, _pair(_pair(first, end), (more * 1024 + off).astype(np.uint64))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of n bytes within [start, end) of any span."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def _key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k, body): k tells texts of one id apart, so repeated rows and reused ids are no trouble; body is UTF-8."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("k"), text.cast("binary").alias("body"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.k") == F.col(f"{b}.k"))


def _take(b: pa.RecordBatch, names: str, rows: np.ndarray) -> list[pa.Array]:
    rows = pa.array(rows)
    return [b.column(b.schema.names.index(c)).take(rows) for c in names.split()]


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns]


def blocks_of(slices: list[bytes], at: np.ndarray, far: np.ndarray, near: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The windows of each stretch in blocks of STEP by their distance to the anchor: (stretch, block, core, whole, bounded, farthest, nearest).

    ``at`` is the anchor's place in its slice of the text; the windows begin ``far`` to ``near`` bytes before it. core
    ranks the bytes that all windows of the full block share: where it is unique, none of them repeats. whole ranks all
    bytes of the full block: where it repeats, all of them do; it is there only where the slice bounds the block.
    """
    x = np.frombuffer(b"".join(slices) + bytes(2 * length), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(y) for y in slices])[:-1]])
    size = np.array([len(y) for y in slices])
    core, whole = ranks(x, length - STEP + 1, length)
    first, last = near // STEP, far // STEP
    i = np.repeat(np.arange(len(slices)), last - first + 1)
    j = np.arange(len(i)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[i]
    p = at[i] - STEP * j  # the block's nearest window
    inside = (p - STEP + 1 >= 0) & (p + length <= size[i])
    q = begin[i] + p
    return i, j, core[q], _pair(whole[np.where(inside, q - STEP + 1, 0)], whole[np.where(inside, q, 0)]), inside, np.minimum(STEP * j + STEP - 1, far[i]), np.maximum(STEP * j, near[i])


def repeated_stretches(docs: DataFrame, at: Scratch, length: int = LENGTH) -> DataFrame:
    """Rows (id, k, lo, hi): windows from lo to hi, all of which repeat somewhere else.

    Each round ranks longer strings of the positions that are left, sorts them by rank, and lets go of those whose rank
    is unique. Round 1 takes sampled positions and ANCHOR bytes; round 2 their stretches of windows; round 3 blocks of
    STEP windows where stretches of one anchor differ; round 4 single windows of ``length`` bytes where blocks with the
    same core differ. What equals another as a whole is done with at once; one of the equals stands for all from there on.
    """
    place = "id long, k long, lo long"

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(2)]
            for i, lo, more, off, v, c in anchors(texts, length):
                yield pa.RecordBatch.from_arrays([*_take(b, "id k", i), *_longs(lo), pa.array(more.astype(np.int16)), pa.array(off.astype(np.int16)), *_longs(v, c)], names=["id", "k", "lo", "more", "off", "v", "c"])

    sampled = at.put(docs.mapInArrow(sample, f"{place}, more smallint, off smallint, v long, c long"), "sampled")
    again = at.put(sampled.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    alive = at.put(meet(sampled, again, ["v"], ["id", "k", "lo"]), "alive")
    at.drop("sampled", "again")
    whole, open_ = _equals(alive, ["v"], "c", at, "stretches")
    whole = at.put(whole.select("id", "k", "lo", (F.col("lo") + F.col("more")).alias("hi")), "done-2")
    open_ = open_.groupBy("id", "k").agg(F.collect_list(F.struct("lo", "more", "off", "v")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                body, spans = b.column(2)[row].as_py(), b.column(3)[row].values
                lo, more, off, v = (np.asarray(spans.field(c)) for c in ("lo", "more", "off", "v"))
                lo, more, off = lo.astype(np.int64), more.astype(np.int64), off.astype(np.int64)
                begin = np.maximum(lo + off - (off // STEP + 1) * STEP, 0)
                slices = [body[s:e] for s, e in zip(begin.tolist(), (lo + off + length).tolist(), strict=True)]
                n = np.full(len(lo), row)
                yield pa.RecordBatch.from_arrays([*_take(b, "id k", n), *_longs(lo, lo + off - begin, off, off - more), *_longs(v), pa.array(slices, pa.binary())], names=["id", "k", "lo", "at", "far", "near", "v", "bytes"])

    joined = docs.alias("d").join(open_.alias("o"), _same("d", "o")).select("d.id", "d.k", "d.body", "o.spans")
    slices = at.put(joined.mapInArrow(cut, f"{place}, at long, far long, near long, v long, bytes binary"), "slices")
    at.drop("alive", "stretches", "stretches-differ")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2_000):
                r = b.slice(s, 2_000)
                i, j, core, all_, inside, far, near = blocks_of(r.column(6).to_pylist(), *(np.asarray(r.column(c)) for c in (3, 4, 5)), length)
                # a block that the text does not bound equals no other as a whole
                alone = mix(np.arange(len(i), dtype=np.uint64) + mix(np.asarray(r.column(2)).view(np.uint64)[i] + np.asarray(r.column(1)).view(np.uint64)[i]))
                yield pa.RecordBatch.from_arrays([*_take(r, "id k lo", i), *_longs(j, core, np.where(inside, all_, alone), far, near), *_take(r, "v", i)], names=["id", "k", "lo", "j", "core", "c", "far", "near", "v"])

    blocks = slices.select("id", "k", "lo", "at", "far", "near", "bytes", "v").mapInArrow(split, f"{place}, j long, core long, c long, far long, near long, v long")
    blocks = at.put(blocks, "blocks")
    whole3, open_ = _equals(blocks, ["v", "j", "core"], "c", at, "cores")
    anchor = slices.select(F.col("id").alias("i2"), F.col("k").alias("k2"), F.col("lo").alias("lo2"), "at", F.col("far").alias("off"), "bytes")
    here = F.col("id").eqNullSafe(F.col("i2")) & (F.col("k") == F.col("k2")) & (F.col("lo") == F.col("lo2"))
    # places of blocks: the stretch's first window is ``off`` before its anchor
    offsets = slices.select(F.col("id").alias("i2"), F.col("k").alias("k2"), F.col("lo").alias("lo2"), F.col("far").alias("off"))
    done3 = whole3.join(offsets, here).select("id", "k", (F.col("lo") + F.col("off") - F.col("far")).alias("lo"), (F.col("lo") + F.col("off") - F.col("near")).alias("hi"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2_000):
                r = b.slice(s, 2_000)
                lo, off, spot, far, near = (np.asarray(r.column(c)) for c in range(2, 7))
                n = far - near + 1
                parts = [y[p : p + m + length - 1] for y, p, m in zip(r.column(8).to_pylist(), (spot - far).tolist(), n.tolist(), strict=True)]
                (name,) = ranks(np.frombuffer(b"".join(parts), np.uint8), length)
                begin = np.cumsum(n + length - 1) - (n + length - 1)
                i = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([*_take(r, "id k", i), *_longs(lo[i] + off[i] - far[i] + step), *_take(r, "v", i), *_longs(name[begin[i] + step])], names=["id", "k", "p", "v", "w"])

    single = open_.join(anchor, here).select("id", "k", "lo", "off", "at", "far", "near", "v", "bytes").mapInArrow(windows, "id long, k long, p long, v long, w long")
    single = at.put(single, "windows")
    twice = at.put(single.groupBy("v", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twice")
    done4 = meet(single, twice, ["v", "w"], ["id", "k", "p"]).select("id", "k", F.col("p").alias("lo"), F.col("p").alias("hi"))
    return whole.unionByName(done3).unionByName(done4)


def _equals(rows: DataFrame, group: list[str], rank: str, at: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Of rows whose group holds others: those that equal another by ``rank``, and those to look at more closely.

    The latter are in groups of more than one rank: each row that equals no other, and the first of those that do.
    """
    kinds = at.put(rows.groupBy(*group, rank).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "k", "lo")).alias("first")), name)
    differ = at.put(kinds.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{name}-differ")
    equal = meet(rows, kinds.where("n > 1").select(*group, rank, "n"), [*group, rank], ["id", "k", "lo"], "left_semi")
    # of a kind of one row, that row is the first
    first = meet(kinds.select(*group, rank, "first"), differ, group, [rank], "left_semi").select(*[F.col(c).alias(f"_{c}") for c in (*group, rank)], F.col("first.id").alias("_id"), F.col("first.k").alias("_k"), F.col("first.lo").alias("_lo"))
    same = F.col("id").eqNullSafe(F.col("_id"))
    for c in (*group, rank, "k", "lo"):
        same &= F.col(c) == F.col(f"_{c}")
    return equal, rows.join(first, same, "left_semi")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept binary): each document without the bytes that repeated strings cover.

    A byte goes if a ``length``-byte string of its document that covers it also starts anywhere else, in the same
    document too; strings never cross documents and are judged on the input. Null text counts as empty. Repeated rows
    are documents of their own and repeat one another. Ids are whole numbers or null, and may recur. Other columns are
    not read; an empty table gives an empty one. Ranks are 64-bit fingerprints; a window is taken to repeat only if
    those of its anchor and of itself both agree.
    """
    spark = docs.sparkSession
    ship(spark)
    at = Scratch(spark, "suffix")
    docs = _key(docs, id_col, text_col)
    spans = at.put(repeated_stretches(docs, at, length).groupBy("id", "k").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    at.drop("slices", "blocks", "cores", "cores-differ", "windows", "twice", "done-2")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for body, found in zip(b.column(1), b.column(2), strict=True):
                body, gone = body.as_py(), 0
                kept, spans = body, 0
                if found.is_valid:
                    lo, hi = (np.asarray(found.values.field(j)) for j in (0, 1))
                    mask = covered(len(body), lo, hi + length)
                    gone, spans = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = np.frombuffer(body, np.uint8)[~mask].tobytes()
                rows.append((len(body), gone, spans, kept))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.binary()], strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = docs.alias("d").join(spans.alias("s"), _same("d", "s"), "left").select("d.id", "d.body", "s.spans")
    return out.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
