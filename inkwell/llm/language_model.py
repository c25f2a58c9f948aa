"""Operator 12: language-model scores by a trie of words, pairs and triples in Elias-Fano levels, cut into shards by context."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import Scratch, partitions
from .elias_fano import EliasFano, mapped
from .vocabulary import STEP, Reader, dealt, frequent, pack, runs, unpack, vocabulary

DISCOUNT = 0.75  # taken off the count of each pair and triple, for what was never seen after its context
SHARD = 1_000_000  # places of the corpus in a shard, about
CLASS = 500_000  # places after a word from which on they are dealt over shards by the word before; no count depends on it
HOT = 262_143  # most words whose counts are with every task
COLD = HOT  # code of the others
SCALE = 4_096.0  # steps of a stored probability for each power of ten


def quantised(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit steps on a logarithmic scale, within 0.03 % of their value; 65,535 is 0."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.round(-np.log10(p) * SCALE), 65_535).astype("u2")


def restored(q: np.ndarray) -> np.ndarray:
    return np.where(q == 65_535, 0.0, 10 ** (q.astype(np.float64) / -SCALE))


class Words:
    """Codes of the frequent words by rank; others have COLD, and their ids stand beside them."""

    def __init__(self, ids: np.ndarray, n: np.ndarray):
        self.ids, self.n, self._by_id, self._classes = ids, n, None, None
        k = -(-n // CLASS)
        self.classes = k[k > 1]  # of words as contexts: counts fall, so those with more than one come first

    def codes(self, h: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.full(len(h), COLD, "u4")
        if self._by_id is None:  # in each worker: where the ids of each top 18 bits begin, in the order of ids
            order = np.argsort(self.ids)
            self._by_id = np.append(self.ids[order], np.uint64(0)), order.astype("u4"), np.searchsorted(self.ids[order] >> np.uint64(46), np.arange((1 << 18) + 1, dtype=np.uint64)).astype("u4")
        ids, order, begins = self._by_id
        top = (h >> np.uint64(46)).astype(np.int64)
        at, end = begins[top].astype(np.int64), begins[top + 1].astype(np.int64)
        more = np.flatnonzero((ids[at] < h) & (at < end))
        while len(more):
            at[more] += 1
            more = more[(ids[at[more]] < h[more]) & (at[more] < end[more])]
        out = np.full(len(h), COLD, "u4")
        hit = np.flatnonzero((at < end) & (ids[at] == h))
        out[hit] = order[at[hit]]
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_by_id": None, "_classes": None}

    def context(self, w2: np.ndarray, code2: np.ndarray, w1: np.ndarray) -> np.ndarray:
        """The id of the context word, by class of the word before where it is so frequent that it has classes."""
        k = np.append(self.classes, 1).astype(np.uint64)[np.minimum(code2, len(self.classes))]
        out, many = w2.copy(), np.flatnonzero(k > 1)
        out[many] = words.mixed(w2[many] + np.uint64(1) + words.mixed(w1[many]) % k[many])
        return out

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, codes): the context ids of all words that have classes, in order, and whose they are."""
        if self._classes is None:
            k = self.classes
            code = np.repeat(np.arange(len(k)), k)
            ids = words.mixed(self.ids[code] + np.uint64(1) + (np.arange(len(code)) - np.repeat(np.cumsum(k) - k, k)).astype(np.uint64))
            order = np.argsort(ids)
            self._classes = ids[order], code[order]
        return self._classes

    def long(self, code: np.ndarray, cold: np.ndarray) -> np.ndarray:
        out = np.append(self.ids, np.uint64(0))[np.minimum(code, len(self.ids))]
        out[code == COLD] = cold
        return out


Places = tuple[np.ndarray, ...]  # ctx, w1, code1, w3, code3, count of w3, row, whether to learn from: of each place


def packed(places: Places) -> bytes:
    """Places of a stretch of text as a block: each different triple once, then the rows in which it stands.

    They are sorted by a few bits of the context and a hash of the words; triples that happen to lie mixed are sent in parts.
    """
    low = np.uint64(40)
    order, _ = runs((places[0] >> low << low) | (words.mixed(places[1] + words.mixed(places[3])) >> (np.uint64(64) - low)))
    ctx, w1, code1, w3, code3, c3, doc, learnt = (a[order] for a in places)
    begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(ctx)), bool), (ctx[1:] != ctx[:-1]) | (w1[1:] != w1[:-1]) | (w3[1:] != w3[:-1]))))
    ctx, w1, code1, w3, code3, c3 = (a[begins] for a in (ctx, w1, code1, w3, code3, c3))
    heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(ctx)), bool), ctx[1:] != ctx[:-1])))
    n = np.add.reduceat(learnt.astype(np.int64), begins) if len(begins) else begins
    rare1, rare3 = code1 == COLD, code3 == COLD
    triples = pack(ctx[heads], np.diff(np.append(heads, len(ctx))).astype("u4"), code1, w1[rare1], code3, w3[rare3], c3[rare3].astype("u8"), n.astype("u4"))
    return len(triples).to_bytes(8, "little") + triples + pack(np.diff(np.append(begins, len(doc))).astype("u4"), doc.astype("u8"))


def standing(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, doc) of ``packed``: in how many rows each triple stands, and in which."""
    times, doc = unpack(block[8 + int.from_bytes(block[:8], "little") :])
    return times.astype(np.int64), doc


def unpacked(w: Words, block: bytes) -> tuple[np.ndarray, ...]:
    """(ctx, w1, w3, c3, learnt) of ``packed``."""
    heads, size, code1, cold1, code3, cold3, rare, learnt = unpack(block[8 : 8 + int.from_bytes(block[:8], "little")])
    c3 = np.append(w.n, 0)[np.minimum(code3, len(w.n))]
    c3[code3 == COLD] = rare.astype(np.int64)
    return np.repeat(heads, size), w.long(code1, cold1), w.long(code3, cold3), c3, learnt.astype(np.int64)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different keys in order, the place of each key among them)."""
    order, begins = runs(keys)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(keys))))
    return keys[order[begins]], rank


class Keys:
    """Contexts, words and their pairs in the places of a shard, each once: what is built on them and asked for is so many fewer."""

    def __init__(self, ctx: np.ndarray, w1: np.ndarray, w3: np.ndarray):
        (self.ctx, c), (self.w3, self.v), (self.w1, u) = ranked(ctx), ranked(w3), ranked(w1)
        wide3, wide1 = max(1, len(self.w3)), max(1, len(self.w1))
        pair, self.pair = ranked(c * wide3 + self.v)
        history, self.history = ranked(c * wide1 + u)
        (self.pair_c, self.pair_v), (self.history_c, self.history_u) = divmod(pair, wide3), divmod(history, wide1)


def within(k: Keys, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count of each pair, places after each context, how many words follow it), of the places given alone."""
    n_pair = np.bincount(k.pair, n, len(k.pair_c))
    return n_pair, np.bincount(k.pair_c, n_pair, len(k.ctx)), np.bincount(k.pair_c[n_pair > 0], minlength=len(k.ctx))


def over_classes(w: Words, k: Keys, n: np.ndarray, kinds: np.ndarray, told: list[tuple[str, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, where a context that is a class of a word has the counts of that word's pairs over all its classes.

    ``told`` are those pairs, (context, block of ``pack``), and pairs that stand at none of the places; what isn't among
    them was never seen. ``kinds`` is how many words follow each word that has classes.
    """
    n_pair, n_ctx, kinds2 = within(k, n)
    ids, code = w.contexts()
    c, own = np.flatnonzero(np.isin(k.ctx, ids)), np.zeros(len(k.ctx), bool)
    code, own[c] = code[np.searchsorted(ids, k.ctx[c])], True
    n_ctx[c], kinds2[c] = w.n[code], kinds[code]
    n_pair[own[k.pair_c]] = 0
    begins = np.searchsorted(k.pair_c, np.arange(len(k.ctx) + 1))
    for ctx, block in told:
        c = int(np.searchsorted(k.ctx, np.uint64(int(ctx))))
        if c == len(k.ctx) or k.ctx[c] != np.uint64(int(ctx)):
            continue
        code3, cold3, n3 = unpack(block)
        w3 = w.long(code3, cold3)
        order, asked = np.argsort(w3), k.w3[k.pair_v[begins[c] : begins[c + 1]]]
        at = np.searchsorted(w3, asked, sorter=order)
        hit = np.flatnonzero(at < len(w3))
        hit = hit[w3[order[at[hit]]] == asked[hit]]
        n_pair[begins[c] + hit] = n3[order[at[hit]]]
    return n_pair, n_ctx, kinds2


class Trie:
    """Contexts, the words after each, the words before each, and the triples of both, of counted places (ctx, w1, w3, n).

    Levels are Elias-Fano sequences: keys within a context stand as ranks past the context's own; pointers are the
    places at which a context's keys begin; a triple's last word is its place among the words after its context.
    Probabilities less their discount, and what the discounts leave for shorter contexts, are 16-bit steps.
    ``whole`` are the counts of pairs and contexts where these places aren't all there are of a context.
    """

    def __init__(self, k: Keys, n: np.ndarray, whole: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        seen = np.flatnonzero(n > 0)
        n_pair, n_ctx, kinds2 = whole or within(k, n)
        n_history = np.bincount(k.history, n, len(k.history_c))
        p, h = np.flatnonzero(n_pair > 0), np.flatnonzero(n_history > 0)
        level = lambda size, at: np.bincount(at, minlength=size) > 0
        in_c, in_v, in_u = n_ctx > 0, level(len(k.w3), k.pair_v[p]), level(len(k.w1), k.history_u[h])
        c_of, v_of, u_of = (np.cumsum(x) - 1 for x in (in_c, in_v, in_u))
        self.contexts, self.after, self.before = EliasFano(k.ctx[in_c]), EliasFano(k.w3[in_v]), EliasFano(k.w1[in_u])
        of_pair, of_history = c_of[k.pair_c[p]], c_of[k.history_c[h]]
        self.pairs, self.histories = EliasFano(of_pair * max(1, self.after.n) + v_of[k.pair_v[p]]), EliasFano(of_history * max(1, self.before.n) + u_of[k.history_u[h]])
        begin = np.searchsorted(of_pair, np.arange(self.contexts.n + 1))
        base = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.diff(begin)[of_history])))
        self.begins, self.bases = EliasFano(begin), EliasFano(base)
        p_of, h_of = np.cumsum(n_pair > 0) - 1, np.cumsum(n_history > 0) - 1
        at = h_of[k.history[seen]]
        triple, t = ranked(base[at] + p_of[k.pair[seen]] - begin[of_history[at]])
        self.triples = EliasFano(triple)
        n_triple, owner = np.bincount(t, n[seen], len(triple)), np.zeros(len(triple), np.int64)
        owner[t] = at
        n_ctx, kinds2, kinds3 = n_ctx[in_c], kinds2[in_c], np.bincount(owner, minlength=len(h))
        less = lambda x: np.maximum(x - DISCOUNT, 0)
        self.p2, self.rest2, self.p3, self.rest3 = mapped(*(quantised(x) for x in (less(n_pair[p]) / n_ctx[of_pair], np.minimum(DISCOUNT * kinds2 / n_ctx, 1), less(n_triple) / n_history[h][owner], np.minimum(DISCOUNT * kinds3 / n_history[h], 1))))

    def probability(self, k: Keys, p1: np.ndarray) -> np.ndarray:
        """P(w3 | w1, ctx) of each place: what is seen after both, after ctx alone, and ``p1`` of w3 alone, each by what the longer one leaves."""

        def value(q: np.ndarray, at: np.ndarray, none: float) -> np.ndarray:
            return np.where(at >= 0, restored(np.append(q, np.uint16(0))[at]), none)

        def search(level: EliasFano, c: np.ndarray, rank: np.ndarray, wide: int) -> np.ndarray:
            at, both = np.full(len(c), -1, np.int64), np.flatnonzero((c >= 0) & (rank >= 0))
            at[both] = level.find(c[both] * max(1, wide) + rank[both])
            return at

        c = self.contexts.find(k.ctx)
        s = search(self.pairs, c[k.pair_c], self.after.find(k.w3)[k.pair_v], self.after.n)
        h = search(self.histories, c[k.history_c], self.before.find(k.w1)[k.history_u], self.before.n)
        alone = np.zeros(len(k.w3))
        alone[k.v] = p1
        p2 = value(self.p2, s, 0.0) + value(self.rest2, c, 1.0)[k.pair_c] * alone[k.pair_v]
        # a triple's key is its pair's place past the first one of its context, past those of all histories before its own
        offset = np.zeros(len(s), np.int64)
        hit = np.flatnonzero(s >= 0)
        offset[hit] = s[hit] - self.begins.get(np.maximum(c, 0)).astype(np.int64)[k.pair_c[hit]] if self.contexts.n else 0
        base = self.bases.get(np.maximum(h, 0)).astype(np.int64)
        t, both = np.full(len(k.pair), -1, np.int64), np.flatnonzero((s[k.pair] >= 0) & (h[k.history] >= 0))
        asked, rank = ranked(base[k.history[both]] + offset[k.pair[both]])
        t[both] = self.triples.find(asked)[rank]
        return value(self.p3, t, 0.0) + value(self.rest3, h, 1.0)[k.history] * p2[k.pair]


def _shard(ctx: np.ndarray, shards: int) -> np.ndarray:
    return (words.mixed(ctx ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(shards)).astype(np.int64)


def _over(chunk: str, shards: int) -> int:
    return int(hashlib.blake2b(chunk.encode(), digest_size=6).hexdigest(), 16) % shards


PLACES, SUMS, ROWS, PAIRS = 0, 1, 2, 3  # kinds of blocks: places for a shard, a stretch's sums by row, a stretch's rows, pairs of a context


def counted_pairs(x: DataFrame, w: Words, clashes: np.ndarray, shards: int) -> DataFrame:
    """Rows (word, kinds, block) of the words that have classes: how many words follow it in ``x``, and how often the frequent ones do.

    Pairs are counted in each stretch, then by shards of pairs; a word's own list has at most as many as ``w`` has words.
    """
    many = len(w.classes)

    def listed(c2: np.ndarray, h3: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(one place of each different pair, its count)."""
        h, v = ranked(h3)
        order, begins = runs(c2.astype(np.int64) * max(1, len(h)) + v)
        return order[begins], np.add.reduceat(n[order], begins) if len(begins) else begins

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = Reader(b.column(0), b.column(1), words.BLANK, clashes, True)
            for lo in range(0, len(r.starts), STEP):
                hi, before = min(lo + STEP, len(r.starts)), min(lo, 1)
                h, row = r.ids(lo - before, hi), r.row[lo - before : hi]
                code = w.codes(h)
                i = np.flatnonzero((row[1:] == row[:-1]) & (code[:-1] < many))
                rep, n = listed(code[i], h[i + 1], np.ones(len(i), np.int64))
                c2, h3, code3 = code[i[rep]], h[i[rep] + 1], code[i[rep] + 1]
                rows = [(s, pack(c2[o], code3[o], h3[o][code3[o] == COLD], n[o].astype("u4"))) for s, o in dealt((words.mixed(h3 + words.mixed(c2.astype("u8"))) % np.uint64(shards)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([o for _, o in rows], pa.binary())], names=["shard", "block"])

    def table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["word", "kinds", "block"])

    def add(t: pa.Table) -> pa.Table:
        parts = [unpack(b) for b in t.column("block").to_pylist()]
        c2, h3, code3, n = (np.concatenate(a) for a in zip(*((c, w.long(code, cold), code, n.astype(np.int64)) for c, code, cold, n in parts), strict=True))
        rep, n = listed(c2, h3, n)
        c2, code3, out = c2[rep], code3[rep], []
        for word, own in dealt(c2.astype(np.int64)):
            hot = own[code3[own] != COLD]
            out.append((word, len(own), pack(code3[hot], n[hot].astype("u8"))))
        return table(out)

    def whole(t: pa.Table) -> pa.Table:
        code3, n = (np.concatenate(a) for a in zip(*map(unpack, t.column("block").to_pylist()), strict=True))
        order = np.argsort(code3)
        return table([(t.column("word")[0].as_py(), sum(t.column("kinds").to_pylist()), pack(code3[order], np.zeros(0, "u8"), n[order]))])

    rows = "word int, kinds long, block binary"
    return x.select("part", "text").mapInArrow(count, "shard int, block binary").groupBy("shard").applyInArrow(add, rows).groupBy("word").applyInArrow(whole, rows)


def lm_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score) of every row, the model learnt from those where ``learn`` holds.

    Words are lowered in A-Z and end with an end mark. The model interpolates triples, pairs and smoothed words by absolute
    discounting; a text's first word stands by itself. The places of a context that would fill more than half a shard are dealt
    by classes of the word before it; its pairs are counted over all classes first, so scores are those of the whole
    whatever is dealt. Shards are cut by context, so each holds
    whatever its probabilities need but the counts of the words themselves; those of the 262,143 most frequent words are with
    every task, the places of other words first go by the shards of the vocabulary. Within a stretch of about a million
    words a triple is sent once, with the rows that hold it, which are read a stretch at a time; sums come back by stretch. So one triple that
    fills the corpus costs its shard little; a pair that very many different words follow stays in one shard.

    Null text has the end mark alone. Repeated rows of one id and text give the same scores. Without rows to learn from all
    counts are 0 and every token has probability 1. Other columns aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    at = Scratch(spark, "language-model")
    x = docs.select(F.lit("").alias("part"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"))
    vocab, totals, clashes = vocabulary(x.where("learn"), at, words.BLANK, ended=True)
    tokens, kinds = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    w = Words(*frequent(vocab, HOT))
    shards, rare_shards = max(1, -(-tokens // SHARD)), partitions(spark)
    many = len(w.classes)
    kinds_after = np.zeros(many, np.int64)
    if many:
        pairs = at.put(counted_pairs(x.where("learn"), w, clashes, max(1, -(-int(w.n[:many].sum()) // SHARD))), "pairs")
        for word, k in pairs.select("word", "kinds").collect():
            kinds_after[word] = k
    list_type = pa.list_(docs.select(id_col).limit(0).toArrow().schema.field(0).type)
    names = ["shard", "kind", "chunk", "ids", "digests", "block"]

    def log1(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (tokens + 0.5 * (kinds + 1)))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int32(), pa.int32(), pa.string(), list_type, pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def sums(chunk: str, own: np.ndarray, doc: np.ndarray, c: np.ndarray, alone: np.ndarray) -> tuple:
        """Tokens, known ones, their scores alone, and those that have no other score, by row."""
        p = log1(c)
        return _over(chunk, shards), SUMS, chunk, None, None, pack(own.astype("u4"), *(np.bincount(doc, v, len(own)) for v in (np.ones(len(p)), (c > 0).astype(float), p, np.where(alone, p, 0.0))))

    def sent(chunk: str, places: Places) -> Iterator[tuple]:
        for k, i in dealt(_shard(places[0], shards)):
            yield k, PLACES, chunk, None, None, packed(tuple(a[i] for a in places))

    def scan(rare: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Blocks of all places whose last word is one of the frequent ones, or of those where it isn't."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task, number = TaskContext.get().partitionId(), 0
            for b in batches:
                r = Reader(b.column(0), b.column(1), words.BLANK, clashes, True)
                digests = [hashlib.blake2b(r.data[s:e], digest_size=16).digest() for s, e in zip(r.offsets[:-1], r.offsets[1:], strict=True)]
                own = hashlib.blake2b(b"".join(digests), digest_size=8).hexdigest()
                learnt = np.array(b.column(3).to_pylist(), bool)
                for lo in range(0, len(r.starts), STEP):
                    hi, number = min(lo + STEP, len(r.starts)), number + 1
                    chunk, first, last = f"{task}-{number}-{own}", int(r.row[lo]), int(r.row[hi - 1])
                    rows = list(stretch(r, lo, hi, learnt, chunk, rare))
                    ended = np.zeros(last - first + 1, np.int64)
                    if not rare:
                        ended[r.row[lo:hi][r.starts[lo:hi] == r.ends[lo:hi]] - first] = 1
                    rows.append((_over(chunk, rare_shards if rare else shards), ROWS, chunk, b.column(2).slice(first, last - first + 1).to_pylist(), b"".join(digests[first : last + 1]), pack(ended.astype("u1"))))
                    yield batch(rows)

        return run

    def stretch(r: Reader, lo: int, hi: int, learnt: np.ndarray, chunk: str, rare: bool) -> Iterator[tuple]:
        before = min(lo, 2)
        h, row = r.ids(lo - before, hi), r.row[lo - before : hi]
        code = w.codes(h)

        def past(k: int, of: np.ndarray, none: int) -> np.ndarray:
            out = np.full(len(h), none, of.dtype)
            out[k:] = np.where(row[k:] == row[:-k], of[:-k], none)
            return out[before:]

        w1, w2, code1, code2, w3, code3, row = past(2, h, 0), past(1, h, 0), past(2, code, COLD), past(1, code, COLD), h[before:], code[before:], row[before:]
        doc, some = (row - row[0]).astype(np.uint64), (code3 == COLD) == rare
        ctx = np.where(w2 > 0, w.context(w2, code2, w1), np.uint64(0))
        if rare:
            own = np.flatnonzero(some)
            for k, i in dealt(np.mod(w3[own].view(np.int64), rare_shards)):
                i = own[i]
                i = i[np.argsort(w3[i], kind="stable")]
                yield k, PLACES, chunk, None, None, pack(w3[i], code2[i], w2[i][code2[i] == COLD], code1[i], w1[i][code1[i] == COLD], doc[i].astype("u4"), learnt[row[i]])
        else:
            c3 = np.append(w.n, 0)[np.minimum(code3, len(w.n))]
            own = np.flatnonzero(some & (w2 > 0))
            yield from sent(chunk, (ctx[own], w1[own], code1[own], w3[own], code3[own], c3[own], doc[own], learnt[row[own]]))
            yield sums(chunk, np.arange(int(doc[-1]) + 1), doc[some].astype(np.int64), c3[some], w2[some] == 0)

    def look_up(t: pa.Table, v: pa.Table) -> pa.Table:
        """Counts of rare words at their places: sums of the words alone, and blocks of all stretches for the trie's shards.

        A known word's id is its place in the vocabulary from here on, all unknown ones are one.
        """
        h, n = v.column("h").to_numpy().astype(np.int64).view(np.uint64), v.column("n").to_numpy().astype(np.int64)
        order = np.argsort(h)
        h, n, rows, chunks, parts = np.append(h[order], np.uint64(0)), np.append(n[order], 0), [], [], []
        own_shard = v.column("shard")[0].as_py() if len(v) else 0
        for kind, chunk, ids, digests, block in zip(*(t.column(c).to_pylist() for c in names[1:]), strict=True):
            if kind != PLACES:
                rows.append((_over(chunk, shards), kind, chunk, ids, digests, block))
                continue
            w3, code2, rare2, code1, rare1, doc, learnt = unpack(block)
            w1, w2 = w.long(code1, rare1), w.long(code2, rare2)
            place = np.searchsorted(h[:-1], w3)
            known = h[place] == w3
            c3 = np.where(known, n[place], 0)
            own, d = np.unique(doc, return_inverse=True)
            rows.append(sums(chunk, own, d, c3, w2 == 0))
            i = np.flatnonzero(w2 > 0)
            short = np.where(known, (place * rare_shards + own_shard + 1), 0).astype(np.uint64)
            parts.append((w.context(w2, code2, w1)[i], w1[i], code1[i], short[i], np.full(len(i), COLD, "u4"), c3[i], doc[i] | np.uint64(len(chunks) << 32), learnt[i], code2[i]))
            chunks.append(chunk)
        if parts:
            *places, code2 = (np.concatenate(p) for p in zip(*parts, strict=True))
            rows += sent("|".join(chunks), tuple(places))
            own = np.flatnonzero(code2 < many)
            rows += rare_pairs(places[0][own], code2[own], places[3][own], places[7][own])
        return pa.Table.from_batches([batch(rows)])

    def rare_pairs(ctx: np.ndarray, code2: np.ndarray, short: np.ndarray, learnt: np.ndarray) -> Iterator[tuple]:
        """For each class that asks for them, pairs of words that have classes and rare words, all of whose places are here."""
        ids, v = ranked(short)
        pair, of = ranked(code2.astype(np.int64) * max(1, len(ids)) + v)
        n = np.bincount(of, learnt, len(pair)).astype("u8")
        seen = np.flatnonzero(n[of] > 0)
        of = of[seen]
        for _, i in dealt(np.searchsorted(w.contexts()[0], ctx[seen])):
            each = np.unique(of[i])
            c = ctx[seen[i[0]]]
            yield int(_shard(c[None], shards)[0]), PAIRS, str(c), None, None, pack(np.full(len(each), COLD, "u4"), ids[pair[each] % len(ids)], n[each])

    def answer(t: pa.Table) -> pa.Table:
        """Build a shard's trie from the places to learn from, and add up the scores of all its places by stretch and row."""
        t = t.select(names)
        kind = t.column("kind").to_numpy()
        own, others, told = (np.flatnonzero(x) for x in (kind == PLACES, (kind == SUMS) | (kind == ROWS), kind == PAIRS))
        if not len(own):
            return t.take(pa.array(others))
        places = t.take(pa.array(own))
        blocks = places.column("block")
        parts = list(map(list, zip(*(unpacked(w, b.as_py()) for b in blocks), strict=True)))
        ends = np.cumsum([len(b) for b in parts[0]])
        ctx, w1, w3, c3, n = (np.concatenate(parts.pop(0)) for _ in range(5))  # a column's parts go as it is put together
        k = Keys(ctx, w1, w3)
        del ctx, w1, w3
        told = t.take(pa.array(told))
        told = list(zip(told.column("chunk").to_pylist(), told.column("block").to_pylist(), strict=True))
        p = np.log10(Trie(k, n, over_classes(w, k, n, kinds_after, told)).probability(k, 10 ** log1(c3)))
        del k, n, c3, told
        number: dict[str, int] = {}
        refs, scores, begin = [], [], 0
        for chunk, b, end in zip(places.column("chunk").to_pylist(), blocks, ends, strict=True):  # the rows of one block at a time
            of = np.array([number.setdefault(c, len(number)) for c in chunk.split("|")], np.uint64)
            times, doc = standing(b.as_py())
            ref, doc = ranked(of[doc >> np.uint64(32)] << np.uint64(32) | doc & np.uint64(0xFFFFFFFF))
            refs.append(ref)
            scores.append(np.bincount(doc, np.repeat(p[begin:end], times), len(ref)))
            begin = end
        ref, at_ = ranked(np.concatenate(refs))
        score, rows, chunks = np.bincount(at_, np.concatenate(scores), len(ref)), [], list(number)
        for i, own in dealt((ref >> np.uint64(32)).astype(np.int64)):
            none = np.zeros(len(own))
            rows.append((0, SUMS, chunks[i], None, None, pack((ref[own] & np.uint64(0xFFFFFFFF)).astype("u4"), none, none, none, score[own])))
        return pa.concat_tables([t.take(pa.array(others)), pa.Table.from_batches([batch(rows)])])

    def gather(t: pa.Table) -> pa.Table:
        """A stretch's sums by row, under the rows' ids and digests."""
        kinds_, blocks = t.column("kind").to_pylist(), t.column("block").to_pylist()
        head = kinds_.index(ROWS)
        ids, digests = t.column("ids")[head].as_py(), t.column("digests")[head].as_py()
        ended = np.max([unpack(b)[0] for kind, b in zip(kinds_, blocks, strict=True) if kind == ROWS], axis=0)
        total = np.zeros((4, len(ids)))
        for kind, block in zip(kinds_, blocks, strict=True):
            if kind == SUMS:
                own, *more = unpack(block)
                for s, m in zip(total, more, strict=True):
                    s[own] += m
        return pa.table([pa.array(ids, list_type.value_type), pa.array([digests[16 * i : 16 * i + 16] for i in range(len(ids))], pa.binary()), pa.array(ended.astype(np.int64)), *map(pa.array, total)], names=["id", "digest", "copies", *_SUMS])

    kind = docs.schema[id_col].dataType.simpleString()
    block = f"shard int, kind int, chunk string, ids array<{kind}>, digests binary, block binary"
    v = vocab.select(F.expr(f"cast(pmod(h, {rare_shards}) as int)").alias("shard"), "h", "n")
    looked = x.mapInArrow(scan(True), block).groupBy("shard").cogroup(v.groupBy("shard")).applyInArrow(look_up, block)
    places = x.mapInArrow(scan(False), block).unionByName(looked)
    if many:
        ids, code = w.contexts()
        classes = spark.createDataFrame(pa.table({"word": pa.array(code, pa.int32()), "shard": pa.array(_shard(ids, shards), pa.int32()), "chunk": pa.array([str(i) for i in ids], pa.string())}))
        places = places.unionByName(pairs.join(F.broadcast(classes), "word").select("shard", F.lit(PAIRS).alias("kind"), "chunk", F.lit(None).cast(f"array<{kind}>").alias("ids"), F.lit(None).cast("binary").alias("digests"), "block"))
    answers = places.groupBy("shard").applyInArrow(answer, block)
    rows = answers.groupBy("chunk").applyInArrow(gather, f"id {kind}, digest binary, copies long, " + ", ".join(f"{c} double" for c in _SUMS))
    rows = rows.groupBy("id", "digest").agg(F.sum("copies").alias("copies"), *[F.sum(c).alias(c) for c in _SUMS])
    whole = lambda c: F.round(F.col(c) / F.col("copies")).cast("long").alias(c)
    each = lambda c, name: (F.col(c) / F.col("copies")).alias(name)
    out = rows.select(F.col("id").alias(id_col), whole("n_tokens"), whole("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), each("base", "base_score"), each("score", "score"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"))
    return out.drop("_copy")


_SUMS = ("n_tokens", "n_known", "base", "score")
