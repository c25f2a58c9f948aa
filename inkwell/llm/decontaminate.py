"""Operator 9: benchmark decontamination by SimHash over item-sized windows."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .shingles import batches_of, mix, runs, words_of

SIZE = 5  # words in a shingle
SIMILARITY = 0.8
BITS, BLOCKS = 128, 16  # of a fingerprint; each block is a byte
RADIUS = 2 * BLOCKS - 1  # the largest at which some block differs in one bit at most
ITEMS, ITEM_BYTES = 16_384, 8 << 20  # bounds on the benchmark items that a pass sends to all tasks

_NEAR = np.array([[b ^ m for m in (0, *(1 << i for i in range(8)))] for b in range(256)])
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """Bits of each shingle as +1 and -1."""
    raw = np.stack([mix(shingles), mix(shingles + np.uint64(1))], axis=1)
    return np.unpackbits(raw.view(np.uint8).reshape(-1, 16), axis=1).astype(np.int32) * 2 - 1


def fingerprints(shingles: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """SimHash (rows of BLOCKS bytes) of the ``count`` shingles from each start on."""
    sums = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(_signs(shingles), axis=0, out=sums[1:])
    return np.packbits(sums[starts + count] - sums[starts] > 0, axis=1)


class Index:
    """Benchmark items by length in words; those of one length have a table for each block of their fingerprints."""

    def __init__(self, items: list[tuple[int, bytes]]):
        words, at = words_of([t for _, t in items])
        self.ids, self.bags, self.prints, self.by_length = [], [], [], defaultdict(list)
        seeds = defaultdict(list)
        for i, (item, _) in enumerate(items):
            own = words[at[i] : at[i + 1]]
            if len(own):
                bag = runs(own, SIZE)
                self.by_length[len(own)].append(len(self.ids))
                seeds[min(SIZE, len(own))].append((bag, len(own)))
                self.ids.append(item)
                self.bags.append(Counter(bag.tolist()))
                self.prints.append(fingerprints(bag, np.zeros(1, np.int64), len(bag))[0])
        # for each shingle size, the items' shingles in order and the lengths of items that have them
        self.seeds = {}
        for size, bags in seeds.items():
            owners = defaultdict(set)
            for bag, n in bags:
                for h in bag.tolist():
                    owners[h].add(n)
            keys = np.array(sorted(owners), np.uint64)
            self.seeds[size] = keys, [sorted(owners[h]) for h in keys.tolist()]
        self.tables = {n: self._table(rows) for n, rows in self.by_length.items()}

    def _table(self, rows: list[int]) -> tuple[np.ndarray, list[dict[int, list[int]]]]:
        prints = np.array([self.prints[r] for r in rows], np.uint8)
        blocks: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(BLOCKS)]
        for j, p in enumerate(prints):
            for k, byte in enumerate(p):
                blocks[k][int(byte)].append(j)
        return prints, blocks

    def within(self, n: int, window: np.ndarray) -> list[int]:
        """Items of n words whose fingerprints are within RADIUS of the window's: looked up block by block, then measured."""
        prints, blocks = self.tables[n]
        found = {j for k, byte in enumerate(window) for b in _NEAR[byte] for j in blocks[k].get(int(b), ())}
        return [self.by_length[n][j] for j in found if _ONES[prints[j] ^ window].sum() <= RADIUS]

    def touched(self, words: np.ndarray, at: np.ndarray) -> list[int]:
        """Which of the texts in a row share a shingle with an item."""
        hit = np.zeros(len(words) + 1, bool)
        for size, (keys, _) in self.seeds.items():
            if len(words) >= size:
                own = runs(words, size)
                place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit[: len(own)] |= keys[place] == own
        seen = np.concatenate([[0], np.cumsum(hit)])
        return [i for i in range(len(at) - 1) if at[i + 1] > at[i] and seen[at[i + 1]] > seen[at[i]]]

    def search(self, words: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item that the text holds, the first of equals.

        Only windows that share a shingle with some item of their length are fingerprinted; no other can be similar.
        """
        best: dict[int, tuple[float, int, int]] = {}
        starts: dict[int, set[int]] = defaultdict(set)
        total = len(words)
        for size, (keys, lengths) in self.seeds.items():
            own = runs(words, size) if total >= size else words[:0]
            place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            for j in np.flatnonzero(keys[place] == own).tolist():
                for n in lengths[place[j]]:
                    starts[n].update(range(max(0, j - n + size), max(0, min(j, total - n)) + 1))
        for n, at in starts.items():
            size = min(SIZE, n, total)
            own, at = runs(words, size), np.array(sorted(at))
            count = min(n, total) - size + 1
            for group in np.split(at, np.flatnonzero(np.diff(at) > n) + 1):
                near = own[group[0] : group[-1] + count]
                for start, print_ in zip(group, fingerprints(near, group - group[0], count), strict=True):
                    for r in self.within(n, print_):
                        bag = Counter(own[start : start + count].tolist())
                        both = sum((bag & self.bags[r]).values())
                        s = both / (count + sum(self.bags[r].values()) - both)
                        if s >= SIMILARITY and (r not in best or s > best[r][0]):
                            best[r] = (s, int(start), min(n, total))
        for r, (s, start, n) in sorted(best.items()):
            yield self.ids[r], s, start, n


def _blocks_of_items(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded size; a longer item is a block of its own."""
    block, held = [], 0
    rows = items.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").distinct().orderBy("i", "t")
    for r in rows.toLocalIterator():
        block.append((r["i"], r["t"].encode()))
        held += len(block[-1][1])
        if len(block) >= ITEMS or held >= ITEM_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (id, item id, similarity, first_word, n_words): items that a document holds, each with its best window.

    A window has as many words as the item (all, if the document has fewer); similarity is that of their bags of
    five-word shingles, the sum of the lesser over that of the greater counts, and at least 0.8. The whole of every
    text is searched. Null or empty texts and items hold nothing. Documents of a null id are searched as others;
    repeated rows give repeated rows; items that repeat with their id count once. Other columns are not read; an empty
    table on either side gives an empty one. Items are sent to the tasks in blocks, a pass over the documents each.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = f"`{id_col}` long, `{item_col}` long, similarity double, first_word long, n_words long"
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for block in _blocks_of_items(items, item_col, item_text_col):
        handle = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            index = Index(handle.value)
            for b in batches:
                ids, rows = b.column(0).to_pylist(), []
                for first, texts in batches_of(b.column(1)):
                    words, at = words_of(texts)
                    touched = index.touched(words, at)
                    rows += [(ids[first + i], *r) for i in touched for r in index.search(words[at[i] : at[i + 1]])]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[id_col, item_col, "similarity", "first_word", "n_words"])

        out = out.unionByName(source.mapInArrow(run, schema))
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item; all columns stay as they are.

    A row goes by its text alone, so ids may be null or recur. Null and empty texts hold nothing and stay; of repeated
    rows all go or all stay; an empty table on either side leaves ``docs`` as it is.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    texts = docs.select(key.alias("_key"), F.col(text_col).cast("string").alias("_text"))
    held = contamination(texts, items, "_key", "_text", item_col, item_text_col).select("_key").distinct()
    names = [f"_c{i}" for i in range(len(docs.columns))]
    kept = docs.toDF(*names).join(held, F.xxhash64(F.coalesce(F.col(names[docs.columns.index(text_col)]).cast("string"), F.lit(""))) == F.col("_key"), "left_anti")
    return kept.toDF(*docs.columns)
