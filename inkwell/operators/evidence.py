"""Alignment of quotes with documents, grounding labels, interval merging."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..sources.package import ship

SEED_WORDS = 6
TOGETHER = 1_000_000  # characters of texts that are judged side by side


def grounding_label(score: Column, grounded: float = 90.0, partial: float = 78.0) -> Column:
    return F.when(score >= grounded, "grounded").when(score >= partial, "partial").otherwise("ungrounded")


def align_exact(docs: DataFrame, quotes: DataFrame, d_id: str = "doc_id", q_id: str = "item_id", least: int = 12) -> DataFrame:
    """Rows (d_id, q_id, start, end, label): the first place of each quote in each document's normal form, 0-based and half-open.

    Pairs meet by a run of the quote's inner words, an equi-join on run fingerprints, instead of a test of every pair:
    six words, or one where the quote has fewer than eight. Only quotes of one or two words are looked for in every
    document. Neither side is broadcast unless its measured size allows it.
    """
    q = quotes.select(q_id, normalize(F.col("text")).alias("quote")).where(F.length("quote") >= least)
    words = F.split("quote", " ")
    # the last of the words may go on in the document, the first may begin within a word: neither is part of the seed
    size = F.when(F.size(words) >= SEED_WORDS + 2, SEED_WORDS).when(F.size(words) >= 3, 1)
    q = q.withColumn("seed", F.when(size.isNotNull(), F.xxhash64(F.array_join(F.slice(words, F.lit(2), size), " "))))
    d = docs.select(d_id, normalize(F.col("text")).alias("norm"))
    w = d.select(d_id, F.split("norm", " ").alias("w"))
    shifted = [F.slice("w", F.lit(i + 1), F.size("w")) for i in range(SEED_WORDS)]
    run = lambda s: F.xxhash64(F.concat_ws(" ", *[s[str(i)] for i in range(SEED_WORDS)]))
    runs = w.select(d_id, F.explode(F.array_distinct(F.concat(F.transform(F.arrays_zip(*shifted), run), F.transform("w", lambda x: F.xxhash64(x))))).alias("seed"))
    found = runs.join(q.where("seed is not null"), "seed").select(d_id, q_id, "quote").distinct().join(d, d_id)
    short = d.join(q.where("seed is null").select(q_id, "quote"), F.expr("contains(norm, quote)")).select(d_id, q_id, "quote", "norm")
    at = found.select(d_id, q_id, "quote", "norm").unionByName(short).withColumn("p", F.expr("locate(quote, norm)")).where("p > 0")
    return at.select(d_id, q_id, (F.col("p") - 1).cast("long").alias("start"), (F.col("p") - 1 + F.length("quote")).cast("long").alias("end"), grounding_label(F.lit(100.0)).alias("label"))


def merge_intervals(spans: DataFrame, key: str, slack: int = 2) -> DataFrame:
    """Rows (key, merged_no, start, end): spans that touch or are up to ``slack`` apart become one."""
    w = Window.partitionBy(key).orderBy("start", "end")
    x = spans.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("merged_no", F.sum(F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + slack), 1).otherwise(0)).over(w).cast("long"))
    return x.groupBy(key, "merged_no").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def flattened(text: str) -> tuple[str, list[int]]:
    """White space runs as one space, and each character's place in the text; one place more for its end."""
    places = [i for i, c in enumerate(text) if not (c.isspace() and i and text[i - 1].isspace())]
    return "".join(" " if text[i].isspace() else text[i] for i in places), [*places, len(text)]


def _common(masks: dict[str, int], m: int, window: str) -> int:
    """Length of the longest common subsequence with a text of m characters, given as a bit mask for each character."""
    full = (1 << m) - 1
    row = full
    for c in window:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return m - row.bit_count()


def best_window(quote: str, text: str, starts: list[int]) -> tuple[int, float]:
    """(start, score 0 to 100) of the window of the quote's length most like it among ``starts``, the first of equals."""
    masks: dict[str, int] = {}
    for i, c in enumerate(quote):
        masks[c] = masks.get(c, 0) | 1 << i
    m, best = len(quote), (0, -1.0)
    for s in starts:
        window = text[s : s + m]
        score = 200 * _common(masks, m, window) / (m + len(window))
        if score > best[1]:
            best = (s, score)
    return best


def align_fuzzy(docs: DataFrame, quotes: DataFrame, d_id: str = "doc_id", q_id: str = "item_id", least: int = 12, cutoff: float = 78.0, run: int = 3) -> DataFrame:
    """Rows (d_id, q_id, start, end, score, label): the most similar place of each quote in each document, from ``cutoff`` on.

    Places are those of the document's own text, white space and all. Pairs meet by ``run`` words in a row, an equi-join
    on their fingerprints that carries where they stand; windows of the quote's length around there are compared by
    their longest common subsequence. A quote with an edit in every run is not found. Null texts hold nothing.
    """
    ship(docs.sparkSession)
    words = lambda c: F.split(F.lower(normalize(F.col(c))), " ")

    def runs(df: DataFrame, key: str, at: str) -> DataFrame:
        x = df.where(F.col("text").isNotNull()).select(key, words("text").alias("w"))
        starts = F.aggregate("w", F.struct(F.lit(0).alias("n")), lambda acc, w: F.struct((acc["n"] + F.length(w) + 1).alias("n")))["n"]
        x = x.where(starts >= least).select(key, F.posexplode("w").alias("i", "x"))
        w = Window.partitionBy(key).orderBy("i")
        place = F.coalesce(F.sum(F.length("x") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
        seed = F.xxhash64(*[F.lead("x", k).over(w) for k in range(run)])
        return x.select(key, place.alias(at), seed.alias("seed"), F.lead("x", run - 1).over(w).alias("full")).where("full is not null").drop("full")

    met = runs(docs, d_id, "p").join(runs(quotes, q_id, "r"), "seed").groupBy(d_id, q_id).agg(F.collect_set(F.col("p") - F.col("r")).alias("lines"))
    pairs = met.join(docs.select(d_id, "text"), d_id).join(quotes.select(q_id, F.col("text").alias("quote")), q_id).select(F.col(d_id).alias("d"), F.col(q_id).alias("q"), "text", "quote", "lines")

    def compare(parts):
        import pandas as pd

        for part in parts:
            out = []
            for d, q, text, quote, lines in part.itertuples(index=False):
                flat, places = flattened(text)
                lead = len(flat) - len(flat.lstrip())
                quote = " ".join(quote.split())
                if len(quote) < least:
                    continue
                slack = max(1, len(quote) // 8)
                starts = sorted({s for x in lines for s in range(max(0, x + lead - slack), min(len(flat), x + lead + slack + 1))})
                s, score = best_window(quote, flat, starts)
                if score >= cutoff:
                    out.append((d, q, places[s], places[min(s + len(quote), len(flat))], round(score, 1)))
            yield pd.DataFrame(out, columns=["d", "q", "start", "end", "score"])

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((docs, d_id), (quotes, q_id))]
    found = pairs.mapInPandas(compare, f"d {kinds[0]}, q {kinds[1]}, start long, end long, score double")
    return found.select(F.col("d").alias(d_id), F.col("q").alias(q_id), "start", "end", "score", grounding_label(F.col("score"), 90.0, cutoff).alias("label"))


def stretches(pairs: list[tuple[str, str]], cutoff: float) -> list[list[tuple[int, int]]]:
    """For each (quote, text): stretches (from, to) of starts at which a window of the quote's length may reach ``cutoff``, in order.

    Half a quote's starts are judged at once by the common subsequence with the text that all their windows lie in, which
    none of them passes; bits of a subsequence stand in 64-bit words, all stretches of quotes of one length side by side.
    """
    import numpy as np

    out: list[list[tuple[int, int]]] = [[] for _ in pairs]
    by_size: dict[int, list[int]] = {}
    for i, (quote, _) in enumerate(pairs):
        by_size.setdefault(len(quote), []).append(i)
    points = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    for m, own in by_size.items():
        step, n_words = max(1, m // 2), -(-m // 64)
        wide, masks, places, ends, at = m + step - 1, [[] for _ in range(n_words)], [], [], 0
        for i in own:
            quote, text = points(pairs[i][0]), points(pairs[i][1])
            letters, of = np.unique(quote, return_inverse=True)
            rank = np.minimum(np.searchsorted(letters, text), len(letters) - 1)
            rank = np.where(letters[rank] == text, rank, len(letters))
            for w in range(n_words):
                bits = np.zeros(len(letters) + 1, "u8")
                part = of[64 * w : 64 * w + 64]
                np.bitwise_or.at(bits, part, np.uint64(1) << np.arange(len(part), dtype="u8"))
                masks[w].append(np.append(bits[rank], np.zeros(wide, "u8")))
            starts = np.arange(0, len(text) - m + 1, step)
            places.append(starts + at)
            ends.append(len(starts))
            at += len(text) + wide
        mask, place = [np.concatenate(x) for x in masks], np.concatenate(places)
        rows = [np.full(len(place), ~np.uint64(0)) for _ in range(n_words)]
        for j in range(wide):
            carry = None
            for w in range(n_words):
                row = rows[w]
                hit = row & mask[w][place + j]
                total = row + hit
                over = total < row
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype("u8")
                rows[w] = total | (row - hit)
        full = [np.uint64((1 << min(64, m - 64 * w)) - 1) for w in range(n_words)]
        common = m - sum(np.bitwise_count(r & f).astype(np.int64) for r, f in zip(rows, full))
        able, begin = 100 * common / m >= cutoff - 1e-9, 0
        for i, n in zip(own, ends):
            last = len(pairs[i][1]) - m + 1
            out[i] = [(k * step, min(last, (k + 1) * step)) for k in np.flatnonzero(able[begin : begin + n]).tolist()]
            begin += n
    return out


def best_place(quote: str, text: str, cutoff: float, among: list[tuple[int, int]] | None = None) -> tuple[int, int, float] | None:
    """(start, end, score) of the window of ``text`` most like ``quote``, the first of equals; None where all are below ``cutoff``.

    Windows have the quote's length; before the text's start and past its end they are cut. No window is left out: from one
    to the next the common subsequence grows by one at most, so where it lacks k, the next k - 1 windows can't reach
    what is needed; ``among`` has the stretches of starts that may, where they are known. A text shorter than the quote is looked for in the quote, and counts as a whole.
    """
    if not quote or not text:
        return None
    if (at := text.find(quote)) >= 0:
        return at, at + len(quote), 100.0
    if len(text) < len(quote):
        turned = best_place(text, quote, cutoff)
        return turned and (0, len(text), turned[2])
    m, best = len(quote), (cutoff, 1, 0, 0)  # score, minus start (first of equals), start, end
    masks: dict[str, int] = {}
    for i, c in enumerate(quote):
        masks[c] = masks.get(c, 0) | 1 << i
    found = False

    def common(start: int, end: int) -> int:
        """The window's common subsequence; the window is kept where it is the best."""
        nonlocal best, found
        c = _common(masks, m, text[start:end])
        score = 200 * c / (m + end - start)
        if score >= best[0] and (not found or score > best[0] or start < best[2]):
            best, found = (score, 0, start, end), True
        return c

    s = 0
    for begin, end in [(0, len(text) - m + 1)] if among is None else among:
        s = max(s, begin)
        while s < end:
            c = common(s, s + m)
            s += max(1, math.ceil(best[0] * 2 * m / 200 - 1e-9) - c)
    least = max(int(cutoff * m / (200 - cutoff)), 1)  # a shorter window can't reach the cutoff
    for head in (True, False):
        n = m - 1
        while n >= least:
            c = common(0, n) if head else common(len(text) - n, len(text))
            n = min(n - 1, int(200 * c / max(best[0], 1e-9) + 1e-6) - m)  # a shorter window shares no more, and can't be longer than that for it
    return (best[2], best[3], best[0]) if found else None


def align_pairs(pairs: DataFrame, key: list[str], cutoff: float = 78.0, least: int = 12) -> DataFrame:
    """Rows (key, quote, start, end, score, label) for stated pairs (key, quote, text): the most similar place, if any reaches ``cutoff``.

    Places are those of the text itself, white space and all; a score is 200 times the longest common subsequence over both
    lengths. Every window is taken into account, whatever the edits: nothing that reaches the cutoff is missed. Equal
    pairs are aligned once, pairs apart from each other. Quotes under ``least`` characters and null or empty texts give no rows.
    """
    ship(pairs.sparkSession)
    x = pairs.where("quote is not null and text is not null").select(*key, "quote", "text").dropDuplicates([*key, "quote"])
    x = x.repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key, "quote")  # few bytes, much work: not to be gathered
    kinds = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for c in key)

    def run(parts):
        import pandas as pd

        for part in parts:
            out, some, size = [], [], 0

            def looked() -> None:
                known = iter(stretches([(bare, flat) for _, _, bare, flat, _, long in some if long], cutoff))
                for k, quote, bare, flat, text, long in some:
                    if hit := best_place(bare, flat, cutoff, next(known) if long else None):
                        places = flattened(text)[1]
                        out.append((*k, quote, places[hit[0]], places[min(hit[1], len(flat))], round(hit[2], 1)))
                some.clear()

            for *k, quote, text in part.itertuples(index=False):
                bare = " ".join(quote.split())
                if len(bare) < least:
                    continue
                flat = re.sub(r"\s+", " ", text)
                some.append((k, quote, bare, flat, text, 0 < len(bare) <= len(flat) <= TOGETHER and bare not in flat))
                if (size := size + len(flat)) > TOGETHER:
                    looked()
                    size = 0
            looked()
            yield pd.DataFrame(out, columns=[*key, "quote", "start", "end", "score"])

    found = x.mapInPandas(run, f"{kinds}, quote string, start long, end long, score double")
    return found.withColumn("label", grounding_label(F.col("score"), 90.0, cutoff))


def in_original(pairs: DataFrame, text: str, quote: str) -> DataFrame:
    """Add ``start`` and ``end`` of the quote's first place in the text itself, where any white space stands for a space; null if it isn't there."""
    pattern = F.concat(F.lit(r"\Q"), F.regexp_replace(F.regexp_replace(F.trim(quote), r"\\E", ""), r"\s+", r"\\E\\s+\\Q"), F.lit(r"\E"))
    at = F.regexp_instr(F.col(text), pattern)
    size = F.length(F.call_function("regexp_extract", F.col(text), pattern, F.lit(0)))
    return pairs.withColumn("start", F.when(at > 0, at - 1).cast("long")).withColumn("end", F.when(at > 0, at - 1 + size).cast("long"))
