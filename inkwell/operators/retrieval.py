"""Dense retrieval for many questions at once, term counts, fusion and precision filters."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_tokens, stem
from ..sources.package import ship

K1, B = 1.5, 0.75
VECTORS, QUERIES, CELLS = 65_536, 16_384, 4_000_000  # vectors and queries that meet in one block at most, and scores held at once
BLOCKS = 48  # blocks at least, so that few vectors keep all cores busy


def top_k(hits: DataFrame, query: str, item: str, score: str, k: int, then: tuple[str, ...] = ()) -> DataFrame:
    """The k best items of each query, ties by id, then by ``then``; adds ``rnk``."""
    w = Window.partitionBy(query).orderBy(F.desc(score), item, *then)
    return hits.withColumn("rnk", F.row_number().over(w).cast("long")).where(F.col("rnk") <= k)


def term_counts(corpus: DataFrame, d_id: str, text: str = "text") -> DataFrame:
    """Rows (d_id, dl, t, tf): stemmed tokens of each document and its number of tokens; t is null, tf 0 for one without any.

    Words are counted first and each distinct word is stemmed once.
    """
    d = corpus.select(d_id, plain_tokens(F.coalesce(F.col(text), F.lit(""))).alias("ws")).withColumn("dl", F.size("ws"))
    words = d.select(d_id, "dl", F.explode_outer("ws").alias("w")).groupBy(d_id, "dl", "w").agg(F.count("w").alias("n"))
    stems = words.where("w is not null").groupBy("w").agg(F.max(F.col("n") > 0)).select("w", stem(F.col("w")).alias("t"))
    return words.join(stems, "w", "left").groupBy(d_id, "dl", "t").agg(F.sum("n").alias("tf"))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def dense(queries: DataFrame, corpus: DataFrame, q_id: str, d_id: str) -> DataFrame:
    """Rows (q_id, d_id, score): inner products of a stated query set (q_id, q) with every vector (d_id, embedding)."""
    return corpus.join(queries, F.lit(True)).select(q_id, d_id, F.round(inner_product(F.col("q"), F.col("embedding")), 6).alias("score"))


def rounded(c: Column, places: int) -> Column:
    """A double to so many decimals as SQL engines have it: the scaled double's half goes away from zero. ``F.round`` takes the halves of the written number."""
    scale = float(10**places)
    return F.round(c * scale, 0) / scale


def _rounded(s):
    """Doubles to six decimals as ``round`` has them: halves of the written number away from zero."""
    import numpy as np

    y = np.abs(s) * 1e6
    whole = np.floor(y + 0.5)
    out = np.copysign(whole / 1e6, s)
    for i in np.flatnonzero((np.abs(y + 0.5 - np.round(y + 0.5)) < 1e-5) | (y > 1e9)):
        if np.isfinite(s[i]):
            out[i] = float(Decimal(repr(float(s[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out + 0.0


def nearest(queries: DataFrame, corpus: DataFrame, q_id: str, d_id: str, k: int, within: str | None = None, query: str = "q", vector: str = "embedding") -> DataFrame:
    """Rows (q_id, d_id, within, score): the k best of ``dense`` for each query, ties by id; of each value of ``within`` where that is given.

    Blocks of vectors meet blocks of queries, one matrix product each, and only a block's k best leave it. What lies within the
    rounding of a block's k-th best is scored anew by ``dense``'s order of sums, so that rows are those that it gives. Null vectors aren't near anything.
    """
    spark = corpus.sparkSession
    ship(spark)
    c = corpus.where(F.col(vector).isNotNull()).select(F.col(d_id).alias("d"), *([F.col(within).alias("g")] if within else []), F.col(vector).alias("v"))
    q = queries.where(F.col(query).isNotNull()).select(F.col(q_id).alias("q"), F.col(query).alias("v"))
    n, m = c.count(), q.count()
    cs = max(1, -(-n // VECTORS))
    qs = max(1, -(-m // QUERIES), min(-(-BLOCKS // cs), -(-m // 16)))
    part = lambda c, size: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    c = c.select("*", part("d", cs).alias("cb"), every(qs).alias("qb")).repartition(cs * qs, "cb", "qb")  # few bytes, much work: not to be gathered
    q = q.select("*", part("q", qs).alias("qb"), every(cs).alias("cb")).repartition(cs * qs, "cb", "qb")
    names = ["q", "d", *(["g"] if within else [])]
    kinds = {x: (q if x == "q" else c).schema[x].dataType.simpleString() for x in names}

    def best(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def matrix(t):
            v = t["v"].combine_chunks()
            v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
            return np.asarray(v.flatten().to_numpy(zero_copy_only=False), "f8").reshape(t.num_rows, -1)

        out = {x: left.schema.field(x).type if x != "q" else right.schema.field("q").type for x in names}
        schema = pa.schema([*out.items(), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        order = pc.sort_indices(left, [*([("g", "ascending")] if within else []), ("d", "ascending")])
        left = left.take(order)
        e, a = matrix(left), matrix(right)
        ends = [0, len(e)]
        if within:
            g = left["g"].combine_chunks().dictionary_encode(null_encoding="encode")
            g = g.combine_chunks() if isinstance(g, pa.ChunkedArray) else g
            ends = [0, *(np.flatnonzero(np.diff(g.indices.to_numpy(zero_copy_only=False))) + 1).tolist(), len(e)]
        slack = 2e-6 + 1e-15 * e.shape[1] * np.sqrt((e * e).sum(1).max()) * np.sqrt((a * a).sum(1))
        found = []
        step = max(1, CELLS // len(e))
        for at in range(0, len(a), step):
            s = a[at : at + step] @ e.T
            for lo, hi in zip(ends, ends[1:]):
                own = s[:, lo:hi]
                least = np.partition(own, hi - lo - k, axis=1)[:, hi - lo - k] if hi - lo > k else own.min(1)
                i, j = np.nonzero(own >= (least - slack[at : at + step])[:, None])
                score = np.zeros(len(i))
                for x in range(e.shape[1]):
                    score += a[at + i, x] * e[lo + j, x]
                score = _rounded(score)
                by = np.lexsort((j, -score, i))  # vectors stand in the order of their ids
                i, j, score = i[by], j[by], score[by]
                begin = np.searchsorted(i, i)
                kept = np.arange(len(i)) - begin < k
                found.append((at + i[kept], lo + j[kept], score[kept]))
        i, j, score = (np.concatenate(x) for x in zip(*found))
        cols = [right["q"].take(pa.array(i)), *(left[x].take(pa.array(j)) for x in names[1:])]
        return pa.table([*cols, pa.array(score)], schema=schema)

    near = c.groupBy("cb", "qb").cogroup(q.groupBy("cb", "qb")).applyInArrow(best, ", ".join(f"{x} {t}" for x, t in kinds.items()) + ", score double")
    w = Window.partitionBy("q", *(["g"] if within else [])).orderBy(F.desc("score"), "d")
    near = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return near.select(F.col("q").alias(q_id), F.col("d").alias(d_id), *([F.col("g").alias(within)] if within else []), "score")


def reciprocal_rank_fusion(rankings: DataFrame, query: str, item: str, constant: int = 60) -> DataFrame:
    """Rows (query, item, rrf) from (query, item, rnk), ranks from 1 on, of all rankings."""
    return rankings.groupBy(query, item).agg(F.round(F.sum(1.0 / (constant + F.col("rnk") - 1)), 6).alias("rrf"))


def precision_filter(hits: DataFrame, query: str, doc: str, floor: float = 0.42, gap: float = 0.72, dominance: float = 0.60, cap: int = 6) -> DataFrame:
    """Hits (query, item, doc, score) at or over the floor (or the single best), near the best one, of the document that holds most of the score mass."""
    q = Window.partitionBy(query)
    x = hits.withColumn("best", F.max("score").over(q)).withColumn("rn", F.row_number().over(q.orderBy(F.desc("score"), "item")))
    x = x.where((F.col("score") >= floor) | ((F.col("best") < floor) & (F.col("rn") == 1))).where(F.col("score") >= gap * F.col("best"))
    x = x.withColumn("mass", F.sum("score").over(Window.partitionBy(query, doc))).withColumn("all", F.sum("score").over(q))
    x = x.withColumn("lead", F.max_by(doc, F.struct("mass", -F.col("rn"))).over(q)).withColumn("share", F.max("mass").over(q) / F.col("all"))
    x = x.where((F.col("share") < dominance) | (F.col(doc) == F.col("lead")))
    return top_k(x.select(query, "item", doc, "score"), query, "item", "score", cap)
