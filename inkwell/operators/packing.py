"""What is kept of ranked evidence: size budgets, neighbours, agreement of hit sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET = 60_000  # characters of context


def budget_pack(hits: DataFrame, query: str, item: str, rank: str, size: str, budget: int = BUDGET) -> DataFrame:
    """Rows (query, item, rank, used): hits by rank, each kept unless it would exceed the budget; later ones may still fit.

    A query's ranked hits are folded as one array: give it a bounded top-k.
    """
    ranked = hits.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).cast("long").alias("r"), F.col(size).cast("long").alias("s"), F.col(item).alias("i")))).alias("hits"))
    kind = f"array<struct<r:bigint,used:bigint,i:{hits.schema[item].dataType.simpleString()}>>"
    begin = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("kept"))

    def step(acc, x):
        used = acc["used"] + x["s"]
        kept = F.array_append(acc["kept"], F.struct(x["r"].alias("r"), used.alias("used"), x["i"].alias("i")))
        return F.when(used > budget, acc).otherwise(F.struct(used.alias("used"), kept.alias("kept")))

    packed = ranked.select(query, F.explode(F.aggregate("hits", begin, step, lambda acc: acc["kept"])).alias("k"))
    return packed.select(query, F.col("k.i").alias(item), F.col("k.r").alias(rank), F.col("k.used").alias("used"))


def with_neighbours(hits: DataFrame, corpus: DataFrame, query: str, item: str, section: str, score: str) -> DataFrame:
    """Rows (query, item, section, score): hits and the items next to them in the same section; those that weren't hits score 0."""
    near = hits.select(query, section, F.explode(F.sequence(F.col(item) - 1, F.col(item) + 1)).alias(item)).distinct()
    there = near.join(corpus.select(item, section), [item, section], "left_semi")
    return there.join(hits.select(query, item, score), [query, item], "left").select(query, item, section, F.coalesce(score, F.lit(0.0)).alias(score))


def pairwise_agreement(sets: DataFrame, key: str, name: str, item: str) -> DataFrame:
    """Rows (key, agreement): mean Jaccard similarity over the pairs of a key's sets, each a name's items; null below two sets.

    Equal sets are one class, however many: a class counts by its pairs. Shared items of classes come from an equi-join on the item;
    pairs of a key's few sets that share none count as 0.
    """
    alike = sets.select(key, name, item).distinct().groupBy(key, name).agg(F.sort_array(F.collect_list(item)).alias("items"))
    size = alike.groupBy(key, "items").agg(F.min(name).alias(name), F.count(F.lit(1)).alias("w")).withColumn("n", F.size("items"))
    rows = size.select(key, name, "n", "w", F.explode("items").alias(item))
    a, b = (rows.select(key, item, F.col(name).alias(x), F.col("n").alias(f"n{x}"), F.col("w").alias(f"w{x}")) for x in "ab")
    both = a.join(b, [key, item]).where("a < b").groupBy(key, "a", "b", "na", "nb", "wa", "wb").agg(F.count(F.lit(1)).alias("both"))
    total = both.groupBy(key).agg(F.sum(F.col("wa") * F.col("wb") * F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("total"))
    pairs = size.groupBy(key).agg((F.sum("w") * (F.sum("w") - 1) / 2).alias("pairs"), F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("equal"))
    mean = F.when(F.col("pairs") > 0, F.round((F.coalesce("total", F.lit(0.0)) + F.col("equal")) / F.col("pairs"), 4))
    return pairs.join(total, key, "left").select(key, mean.alias("agreement"))
