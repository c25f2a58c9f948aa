"""Connected components of pairs, by repeated hooking to smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(pairs: DataFrame, at: Scratch, name: str) -> DataFrame:
    """Rows (node, root) for every node of ``pairs`` (a, b); root is the smallest node that links reach.

    Large-star and small-star steps in turn: each node's larger neighbours, then its smaller ones, are tied to the
    smallest of all. The number of edges never grows, hubs are never gathered, and the rounds grow with the logarithm
    of the longest chain. Each round's edges are written out.
    """
    edges = at.put(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    k = 0

    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.select(F.col("a").alias("n"), F.col("b").alias("m"))
        if larger:
            both = both.unionByName(e.select(F.col("b").alias("n"), F.col("a").alias("m")))
        low = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("low"))
        tied = both.join(low, "n")
        out = tied.where("m > n") if larger else tied
        out = out.select(F.col("m").alias("a"), F.col("low").alias("b"))
        if not larger:
            out = out.unionByName(low.select(F.col("n").alias("a"), F.col("low").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def sums(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first())

    was = sums(edges)
    while was[0]:
        k += 1
        new = at.put(star(star(edges, True), False), f"{name}-{k}")
        now = sums(new)
        at.drop(f"{name}-{k - 1}")
        edges = new
        if now == was:
            break
        was = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().join(roots.select("node"), "node", "left_anti"))
