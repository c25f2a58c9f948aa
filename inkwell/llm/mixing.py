"""Operator 10: mixing sources to target weights by Sainte-Laguë apportionment; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WEIGHTS = (5, 2, 1)  # of the sources in code point order, repeating
MOST = 3  # times that a document may be taken
BLOCKS = 10_000_000  # equal-token blocks that the whole mix is cut into; only quotients near the last that wins are looked at
SHARD_WORDS, SHARD_DOCS = 2_000_000, 10_000  # words and documents in a shard on average, which bound what is ordered together
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Add weight and target to rows (source, source_size): shares of the total by weight, none above MOST times its size.

    Its windows take all sources at once, so their number bounds it.

    The excess of those above is shared again by weight. All that end below their limit get one level times their
    weight; the level is that of the first source, by limit over weight, that it leaves below.
    """
    by_name, by_limit, all_ = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "number"), Window.partitionBy()
    w = sources.withColumn("number", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("number") - 1) % len(WEIGHTS) + 1).cast("int")))
    w = w.withColumn("limit", F.col("source_size") * MOST).withColumn("ratio", F.col("limit") / F.col("weight"))
    before = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    w = w.withColumn("level", (F.sum("source_size").over(all_) - before) / rest).withColumn("place", F.row_number().over(by_limit))
    w = w.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("place"))).over(all_))
    return w.withColumn("target", F.when(F.col("ratio") <= F.col("level"), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("level")))


def sainte_lague(df: DataFrame, group: list[str], key: Column, votes: str, seats: Column, most: Column, out: str) -> DataFrame:
    """Add ``out``: of each group's ``seats``, those that the highest quotients votes / (2k + 1) give to a row, ``most`` at most.

    Only quotients near the last one that wins are compared: with d votes a seat, rounding gives at most half a seat
    too many or too few a row, so with S rows the counts for B - S seats are surely won and those for B + S never surpassed.
    """
    w = Window.partitionBy(*group)
    v, s, b = F.sum(votes).over(w), F.count(F.lit(1)).over(w), seats.cast("double")
    near = lambda n: F.when(v > 0, F.floor(F.col(votes) * n / v + 0.5)).otherwise(F.lit(0)).cast("long")
    x = df.withColumn("_most", most.cast("long")).withColumn("_seats", seats.cast("long"))
    x = x.withColumn("_sure", F.least(near(F.greatest(b - s, F.lit(0))), "_most")).withColumn("_may", F.least(near(b + s) + 1, "_most"))
    x = x.withColumn("_left", F.col("_seats") - F.sum("_sure").over(w)).withColumn("_key", key)
    open_ = x.where("_may > _sure").withColumn("_k", F.explode(F.sequence("_sure", F.col("_may") - 1)))
    order = Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), F.col("_key").asc_nulls_last())
    won = open_.withColumn("_rank", F.row_number().over(order)).where("_rank <= _left").groupBy(F.col("_key").alias("_won_key"), *[F.col(g).alias(f"_won_{g}") for g in group]).agg(F.count(F.lit(1)).alias("_won"))
    same = F.col("_key").eqNullSafe(F.col("_won_key"))
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_won_{g}"))
    drop = ["_most", "_seats", "_sure", "_may", "_left", "_key", "_won_key", "_won", *[f"_won_{g}" for g in group]]
    return x.join(won, same, "left").withColumn(out, F.col("_sure") + F.coalesce("_won", F.lit(0))).drop(*drop)


def hand_out(parts: DataFrame, group: str, key: str, size: str, due: Column, quota: str) -> DataFrame:
    """Raise ``quota`` of a group's rows until they come to ``due``: by words, in proportion to what each is below MOST times its size.

    Words that a row's limit cuts off its blocks thus go to the others of the group; what rounding leaves goes to the first by key.
    """
    w = Window.partitionBy(group)
    before = w.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    x = parts.withColumn("_room", F.col(size) * MOST - F.col(quota)).withColumn("_lack", F.greatest(F.lit(0), due - F.sum(quota).over(w)))
    x = x.withColumn("_all", F.sum("_room").over(w)).withColumn("_more", F.when(F.col("_all") > 0, F.floor(F.col("_lack") * (F.col("_room") / F.col("_all")))).otherwise(F.lit(0)))
    x = x.withColumn("_left", F.col("_room") - F.col("_more")).withColumn("_rest", F.col("_lack") - F.sum("_more").over(w))
    last = F.greatest(F.lit(0), F.least("_left", F.col("_rest") - F.coalesce(F.sum("_left").over(before), F.lit(0))))
    return x.withColumn(quota, F.col(quota) + F.col("_more") + last).drop("_room", "_lack", "_all", "_more", "_left", "_rest")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, size, source_size, target, taken): how many of each document's words the mix takes.

    Each source's target is cut into blocks of equal numbers of words; Sainte-Laguë gives whole blocks to sources and
    then to the hash shards of each. A shard's documents stand in seeded order; its blocks are whole passes over them
    and then the first blocks of one more. The last block may end within a document. A source has as many shards as its
    own words or documents fill; what a shard's limit cuts off its blocks, or a block larger than a shard leaves over,
    goes to the source's other shards, by words. A source thus gets all of its blocks, and comes to its target but for
    the rounding to whole blocks, a ten-millionth of the total. Rows of shards, not of documents, meet in a source's window.

    Null text has size 0 and takes nothing; a null source is a source of its own, the last. Repeated rows count as so
    many documents. Of other columns those in ``keep`` are carried along, whatever their names, the others not read; where
    a kept one has the name of a result, the result counts. An empty table, or one without words, gives 0 for all.
    """
    at = Scratch(docs.sparkSession, "mixing")
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    sized = at.put(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col).cast("string")).alias("size"), h.alias("h"), *kept), "sized")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    sources = at.put(targets(by_source).select("source", "source_size", "source_docs", "number", "target"), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    block = max(1, -(-total // BLOCKS))
    quota = sainte_lague(sources.withColumn("all", F.lit(1)), ["all"], F.col("number"), "target", F.lit(total // block), F.ceil(F.col("source_size") * MOST / block), "blocks")
    own = F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("source_docs") / SHARD_DOCS), F.lit(1))
    quota = at.put(quota.select(F.col("source").alias("q_source"), "number", "source_size", "target", "blocks", own.alias("shards")), "quota")
    rows = sized.join(quota, F.col("source").eqNullSafe(F.col("q_source"))).withColumn("shard", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.col("shards"))
    parts = rows.groupBy("number", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"), F.first("source_size").alias("source_size"))
    parts = sainte_lague(parts, ["number"], F.col("shard"), "shard_size", F.col("blocks"), F.ceil(F.col("shard_size") * MOST / block), "shard_blocks")
    parts = parts.withColumn("quota", F.least(F.col("shard_blocks") * block, F.col("shard_size") * MOST))
    parts = hand_out(parts, "number", "shard", "shard_size", F.least(F.col("blocks") * block, F.col("source_size") * MOST), "quota")
    parts = at.put(parts.select(F.col("number").alias("p_number"), F.col("shard").alias("p_shard"), "shard_size", "quota"), "parts")
    rows = rows.join(parts, (F.col("number") == F.col("p_number")) & (F.col("shard") == F.col("p_shard")))
    order = Window.partitionBy("number", "shard").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    whole = F.when(F.col("shard_size") > 0, F.expr("quota div shard_size")).otherwise(F.lit(0))
    over = F.when(F.col("shard_size") > 0, F.col("quota") - whole * F.col("shard_size")).otherwise(F.lit(0))
    taken = (whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), over - F.col("before")))).cast("long")
    return rows.select(F.col("id").alias(id_col), "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), taken.alias("taken"), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)])
