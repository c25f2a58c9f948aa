"""Operator 4: n-gram Jaccard join by a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ship
from .links import components
from .shingles import batches_of, mix, shingle_sets

SIZE = 5  # words in a shingle
NUM, DEN = 4, 5  # the similarity, as a fraction
PART = 3  # eighths of the token space that the first look counts


def _first_tokens(n: Column) -> Column:
    """How many tokens stand first in a set of n: a set that links with it holds one of them, in whatever common order."""
    return n - F.ceil(n * NUM / DEN) + 1


def signatures(docs: DataFrame) -> DataFrame:
    """Rows (id, n, f1, f2, part) per document: the size of its set, the set's fingerprint, and its tokens in PART eighths of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for first, texts in batches_of(b.column(1)):
                sets = list(shingle_sets(texts, SIZE))
                n = pa.array([len(s) for s in sets], pa.int64())
                f1 = pa.array([int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64())
                f2 = pa.array([int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64())
                part = _lists([s[: np.searchsorted(s, np.uint64(PART << 61))] for s in sets])
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), n, f1, f2, part], names=["id", "n", "f1", "f2", "part"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, f1 long, f2 long, part array<long>")


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def token_sets(docs: DataFrame) -> DataFrame:
    """Rows (id, tokens): each document's whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in batches_of(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), _lists(list(shingle_sets(texts, SIZE)))], names=["id", "tokens"])

    return docs.select("id", "text").mapInArrow(run, "id long, tokens array<long>")


def not_alone(reps: DataFrame) -> DataFrame:
    """Rows (id, n) of ``reps`` (id, n, part) that may link with others.

    A set of which so many tokens stand in no other that no first token is left links with nothing. Tokens are counted
    in PART eighths of their space only, for all documents alike: what is alone there is alone altogether.
    """
    part = reps.select("id", F.explode("part").alias("token"))
    again = part.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("token")
    met = part.join(again, "token").groupBy("id").agg(F.count(F.lit(1)).alias("met"))
    seen = reps.select("id", "n", F.size("part").alias("seen")).join(met, "id", "left")
    return seen.where(F.col("seen") - F.coalesce("met", F.lit(0)) < _first_tokens(F.col("n"))).select("id", "n")


def shared_tokens(sets: DataFrame) -> DataFrame:
    """Rows (id, n, alone, tokens) of ``sets`` (id, n, tokens): the tokens that several sets hold, rarest first, and the number of others.

    Sets whose first tokens are all their own are left out. The order is that of the number of sets with a token,
    counted over all of ``sets``, then of the token.
    """
    rows = sets.select("id", "n", F.explode("tokens").alias("token"))
    df = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = rows.join(df, "token").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))
    held = held.select("id", "n", (F.col("n") - F.size("s")).alias("alone"), F.col("s.token").alias("tokens"))
    return held.where(F.col("alone") < _first_tokens(F.col("n")))


def linked(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets link, compared exactly by the tokens that they share with any set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (np.asarray(batch.column(j)) for j in range(4))
            ta, tb = batch.column(4), batch.column(5)
            both = np.array([len(np.intersect1d(np.asarray(x.values), np.asarray(y.values), assume_unique=True)) for x, y in zip(ta, tb, strict=True)], np.int64)
            keep = (both > 0) & (DEN * both >= NUM * (n + m - both)) if len(both) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    left = bags.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = bags.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").where(f"least(size(ta), size(tb)) * {NUM + DEN} >= {NUM} * (na + nb)")
    return both.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, "a long, b long")


def within_union(pairs: DataFrame, bags: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (id, n, home, held) of ``pairs`` (id, n, home, lo) where the union of the group's tokens leaves room for a link.

    The matrix has a row per group (home): each token that some member holds. held is how many of the document's tokens
    are in it, which no member can surpass; it must reach what a member of the least size that could link would need.
    """
    homes = pairs.select("home").distinct()
    matrix = bags.join(roots.withColumnRenamed("root", "home").join(homes, "home"), "id").select("home", F.explode("tokens").alias("token")).distinct()
    own = bags.join(pairs.select("id").distinct(), "id", "left_semi").select("id", F.explode("tokens").alias("token"))
    held = pairs.join(own, "id").join(matrix, ["home", "token"]).groupBy("id", "n", "home", "lo").agg(F.count(F.lit(1)).alias("held"))
    return held.where(f"held * {NUM + DEN} >= {NUM} * (n + greatest(lo, ceil({NUM} * n / {DEN})))").select("id", "n", "home", "held")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id) per document; sets of word shingles link from a similarity of 0.8 on.

    1. Equal sets are one; the smallest id stands for them. Sets with too many tokens of their own link with nothing.
    2. The others' tokens stand in the order of their frequency. Documents are tied to the smallest document with which
       they share the most first tokens, where both link: the similar ones form groups.
    3. The matrix holds the union of each group's tokens. A document meets the other groups that share a first token
       with it, where sizes, the token's places and then the union leave room for a link.
    4. Those groups are compared by two of their documents, then opened where that didn't join them.
    Links within one component are not looked for, as they change nothing.

    Null and empty texts have no shingles and link with nothing, one another included. Rows with a null id come back
    with a null component and link with nothing. Ids are whole numbers; repeated rows give repeated rows and are one
    document. Other columns are not read; an empty table gives an empty one. Tokens are 64-bit fingerprints of
    shingles, and sets of equal size and equal 128-bit fingerprint are taken to be equal.
    """
    spark = docs.sparkSession
    ship(spark)
    at = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    wide = at.put(signatures(docs), "wide")
    sigs = at.put(wide.select("id", "n", "f1", "f2"), "signatures")
    shown = sigs.where("n > 0 and id is not null")
    classes = at.put(shown.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep")), "classes")
    reps = at.put(wide.where("n > 0").join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]).select("id", "n", "part"), "reps")
    at.drop("wide")
    alive = at.put(not_alone(reps), "alive")
    at.drop("reps")
    texts = docs.join(alive.select("id"), "id", "left_semi").dropDuplicates(["id"])
    sets = at.put(token_sets(texts), "sets")
    bags = at.put(shared_tokens(sets.withColumn("n", F.size("tokens").cast("long"))), "bags")
    at.drop("sets", "alive")

    # of two sets that link, the smaller one has a token that both share among even fewer first ones
    first = bags.select("id", "n", "alone", F.posexplode(F.slice("tokens", F.lit(1), (_first_tokens(F.col("n")) - F.col("alone")).cast("int"))).alias("k", "token"))
    tokens = first.select("id", "n", "token", (F.col("alone") + F.col("k")).alias("pos")).withColumn("early", F.expr(f"pos <= n - ceil({2 * NUM} * n / {NUM + DEN})"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("lead"), F.max("early").alias("any_early")).where("df > 1 and any_early").select("token", "lead")
    shared = at.put(tokens.join(counts, "token"), "shared")

    # groups
    best = Window.partitionBy("a").orderBy(F.desc("c"), "b")
    ties = shared.where("id <> lead").groupBy(F.col("id").alias("a"), F.col("lead").alias("b")).agg(F.count(F.lit(1)).alias("c")).withColumn("k", F.row_number().over(best)).where("k = 1").select("a", "b")
    meant = at.put(shared.select("id").distinct(), "meant")
    edges = at.put(linked(ties, bags), "edges-0")

    def grouped(name: str) -> DataFrame:
        roots = components(edges, at, name)
        return at.put(meant.join(roots, meant.id == roots.node, "left").select("id", F.coalesce("root", "id").alias("root")), f"{name}-roots")

    roots = grouped("groups")

    # documents that meet other groups in a token
    met = shared.select("token", "id", "n", "pos", "early").join(roots, "id")
    mixed = met.groupBy("token").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("token")
    met = at.put(met.join(mixed, "token"), "met")
    homes = met.where("early").groupBy("token", F.col("root").alias("home")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("room"))
    # what two sets share begins with a token of both: no more can follow than stands from there on in either
    fits = f"least(n - pos, room) * {NUM + DEN} >= {NUM} * (n + greatest(lo, ceil({NUM} * n / {DEN})))"
    reach = met.join(homes, "token").where(f"root <> home and lo <= n and hi * {DEN} >= n * {NUM} and {fits}").groupBy("id", "n", "home").agg(F.min("lo").alias("lo"))
    reach = at.put(within_union(at.put(reach, "near"), bags, roots), "reach")

    # by the group's first document and that with the fewest tokens of its own, then by all of its members
    own = met.groupBy("id", "root").agg(F.min(F.col("pos") / F.col("n")).alias("own")).groupBy(F.col("root").alias("home")).agg(F.min_by("id", F.struct("own", "id")).alias("b"))
    leaders = reach.select(F.col("id").alias("a"), F.col("home").alias("b")).unionByName(reach.join(own, "home").select(F.col("id").alias("a"), "b")).distinct()
    edges = at.put(edges.unionByName(linked(leaders, bags)), "edges-1")
    now = grouped("first")
    still = reach.join(now.select("id", F.col("root").alias("ra")), "id").join(now.select(F.col("id").alias("home"), F.col("root").alias("rb")), "home").where("ra <> rb").select("id", "n", "home", "held")
    members = roots.join(bags.select("id", F.col("n").alias("m")), "id").select(F.col("id").alias("b"), F.col("root").alias("home"), "m")
    opened = still.join(members, "home").where(f"id <> b and m <= n and m * {DEN} >= n * {NUM} and b <> home and {NUM} * (n + m) <= {NUM + DEN} * held").select(F.col("id").alias("a"), "b")
    edges = at.put(edges.unionByName(linked(opened, bags)), "edges-2")
    final = grouped("final")

    of_class = classes.join(final, classes.rep == final.id, "left").select("n", "f1", "f2", F.coalesce("root", "rep").alias("component_id"))
    least = at.put(of_class, "components")
    out = sigs.join(least, ["n", "f1", "f2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def without_copies(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component: that whose id is the component's.

    Null and empty texts link with nothing and stay. Of repeated ids one row stays; rows of null id stay all.
    """
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    kept = docs.where(F.col(id_col).isNotNull()).join(gone, F.col(id_col) == F.col("_gone"), "left_anti").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
