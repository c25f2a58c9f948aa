"""Which documents and sections a question is about: inference by words, shortlists, routing, families of sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TITLE, CONCENTRATION, HITS, LIST_ITEMS = 0.62, 0.30, 6, 4  # from which a signal commits to a section
SHORTLIST, TITLES = 18, 10
SECTION_CHARS = 120_000  # above which a family keeps the section that was picked only


def infer_documents(questions: DataFrame, registry: DataFrame, q_id: str, d_id: str, text: str = "text") -> DataFrame:
    """Rows (q_id, d_id) where a question holds two words of four and more letters of a document's base name, or its version's year.

    ``registry`` has (d_id, base_name, version_label). A word that a question holds begins with four characters that it
    holds as well, so questions and documents meet by those alone. Words that a name repeats count as often.
    """
    low = F.lower(text)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 3, F.lit(1))), lambda i: F.substring(low, i, F.lit(4))))
    q = questions.where(F.col(text).isNotNull()).select(F.col(q_id), low.alias("q"), F.explode(grams).alias("gram"))
    words = F.regexp_extract_all(F.lower("base_name"), F.lit("[a-z]{4,}"), F.lit(0))
    year = F.split("version_label", "-")[0]
    keys = F.concat(
        F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(1).alias("points"))),
        F.array(F.struct(year.alias("w"), F.lit(2).alias("points"))),
    )
    d = registry.select(d_id, F.explode(keys).alias("k")).select(d_id, "k.w", "k.points", F.substring("k.w", 1, 4).alias("gram"))
    d = d.groupBy(d_id, "w", "gram").agg(F.sum("points").alias("points"))
    met = q.join(d, "gram").where(F.contains("q", F.col("w")) & (F.length("w") >= 4))
    return met.groupBy(q_id, d_id).agg(F.sum("points").alias("points")).where("points >= 2").select(q_id, d_id)


def shortlist(titles: DataFrame, mass: DataFrame, query: str, section: str) -> DataFrame:
    """Rows (query, section, place): the best TITLES sections by title that are not navigational, then those by mass, SHORTLIST in all.

    ``titles`` has (query, section, score, navigational), ``mass`` (query, section, mass).
    """
    w = Window.partitionBy(query)
    a = titles.withColumn("rn", F.row_number().over(w.orderBy(F.desc("score"), section))).where(f"rn <= {TITLES} and not navigational")
    b = mass.withColumn("rn", F.row_number().over(w.orderBy(F.desc("mass"), section))).where(f"rn <= {SHORTLIST}")
    both = a.select(query, section, F.col("rn").alias("at")).unionByName(b.select(query, section, (F.col("rn") + TITLES).alias("at")))
    x = both.groupBy(query, section).agg(F.min("at").alias("at")).withColumn("place", F.row_number().over(w.orderBy("at", section)).cast("long"))
    return x.where(f"place <= {SHORTLIST}").select(query, section, "place")


def route(signals: DataFrame) -> DataFrame:
    """Add ``why`` and ``mode`` to rows (title, concentration, hits, wants_set, title_items, dominant_items).

    A good title match commits to that section, else evidence that concentrates commits to the dominant one; the whole
    section is read only if the question wants a set or the section is a list.
    """
    why = F.when(F.col("title") >= TITLE, "title").when((F.col("concentration") >= CONCENTRATION) | (F.col("hits") >= HITS), "evidence")
    x = signals.withColumn("why", why)
    items = F.when(F.col("why") == "title", F.col("title_items")).otherwise(F.col("dominant_items"))
    section = F.col("why").isNotNull() & (F.col("wants_set") | (items >= LIST_ITEMS))
    return x.withColumn("mode", F.when(section, "section").otherwise("hybrid"))


def forced(routes: DataFrame, mass: DataFrame, query: str, section: str) -> DataFrame:
    """Rows (query, mode, section) of ``routes`` (query, mode, section, forced): hybrid has no section; a forced section that is missing is that of the most mass."""
    top = mass.groupBy(query).agg(F.max_by(section, F.struct(F.col("mass"), -F.col("first"), F.col(section))).alias("top"))
    x = routes.join(top, query, "left").withColumn("mode", F.coalesce("forced", "mode"))
    picked = F.when(F.col("mode") == "section", F.when(F.col("forced") == "section", F.coalesce(section, "top")).otherwise(F.col(section)))
    return x.select(query, "mode", picked.alias(section))


def family(picked: DataFrame, sections: DataFrame, doc: str) -> DataFrame:
    """Rows (doc, number): the picked sections and all below them by number; the first picked only where they come to over SECTION_CHARS.

    Sections meet the picked ones by the parts of their own number, so none is compared with all.
    """
    parts = F.split("number", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    s = sections.where("number <> ''").select(doc, "number", "char_start", "char_end", F.explode(above).alias("base"))
    hit = s.join(picked.select(doc, F.col("number").alias("base")).distinct(), [doc, "base"])
    out = hit.groupBy(doc, "number").agg(F.min("char_start").alias("at"), F.min(F.col("char_end") - F.col("char_start")).alias("size"), F.max(F.col("base") == F.col("number")).alias("own"))
    w = Window.partitionBy(doc)
    x = out.withColumn("all", F.sum("size").over(w)).withColumn("first", F.min(F.when(F.col("own"), F.struct("at", "number"))).over(w))
    return x.where(f"all <= {SECTION_CHARS} or number = first.number").select(doc, "number")


def covered_lists(hits: DataFrame, chunks: DataFrame, items: DataFrame, section: str, chunk: str) -> DataFrame:
    """Sections all of whose chunks were hit and that hold LIST_ITEMS items and more."""
    n = chunks.groupBy(section).agg(F.countDistinct(chunk).alias("n"))
    got = hits.select(section, chunk).distinct().join(chunks.select(section, chunk).distinct(), [section, chunk]).groupBy(section).agg(F.count(F.lit(1)).alias("hit"))
    return n.join(got, section).join(items, section).where(f"hit >= n and n_items >= {LIST_ITEMS}").select(section, "n", "n_items")
