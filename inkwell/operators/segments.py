"""Enumerated items of sections: list marks with their depth, runs of marks, nested items with places, groups under headings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.package import ship
from .items import MARKERS, with_markers
from .structure import indent_levels, numbered_lines

GAP = 3  # how far a number may be past the one before it at its depth
LEAST = 5  # characters of an item, white space around it aside


def marked_pieces(sections: DataFrame, key: list[str], indents: DataFrame | None = None, text: str = "body", base: str = "char_start") -> DataFrame:
    """Rows (key, _row, base, no, at, style, ordinal, depth, piece): what stands from each line with a list mark to the next one.

    ``_row`` tells sections apart, even repeated ones. The depth is that of the line's indent where ``indents``
    (key[0], start, x) gives it for four fifths of a section's marks, else the order in which the mark's style first occurs.
    """
    lines = numbered_lines(sections, text, [*key, base])
    own = Window.partitionBy("_row").orderBy("no")
    x = with_markers(lines, "line").withColumn("mark", F.max(F.when(F.col("style").isNotNull(), F.col("no"))).over(own)).where("mark is not null")
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "line"))), lambda s: s["line"]), "\n")
    first = lambda c: F.min(F.when(F.col("no") == F.col("mark"), F.col(c))).alias(c)
    m = x.groupBy("_row", *key, base, F.col("mark").alias("no")).agg(first("at"), first("style"), first("ordinal"), parts.alias("piece"))
    seen = m.withColumn("seen", F.min("no").over(Window.partitionBy("_row", "style")))
    by_style = seen.withColumn("_style", (F.dense_rank().over(Window.partitionBy("_row").orderBy("seen")) - 1).cast("long")).drop("seen")
    if indents is None:
        return by_style.withColumnRenamed("_style", "depth")
    edges = indents.groupBy(F.col(key[0]).alias("_doc"), F.col("start").alias("_at")).agg(F.min("x").alias("x"))
    placed = by_style.join(edges, (F.col(key[0]) == F.col("_doc")) & (F.col(base) + F.col("at") == F.col("_at")), "left").fillna(-1.0, ["x"]).drop("_doc", "_at")
    return indent_levels(placed, "_row").withColumn("depth", F.coalesce("depth", "_style")).drop("_style", "x")


def _settled(at: list[int], depths: list[int], ordinals: list[int | None], pieces: list[str], least: int, deepest: int | None) -> Iterator[tuple]:
    """(at, depth, parents, raw) of a section's items, from its marks in order.

    A number that falls back, or runs ahead by more than GAP, at its depth is no list mark but a wrapped line: its piece
    goes on the item before it. A bullet takes part in any run and ends it. Short items head nothing.
    """
    runs: dict[int, int | None] = {}
    kept: list[tuple[int, int, list[str]]] = []
    for place, depth, ordinal, piece in zip(at, depths, ordinals, pieces, strict=True):
        before = runs.get(depth)
        if ordinal is None:
            runs[depth] = None
        elif before is None or before < ordinal <= before + GAP or (depth > 0 and ordinal == 1):
            runs = {d: v for d, v in runs.items() if d < depth} | {depth: ordinal}
        else:
            if kept:
                kept[-1][2].append(piece)
            continue
        kept.append((place, depth, [piece]))
    level = {d: i for i, d in enumerate(sorted({d for _, d, _ in kept}))}
    above: list[tuple[int, str]] = []
    for place, d, own in kept:
        raw, depth = "\n".join(own).rstrip(), level[d]
        if len(raw.strip()) < least:
            continue
        above = [a for a in above if a[0] < depth]
        if deepest is None or depth <= deepest:
            yield place, depth, [title for _, title in above], raw
        above.append((depth, " ".join(raw.split("\n")[0].split())))


def section_items(sections: DataFrame, key: list[str], indents: DataFrame | None = None, deepest: int | None = None, text: str = "body", base: str = "char_start") -> DataFrame:
    """Rows (key, index, depth, style, marker, label, parents, text, raw, char_start, char_end): every enumerated item of each section.

    ``sections`` has the key (document first), ``base``, the section's place in the document, and its ``text``. Items are
    found by structure alone: lines, marks and depths by expressions and windows, then one ordered pass over a section's
    marks with a stack of open titles. Depths are numbered without gaps; a label is an item's first line, parents are
    the labels above it; text is the item without its mark, on one line. Items deeper than ``deepest`` are left out but head
    what is under them. A repeated section gives its items as often as it stands; null and unmarked text gives none.
    """
    spark = sections.sparkSession
    ship(spark)
    pieces = marked_pieces(sections, key, indents, text, base)
    marks = F.sort_array(F.collect_list(F.struct("no", F.col("at").cast("long").alias("at"), F.col("depth").cast("long").alias("depth"), F.col("ordinal").cast("long").alias("ordinal"), "piece")))
    own = pieces.groupBy("_row", *key, base).agg(marks.alias("m")).select(*key, base, *[F.col(f"m.{c}").alias(c) for c in ("at", "depth", "ordinal", "piece")])
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in [*key, base])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed, found = batch.select([*key, base]), []
            for i, (at, depth, ordinal, piece) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "depth", "ordinal", "piece")), strict=True)):
                found += [(i, n + 1, *r) for n, r in enumerate(_settled(at, depth, ordinal, piece, LEAST, deepest))]
            rows = pa.array([r[0] for r in found], pa.int64())
            kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string())
            cols = [pa.array([r[k + 1] for r in found], t) for k, t in enumerate(kinds_)]
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in fixed.columns), *cols], names=[*key, base, "index", "at", "depth", "parents", "raw"])

    # as many partitions as the session has: the texts are short for their work, and would be gathered in a few tasks
    own = own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key)
    x = own.mapInArrow(run, f"{kinds}, index long, at long, depth long, parents array<string>, raw string")
    body = F.trim(F.regexp_replace("raw", r"\s*\n\s*", " "))
    x = with_markers(x.withColumn("_line", body), "_line")
    mark = F.coalesce(*[F.when(F.col("style") == s, F.trim(F.regexp_extract("_line", p, 0))) for s, p in MARKERS.items()], F.lit(""))
    label = F.trim(F.regexp_replace(F.substring_index("raw", "\n", 1), r"\s+", " "))
    start = (F.col(base) + F.col("at")).cast("long")
    return x.select(*key, "index", "depth", "style", mark.alias("marker"), label.alias("label"), "parents", F.coalesce(F.nullif("body", F.lit("")), F.col("_line")).alias("text"), "raw", start.alias("char_start"), (start + F.length("raw")).alias("char_end"))


def with_groups(items: DataFrame, key: list[str], pos: str = "index", depth: str = "depth") -> DataFrame:
    """Add ``group_no`` and ``heads``: an item of depth 0 that a deeper one follows heads a group of its own.

    A childless item of depth 0 begins a group without a heading unless one is open, and so does an item before any group.
    """
    w = Window.partitionBy(*key).orderBy(pos)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = items.withColumn("heads", F.coalesce((F.col(depth) == 0) & (F.lead(depth).over(w) > F.col(depth)), F.lit(False)))
    last_top = F.last(F.when(F.col(depth) == 0, F.col("heads")), True).over(before)
    cut = F.col("heads") | (F.row_number().over(w) == 1) | ((F.col(depth) == 0) & F.coalesce(last_top, F.lit(False)))
    return x.withColumn("_cut", cut.cast("long")).withColumn("group_no", F.sum("_cut").over(w)).drop("_cut")


def item_groups(items: DataFrame, key: list[str], pos: str = "index", depth: str = "depth", label: str | None = "label") -> DataFrame:
    """Rows (key, group_no, heading, n_items, first, last) of groups with entries, in the items' order; a headless group has no heading.

    ``heading`` is the heading item's ``label``, or its ``pos`` where that is None.
    """
    x = with_groups(items, key, pos, depth)
    entry = ~F.col("heads")
    g = x.groupBy(*key, "group_no").agg(F.max(F.when(F.col("heads"), F.col(label or pos))).alias("heading"), F.count_if(entry).alias("n_items"), F.min(F.when(entry, F.col(pos))).alias("first"), F.max(F.when(entry, F.col(pos))).alias("last"))
    return g.where("n_items > 0")


def list_sections(groups: DataFrame, key: list[str], least: int = 5) -> DataFrame:
    """Rows (key, n_items) of the sections whose groups hold ``least`` items or more: those that behave as lists, whatever they are about."""
    return groups.groupBy(*key).agg(F.sum("n_items").alias("n_items")).where(F.col("n_items") >= least)


def structural_extraction(picked: DataFrame, sections: DataFrame, segments: DataFrame, key: str, doc: str, sec: str, pages: DataFrame | None = None, indents: DataFrame | None = None) -> DataFrame:
    """Rows (key, item_id, heading, section, text, marker, depth, char_start, char_end, view_start, view_end, page, score, grounding).

    ``picked`` has (key, doc, sec): the sections that answer a question; ``sections`` their title, place and body. Items are
    taken from each picked section once, whatever the number of questions, and shown in a question's view by ``segments``
    (key, doc, doc_start, doc_end, view_start). An item in the view is grounded with 100, another ungrounded with 0.
    ``pages`` has (doc, page, start). Questions without items give no rows: their sections are prose.
    """
    wanted = sections.join(picked.select(doc, sec).distinct(), [doc, sec], "left_semi")
    items = with_groups(section_items(wanted, [doc, sec], indents), [doc, sec])
    heading = F.max(F.when(F.col("heads"), F.col("label"))).over(Window.partitionBy(doc, sec, "group_no"))
    items = items.withColumn("heading", heading).where("not heads")
    if pages is not None:
        items = items.join(_pages_of(items, pages, [doc, sec, "index"], doc), [doc, sec, "index"], "left")
    x = picked.select(key, doc, sec).distinct().join(items, [doc, sec]).join(sections.select(doc, sec, F.col("title").alias("section")), [doc, sec])
    at = segments.select(key, doc, "doc_start", "doc_end", "view_start")
    hit = x.select(key, doc, sec, "index", "char_start", "char_end").join(at, [key, doc]).where("doc_start <= char_start and char_start < doc_end")
    begin = F.col("view_start") + F.col("char_start") - F.col("doc_start")
    length = F.greatest(F.lit(1), F.least("char_end", "doc_end") - F.col("char_start"))
    hit = hit.groupBy(key, doc, sec, "index").agg(F.min(F.struct(begin.alias("s"), (begin + length).alias("e"))).alias("v"))
    x = x.join(hit, [key, doc, sec, "index"], "left")
    number = F.row_number().over(Window.partitionBy(key).orderBy(doc, sec, "index")) - 1
    found = F.col("v").isNotNull()
    return x.select(
        key, F.concat(F.lit("i"), F.lpad(number.cast("string"), 4, "0")).alias("item_id"), F.coalesce("heading", "section").alias("heading"), "section", "text", "marker", "depth", "char_start", "char_end",
        F.col("v.s").alias("view_start"), F.col("v.e").alias("view_end"), F.col("page") if pages is not None else F.lit(None).cast("long").alias("page"),
        F.when(found, 100.0).otherwise(0.0).alias("score"), F.when(found, "grounded").otherwise("ungrounded").alias("grounding"),
    )


def _pages_of(items: DataFrame, pages: DataFrame, key: list[str], doc: str) -> DataFrame:
    """Rows (key, page) of the page, from 1 on, in which each item begins: one ordered pass a document over both."""
    none: Column = F.lit(None)
    a = items.select(*key, F.col("char_start").alias("_p"), F.lit(1).alias("_k"), none.cast("long").alias("_page"))
    b = pages.select(*[F.col(doc) if c == doc else none.cast(items.schema[c].dataType).alias(c) for c in key], F.col("start").alias("_p"), F.lit(0).alias("_k"), (F.col("page") + 1).cast("long").alias("_page"))
    w = Window.partitionBy(doc).orderBy("_p", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("page", F.last("_page", True).over(w)).where("_k = 1").select(*key, "page")
