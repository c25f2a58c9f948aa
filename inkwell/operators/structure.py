"""Structure of documents that come as text: cleaned lines, headings, section trees, blocks and chunks of sections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.package import ship
from .items import MARKERS

# Fixed patterns: a numbered heading on a line of its own, a bare page number.
HEADING = r"^([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})\s+([A-Z][^\n]{3,90})$"
PAGE_NUMBER = r"^[0-9]{1,4}$"
FRONT = 200  # characters before the first section from which on they are one of their own
CHUNK, OVERLAP, LEAST = 1_100, 220, 120  # characters of a chunk, carried over to the next one, and least to be kept


def numbered_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Rows (keep, _row, no, line, at) of each line of each row's text, with its place; ``_row`` tells rows apart, repeated ones too."""
    x = df.where(F.col(text).isNotNull()).withColumn("_row", F.monotonically_increasing_id())
    x = x.select("_row", *keep, F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    before = Window.partitionBy("_row").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long"))


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, no, line, start) of each line, with its place in its own row's text. Null texts give none."""
    return numbered_lines(docs, text_col, [id_col]).select(id_col, "no", "line", F.col("at").alias("start"))


def clean_lines(lines: DataFrame, running: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows (doc, no, line) without running lines and bare page numbers; one blank line where several stand, none at the ends.

    ``lines`` has (doc, no, line), ``running`` (doc, key): lines whose numbers are written as #.
    """
    line = F.trim(F.regexp_replace("line", r"[ \t]+", " "))
    x = lines.select(doc, "no", line.alias("line")).withColumn("key", F.regexp_replace("line", "[0-9]+", "#"))
    x = x.join(running.select(doc, "key").distinct(), [doc, "key"], "left_anti").where(~F.col("line").rlike(PAGE_NUMBER))
    w = Window.partitionBy(doc).orderBy("no")
    x = x.withColumn("prev", F.lag("line").over(w)).withColumn("last", F.max(F.when(F.col("line") != "", F.col("no"))).over(Window.partitionBy(doc)))
    return x.where((F.col("line") != "") | ((F.col("prev") != "") & (F.col("no") < F.col("last")))).select(doc, "no", "line")


def headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, start, level, number, title, full_title) of numbered headings; of a document without any, one that covers it all."""
    lines = text_lines(docs, id_col, text_col).where(F.col("line").rlike(HEADING))
    number, title = F.regexp_extract("line", HEADING, 1), F.trim(F.regexp_extract("line", HEADING, 2))
    level = (F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).cast("long")
    found = lines.select(id_col, "start", level.alias("level"), number.alias("number"), title.alias("title"), F.concat_ws(" ", number, title).alias("full_title"))
    none = docs.where(F.col(text_col).isNotNull()).select(id_col).distinct().join(found, id_col, "left_anti")
    whole = none.select(id_col, F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("level"), F.lit("").alias("number"), F.lit("Document").alias("title"), F.lit("Document").alias("full_title"))
    return found.unionByName(whole)


def _paths(of: Column) -> Column:
    """From (level, title, ...) in order: for each the titles of the open sections above it and its own, joined."""
    open_ = F.array().cast("array<struct<level:bigint,title:string>>")
    begin = F.struct(open_.alias("stack"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        above = F.filter(acc["stack"], lambda s: s["level"] < x["level"])
        stack = F.array_append(above, F.struct(x["level"].alias("level"), x["title"].alias("title")))
        return F.struct(stack.alias("stack"), F.array_append(acc["out"], F.array_join(F.transform(stack, lambda s: s["title"]), " > ")).alias("out"))

    return F.aggregate(of, begin, step, lambda acc: acc["out"])


def section_tree(heads: DataFrame, doc: str = "doc_id", total: str = "n_chars", order: str = "start") -> DataFrame:
    """Rows (doc, sec_no, path, level, char_start, char_end) from headings (doc, start, level, full_title, total), in ``order``.

    A section ends where the next one starts, or one character on where that is the same place; the last one at the
    text's end. Headings at one place stay apart, in ``order``, then by level and title. A path names the open sections above.
    What stands before the first one is "Front matter", number -1, if it is over FRONT characters long. A document's
    headings meet in one row.
    """
    own = F.struct(F.col(order).cast("long").alias("at"), F.col("start").cast("long").alias("start"), F.col("level").cast("long").alias("level"), F.col("full_title").alias("title"))
    all_ = heads.groupBy(doc).agg(F.sort_array(F.collect_list(own)).alias("h"), F.max(total).cast("long").alias("n"))
    at = lambda i: F.col("h")[i]
    end = lambda i: F.when(i + 1 < F.size("h"), F.col("h")[i + 1]["start"]).otherwise(F.col("n"))
    over = lambda s, e: F.when(e > s, e).otherwise(F.least(F.col("n"), s + 1))
    section = lambda p, i: F.struct(i.cast("long").alias("sec_no"), p.alias("path"), at(i)["level"].alias("level"), at(i)["start"].alias("char_start"), over(at(i)["start"], end(i)).alias("char_end"))
    one, first = F.lit(1).cast("long"), F.col("h")[0]["start"]
    front = F.struct((-one).alias("sec_no"), F.lit("Front matter").alias("path"), one.alias("level"), (one - 1).alias("char_start"), first.alias("char_end"))
    return all_.select(doc, F.inline(F.concat(F.when(first > FRONT, F.array(front)).otherwise(F.array().cast("array<struct<sec_no:bigint,path:string,level:bigint,char_start:bigint,char_end:bigint>>")), F.transform(_paths(F.col("h")), section))))


def section_text(sections: DataFrame, docs: DataFrame, doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``body``, the section's slice of the text."""
    body = F.substring(F.col(text_col), (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int"))
    return sections.join(docs.select(doc, text_col), doc).withColumn("body", body).drop(text_col)


def _split(text: str, marker) -> list[tuple[int, str]]:
    """Blocks (offset, text): a new one at each list item or blank line, those over CHUNK characters cut again between lines."""
    groups, at = [], 0
    for line in text.split("\n"):
        starts = not groups or marker.match(line) or not line.strip()
        if starts:
            groups.append((at, []))
        groups[-1][1].append(line)
        at += len(line) + 1
    out = []
    for at, lines in groups:
        if not any(x.strip() for x in lines):
            continue
        part, size, long = [], 0, sum(map(len, lines)) + len(lines) - 1 > CHUNK
        for i, line in enumerate(lines):
            if part and long and size + len(line) > CHUNK:
                out.append((at, "\n".join(part)))
                at, part, size = at + size, [], 0
            part.append(line)
            size += len(line) + 1
            if i + 1 == len(lines):
                out.append((at, "\n".join(part)))
    return out


def _pack(blocks: list[tuple[int, str]]) -> Iterator[tuple[int, int, str]]:
    """Chunks (offset, length, text) of whole blocks, each beginning with the last blocks of the one before it."""
    held, size, first = [], 0, True

    def chunk() -> tuple[int, int, str]:
        body = "\n".join(b for _, b in held)
        return held[0][0], len(body), body.strip()

    for at, block in [*blocks, (0, None)]:
        if held and (block is None or size + len(block) > CHUNK):
            c = chunk()
            if first or len(c[2]) >= LEAST:
                yield c
                first = False
            n = k = 0
            while k < len(held) and n < OVERLAP:
                k += 1
                n += len(held[-k][1])
            held = held[-k:]
            size = n
        if block is not None:
            held.append((at, block))
            size += len(block) + 1


def section_chunks(sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows (doc, sec_no, chunk_no, char_start, char_end, chunk, embed_text) from sections with ``path`` and ``body``.

    Blocks are packed up to CHUNK characters; a chunk takes over the last blocks of the one before it until they come to
    OVERLAP. Chunks under LEAST characters are dropped but for a section's first. embed_text is the path and the chunk.
    """
    ship(sections.sparkSession)
    marker = re.compile("|".join(f"(?:{p})" for p in MARKERS.values()))
    kind = sections.schema[doc].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for d, no, start, end, body in zip(part["d"], part["sec_no"], part["char_start"], part["char_end"], part["body"], strict=True):
                for i, (at, n, text) in enumerate(_pack(_split(body, marker))):
                    rows.append((d, no, i, start + at, min(start + at + n, end), text))
            yield pd.DataFrame(rows, columns=["d", "sec_no", "chunk_no", "char_start", "char_end", "chunk"])

    x = sections.select(F.col(doc).alias("d"), "sec_no", "char_start", "char_end", "body")
    chunks = x.mapInPandas(run, f"d {kind}, sec_no long, chunk_no long, char_start long, char_end long, chunk string").withColumnRenamed("d", doc)
    paths = sections.select(doc, "sec_no", "path")
    return chunks.join(paths, [doc, "sec_no"]).withColumn("embed_text", F.concat_ws("\n", "path", "chunk")).drop("path")


def chunk_index(chunks: DataFrame, group: list[str], item: str) -> DataFrame:
    """Rows (group, chunks, n_chunks): the chunk numbers of each section, in order."""
    return chunks.groupBy(*group).agg(F.array_join(F.sort_array(F.collect_list(item)), ",").alias("chunks"), F.count(F.lit(1)).alias("n_chunks"))


def indent_levels(items: DataFrame, group: str, x: str = "x", tolerance: float = 6.0) -> DataFrame:
    """Add ``depth``: the nearest of the group's indent levels, or null where under 80 % of the items (two at least) have a place.

    A level begins at an indent over ``tolerance`` past the last level. Items without a place have depth 0.
    """
    usable = F.when(F.col(x) >= 0, F.col(x))
    g = items.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count(usable).alias("m"), F.array_sort(F.collect_set(usable)).alias("xs"))
    begin = F.array().cast("array<double>")
    levels = F.aggregate("xs", begin, lambda acc, v: F.when((F.size(acc) == 0) | (v - F.element_at(acc, -1) > tolerance), F.array_append(acc, v)).otherwise(acc))
    g = g.withColumn("levels", F.when(F.col("m") >= F.greatest(F.lit(2), F.floor(F.col("n") * 0.8)), levels)).select(group, "levels")
    near = F.transform("levels", lambda v, i: F.struct(F.abs(v - F.col(x)).alias("d"), i.alias("i")))
    depth = F.when(F.col("levels").isNull(), None).when((F.col(x) < 0) | F.col(x).isNull(), 0).otherwise(F.array_min(near)["i"])
    return items.join(g, group).withColumn("depth", depth.cast("long")).drop("levels")


def chosen_items(picked: DataFrame, groups: DataFrame, doc: str) -> DataFrame:
    """Rows (doc, n_groups, n_items) of the picked sections that hold groups of items."""
    return groups.join(picked.select(doc).distinct(), doc, "left_semi").groupBy(doc).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_items").alias("n_items"))
