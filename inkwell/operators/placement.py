"""Places of bookmarks in a document's text: page intervals, candidates in the pages around, places that never fall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed pattern: a bookmark's number and title.
NUMBERED = r"^(\d{1,2}(?:\.\d{1,2}){0,4})\s+(.{2,120})$"
TITLE_CHARS = 60  # of a title that are looked for when upper and lower case don't matter


def page_texts(lines: DataFrame, doc: str = "doc", page: str = "page", line: str = "line_no", text: str = "text") -> DataFrame:
    """Rows (doc, text, pages): the document rebuilt from its cleaned lines, and its pages' places as an array of (page, start, end).

    A newline ends each line, one more each page. A document's lines meet in one row, as its text does.
    """
    p = lines.groupBy(doc, page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(line, F.coalesce(text, F.lit("")).alias("t")))), lambda s: F.concat(s["t"], F.lit("\n"))), "").alias("body"))
    p = p.withColumn("body", F.concat("body", F.lit("\n"))).withColumn("n", F.length("body").cast("long"))
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
    g = p.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(page).cast("long").alias("page"), "start", (F.col("start") + F.col("n")).alias("end"), "body"))).alias("ps"))
    return g.select(doc, F.array_join("ps.body", "").alias("text"), F.transform("ps", lambda s: F.struct(s["page"].alias("page"), s["start"].alias("start"), s["end"].alias("end"))).alias("pages"))


def page_of(pages: Column, offset: Column) -> Column:
    """The place in ``pages`` of the page that holds ``offset``; the last where none does. Intervals lie one after the other."""
    n = F.size(pages)
    hit = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (pages[i]["start"] <= offset) & (offset < pages[i]["end"]))
    return F.coalesce(F.get(hit, F.lit(0)), n - 1).cast("long")


def bookmark_entries(bookmarks: DataFrame, doc: str = "doc") -> DataFrame:
    """Rows (doc, seq, level, number, title, full_title, page) of bookmarks (doc, seq, level, title, page), whose pages begin at 1.

    White space in titles is one space; a leading section number stands apart. ``page`` begins at 0.
    """
    full = F.trim(F.regexp_replace("title", r"\s+", " "))
    has = full.rlike(NUMBERED)
    number, title = F.when(has, F.regexp_extract(full, NUMBERED, 1)).otherwise(""), F.when(has, F.trim(F.regexp_extract(full, NUMBERED, 2))).otherwise(full)
    return bookmarks.where("title is not null").select(doc, F.col("seq").cast("long").alias("seq"), F.col("level").cast("long").alias("level"), number.alias("number"), title.alias("title"), full.alias("full_title"), (F.col("page") - 1).cast("long").alias("page"))


def _first(window: Column, candidate: Column) -> Column:
    """Where ``candidate`` first stands in ``window``, from 0 on; null where it doesn't."""
    at = F.call_function("locate", candidate, window)
    return F.when(at > 0, at - 1)


def located(entries: DataFrame, texts: DataFrame, doc: str = "doc") -> DataFrame:
    """``entries`` with ``start``, the place of each heading in the text, in the order of ``seq``; places never fall.

    A heading is looked for on its bookmark's page and those beside it, from the heading before it on: the number with
    the title on the next line or the same one, the number on a line of its own, the title, at last the title's first
    60 characters whatever their case. One that isn't found, or only before the heading before it, takes its page's start
    or that heading's place, whichever is later, so that places may tie. ``texts`` has (doc, text, pages) as ``page_texts``
    gives them. A document's entries meet in one row, in which the last place is carried from entry to entry.
    """
    own = F.struct(F.col("seq").cast("long").alias("seq"), F.col("page").cast("long").alias("page"), "number", "title")
    all_ = entries.groupBy(doc).agg(F.sort_array(F.collect_list(own)).alias("es")).join(texts.select(doc, "text", "pages"), doc)
    last = F.size("pages") - 1

    def bounds(acc: Column, e: Column) -> Column:
        page = F.greatest(F.lit(0).cast("long"), F.least(last.cast("long"), e["page"])).cast("int")
        lo = F.greatest(F.col("pages")[F.greatest(F.lit(0), page - 1)]["start"], acc["at"])
        hi = F.col("pages")[F.least(last, page + 1)]["end"]
        lone = F.col("pages")[page]
        return F.struct(F.when(lo < hi, lo).otherwise(lone["start"]).alias("lo"), F.when(lo < hi, hi).otherwise(lone["end"]).alias("hi"), lone["start"].alias("top"))

    def step(acc: Column, e: Column) -> Column:
        return F.transform(F.array(bounds(acc, e)), lambda b: placed(acc, e, b))[0]

    def placed(acc: Column, e: Column, b: Column) -> Column:
        window = F.substring(F.col("text"), (b["lo"] + 1).cast("int"), (b["hi"] - b["lo"]).cast("int"))
        return F.transform(F.array(window), lambda w: advanced(acc, e, b, w))[0]

    def advanced(acc: Column, e: Column, b: Column, w: Column) -> Column:
        n, t, some = e["number"], e["title"], e["number"] != ""
        forms = (F.when(some, F.concat(n, F.lit("\n"), t)), F.when(some, F.concat(n, F.lit(" "), t)), F.when(some, F.concat(F.lit("\n"), n, F.lit("\n"))), t)
        hit = F.coalesce(*[_first(w, f) for f in forms], _first(F.lower(w), F.substring(F.lower(t), 1, TITLE_CHARS))).cast("long") + b["lo"]
        at = F.when(hit >= acc["at"], hit).otherwise(F.greatest(acc["at"], b["top"]))
        return F.struct(at.alias("at"), F.array_append(acc["out"], F.struct(e["seq"].alias("seq"), at.alias("start"))).alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<seq:bigint,start:bigint>>").alias("out"))
    places = all_.select(doc, F.explode(F.aggregate("es", begin, step, lambda acc: acc["out"])).alias("p"))
    return entries.join(places.select(doc, F.col("p.seq").alias("seq"), F.col("p.start").alias("start")), [doc, "seq"])


def with_page_stamps(spans: DataFrame, texts: DataFrame, doc: str = "doc", start: str = "char_start", end: str = "char_end") -> DataFrame:
    """Add ``page_start`` and ``page_end``, the pages of a span's first and last character."""
    x = spans.join(texts.select(doc, F.col("pages").alias("_pages")), doc)
    last = F.greatest(F.col(start), F.col(end) - 1)
    return x.withColumn("page_start", page_of(F.col("_pages"), F.col(start))).withColumn("page_end", page_of(F.col("_pages"), last)).drop("_pages")


def paged_text(texts: DataFrame, doc: str = "doc") -> DataFrame:
    """Rows (doc, text, segments): the text with [Page n] over each page, and what leads from one to the other: (page, doc_start, doc_end, view_start)."""
    head = lambda p: F.concat(F.lit("[Page "), (p["page"] + 1).cast("string"), F.lit("]\n"))
    body = lambda p: F.substring(F.col("text"), (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int"))
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<page:bigint,doc_start:bigint,doc_end:bigint,view_start:bigint>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["n"] + F.length(head(p))
        row = F.struct(p["page"].alias("page"), p["start"].alias("doc_start"), p["end"].alias("doc_end"), at.cast("long").alias("view_start"))
        return F.struct((at + p["end"] - p["start"]).cast("long").alias("n"), F.array_append(acc["out"], row).alias("out"))

    return texts.select(doc, F.array_join(F.transform("pages", lambda p: F.concat(head(p), body(p))), "").alias("text"), F.aggregate("pages", begin, step, lambda acc: acc["out"]).alias("segments"))
