"""Running headers, cleaned lines, text offsets and section extents of documents that come as lines or headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_key

SHARE, LEAST_PAGES, LONGEST = 0.25, 3, 90


def running_lines(lines: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """Rows (doc, key, n_pages): line keys of up to LONGEST characters on a quarter of the document's pages, three at least."""
    keyed = lines.select(doc, page, line_key(F.col(text)).alias("key"))
    pages = lines.groupBy(doc).agg(F.countDistinct(page).alias("pages"))
    counts = keyed.where(F.length("key").between(1, LONGEST)).groupBy(doc, "key").agg(F.countDistinct(page).alias("n_pages"))
    most = F.greatest(F.lit(LEAST_PAGES), F.floor(F.col("pages") * SHARE))
    return counts.join(pages, doc).where(F.col("n_pages") >= most).select(doc, "key", "n_pages")


def line_offsets(lines: DataFrame, doc: str = "doc", page: str = "page", line: str = "line_no", text: str = "text") -> DataFrame:
    """Add ``start`` and ``end`` of each line in the joined text, where a newline follows each line."""
    w = Window.partitionBy(doc).orderBy(page, line).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0)).cast("long")
    return lines.withColumn("start", start).withColumn("end", F.col("start") + F.length(text))


def section_extents(headings: DataFrame, doc: str = "doc", start: str = "start", total: str = "n_chars") -> DataFrame:
    """Add ``end``: where the next heading of any level starts, or the text ends; one character at least."""
    w = Window.partitionBy(doc).orderBy(start)
    return headings.withColumn("end", F.greatest(F.coalesce(F.lead(start).over(w), F.col(total)), F.col(start) + 1).cast("long"))
