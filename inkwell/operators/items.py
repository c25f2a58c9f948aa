"""List markers, navigational text, text rebuilt from overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences
from .chunking import LEAST_TOKENS, SIZE, STEP

# Marker styles, the first that matches counts; roman numbers from 1 on; leaders to page numbers.
MARKERS = {
    "paren_num": r"^\s*(\d{1,3})\)(?:\s+|\s*$)",
    "paren_alpha": r"^\s*([a-z])\)(?:\s+|\s*$)",
    "roman": r"^\s*((?i:x{0,3}(?:ix|iv|v?i{1,3}|v)))\.(?:\s+|\s*$)",
    "dot_num": r"^\s*(\d{1,3})\.(?:\s+(?=[A-Za-z(])|\s*$)",
    "bullet": r"^\s*([•●▪–\-])(?:\s+|\s*$)",
}
ROMAN = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split()
LEADERS = (r"\.{3,}\s*\d+\s*$", r"^\s*\d+(\.\d+)*\s+\S.*\s\d{1,3}\s*$")


def with_markers(lines: DataFrame, text: str = "text") -> DataFrame:
    """Add style, marker, ordinal and body; lines without a marker have the trimmed line as body and nulls beside it."""
    t = F.col(text)
    by_style = lambda of: F.coalesce(*[F.when(F.col("style") == s, of(p)) for s, p in MARKERS.items()])
    x = lines.withColumn("style", F.coalesce(*[F.when(t.rlike(p), s) for s, p in MARKERS.items()]))
    x = x.withColumn("marker", by_style(lambda p: F.regexp_extract(t, p, 1)))
    roman = F.nullif(F.array_position(F.array(*map(F.lit, ROMAN)), F.lower("marker")), F.lit(0).cast("long"))
    ordinal = F.when(F.col("style").isin("paren_num", "dot_num"), F.col("marker").try_cast("long")).when(F.col("style") == "paren_alpha", F.ascii("marker").cast("long") - 96).when(F.col("style") == "roman", roman)
    return x.withColumn("ordinal", ordinal).withColumn("body", F.trim(F.coalesce(by_style(lambda p: F.regexp_replace(t, p, "")), t)))


def navigational(lines: Column, least: int = 10, share: float = 0.4) -> tuple[Column, Column, Column]:
    """Non-blank lines, the share of them that are leaders to page numbers, and whether such lines make up the text."""
    full = F.filter(lines, lambda x: x.rlike(r"\S"))
    n = F.size(full)
    ratio = F.when(n > 0, F.size(F.filter(full, lambda x: x.rlike(LEADERS[0]) | x.rlike(LEADERS[1]))) / n).otherwise(0.0)
    return n.cast("long"), ratio, (n >= least) & (ratio > share)


def rebuilt_text(text: Column) -> Column:
    """A page's text from its overlapping sentence chunks: each sentence of a kept chunk once, where it first stands."""

    def rebuilt(s: Column) -> Column:
        windows = F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: i % STEP == 0), lambda i: F.slice(s, i + 1, F.lit(SIZE)))
        kept = F.filter(windows, lambda w: F.length(F.array_join(w, " ")) / 4 > LEAST_TOKENS)
        return F.array_join(F.array_distinct(F.filter(F.flatten(kept), lambda x: x != "")), " ")

    return F.transform(F.array(sentences(text)), rebuilt)[0]  # a lambda's variable: the text is split once, not again for each window
