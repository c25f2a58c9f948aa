"""What is shown and exported: references, prompts, bands, fingerprints of context, audit rows; pieces of glued list items."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, tokens

# Words that say little in a coverage check, and list marks inside a sentence.
CONTENT_STOP = "subject subjects patient patients must should prior study drug dose within least protocol amendment part cohort criteria".split()
MARKS = "‒–—•*"


def score_band(score: Column, high: float = 0.8, middle: float = 0.5) -> Column:
    return F.when(score >= high, "high").when(score >= middle, "medium").when(score.isNotNull(), "low")


def four_places(score: Column) -> Column:
    """A score with four digits as C's printf writes it: by the double's binary value. Java's formats take the halves of the written number instead."""
    return F.pandas_udf(lambda s: s.map(lambda v: None if v != v else f"{v:.4f}"), "string")(score.cast("double"))


def percent(share: Column) -> Column:
    """A share as whole percents, halves away from zero; a dash where there is none."""
    return F.coalesce(F.concat(F.round(share * 100, 0).cast("long").cast("string"), F.lit("%")), F.lit("–"))


#: Schemes by which a figure is shown: (lowest value, word) from the top; what is below all has the last word.
BANDS = {"confidence": ((0.8, "high"), (0.5, "medium"), (None, "low")), "match": ((80.0, "strong"), (55.0, "fair"), (None, "weak")), "majority": ((50.000001, "yes"), (None, "no"))}


def band(value: Column, scheme: str) -> Column:
    """The word of a figure's band; null where there is no figure."""
    out = None
    for least, word in BANDS[scheme]:
        if least is None:
            out = F.when(value.isNotNull(), word) if out is None else out.when(value.isNotNull(), word)
        else:
            out = F.when(value >= least, word) if out is None else out.when(value >= least, word)
    return out


def prompts(questions: DataFrame, hits: DataFrame, history: DataFrame, key: str, template: str, most_turns: int = 6) -> DataFrame:
    """Add ``prompt`` to (key, question): the template's {context}, {history} and {question} filled in.

    Passages (key, rnk, source, page, score, text) are numbered in the order of their rank; the last ``most_turns`` turns (key, turn, role,
    text) stand in order under a heading, which goes where there are none. What the texts hold is not looked at as a template.
    """
    number = F.row_number().over(Window.partitionBy(key).orderBy("rnk"))
    line = F.format_string("\n[Context %d] Source: %s | Page: %s | Confidence: %s\n%s\n", number, F.col("source"), F.col("page").cast("string"), four_places(F.col("score")), F.col("text"))
    joined = lambda df, n, c: df.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(n).alias("n"), F.col(c).alias("t")))), lambda s: s["t"]), "").alias(c))
    context = joined(hits.withColumn("context", line), "rnk", "context")
    last = history.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("turn")))).where(F.col("_n") <= most_turns)
    said = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), "text", F.lit("\n"))
    turns = joined(last.withColumn("history", said), "turn", "history").withColumn("history", F.concat(F.lit("\n## CONVERSATION HISTORY\n"), "history", F.lit("\n")))
    x = questions.join(context, key, "left").join(turns, key, "left")
    values = {"context": F.coalesce("context", F.lit("")), "history": F.coalesce("history", F.lit("")), "question": F.col("question")}
    parts = [values[p] if i % 2 else F.lit(p) for i, p in enumerate(re.split(r"\{(context|history|question)\}", template))]
    return x.withColumn("prompt", F.concat(*parts)).drop("context", "history")


def html_escape(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def without_fence(reply: Column) -> Column:
    """A reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), "^```[A-Za-z]*", ""), "```$", ""))


def list_pieces(sentence: Column) -> Column:
    """Pieces of a sentence that list marks glue together, without their marks; the sentence where nothing is left."""
    marked = F.regexp_replace(normalize(sentence), f"(^| )[{MARKS}] ", "\u0001")
    parts = F.filter(F.transform(F.split(marked, "\u0001"), lambda x: F.trim(x)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(sentence))


def content_tokens(text: Column) -> Column:
    """Distinct stemmed tokens of over three characters, without words that say little here."""
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) > 3) & ~w.isin(CONTENT_STOP)))


def item_coverage(items: DataFrame, key: str, item: str, answer: str) -> DataFrame:
    """Rows (key, covered, uncovered): an item is covered by two shared content tokens, by one where it has two or fewer; items without any don't count."""
    i, a = content_tokens(F.col(item)), content_tokens(F.col(answer))
    x = items.select(key, i.alias("i"), F.size(F.array_intersect(i, a)).alias("n")).where(F.size("i") > 0)
    hit = F.col("n") >= F.when(F.size("i") <= 2, 1).otherwise(2)
    return x.groupBy(key).agg(F.count_if(hit).alias("covered"), F.count_if(~hit).alias("uncovered"))


def _joined(sep: str, by: str, what: Column) -> Column:
    """The group's strings in order of ``by``; groups are the few hits of one answer."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), what.alias("v")))), lambda x: x["v"]), sep)


def context_rows(hits: DataFrame, query: str, doc: str, page: str, score: str, rank: str, text: str) -> DataFrame:
    """Rows (query, fingerprint, refs, prompt) over ranked hits: doc:page:score, written-out references, numbered passages."""
    hits = hits.withColumn("_number", four_places(F.col(score)))
    number = F.col("_number")
    mark = F.concat_ws(":", doc, page, number)
    ref = F.concat(F.col(doc).cast("string"), F.lit(" p."), (F.col(page) + 1).cast("string"), F.lit(" (conf: "), number, F.lit(")"))
    passage = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), normalize(F.col(text)))
    return hits.groupBy(query).agg(_joined("|", rank, mark).alias("fingerprint"), _joined(" | ", rank, ref).alias("refs"), _joined("\n\n", rank, passage).alias("prompt"))


def formatted_answer(answer: Column, requirements: Column, passages: Column) -> Column:
    """Answer, bulleted requirements and passages, parted by blank lines; empty parts are left out."""
    bullets = F.array_join(F.transform(requirements, lambda r: F.concat(F.lit("- "), r)), "\n")
    return F.concat_ws("\n\n", F.nullif(answer, F.lit("")), F.nullif(bullets, F.lit("")), F.nullif(passages, F.lit("")))


def paired_tags(tags: Column, reasons: Column) -> Column:
    """Array of (tag, reason): comma-parted tags with bar-parted reasons by position; null reasons where there are fewer."""
    t, r = F.filter(F.transform(F.split(tags, ","), lambda x: F.trim(x)), lambda x: x != ""), F.transform(F.split(reasons, r"\|"), lambda x: F.trim(x))
    return F.transform(t, lambda x, i: F.struct(x.alias("tag"), F.get(r, i).alias("reason")))


def cited_titles(citations: DataFrame, registry: DataFrame, query: str, label: str, pos: str) -> DataFrame:
    """Rows (query, titles): title (date) of each cited document once, in order of first citation."""
    first = citations.groupBy(query, label).agg(F.min(pos).alias("_p")).join(registry.select(label, "title", "date"), label)
    return first.groupBy(query).agg(_joined("; ", "_p", F.concat(F.col("title"), F.lit(" ("), F.coalesce("date", F.lit("n.d.")), F.lit(")"))).alias("titles"))


def whole_sections(chunks: DataFrame, picked: DataFrame, section: str, chunk: str) -> DataFrame:
    """All chunks of the picked sections with score 1, in order of their ids; no top-k."""
    return chunks.join(picked.select(section).distinct(), section, "left_semi").select(section, chunk, F.lit(1.0).alias("score"), F.row_number().over(Window.partitionBy(section).orderBy(chunk)).cast("long").alias("pos"))


