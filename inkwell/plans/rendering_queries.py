"""Queries of rendering, exports and item coverage over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rendering, retrieval
from ..sources.exports import export_rows
from ..sources.tables import table
from .question_queries import TOKENS
from .ranking_queries import _HITS, _TOP, _hits


def reply_text(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    fenced = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).otherwise(F.concat(F.lit(" <b>&\""), "text", F.lit("\"</b>")))
    return c.select("conv_id", "turn", F.sha2(rendering.without_fence(fenced), 256).alias("plain_sha"), F.sha2(rendering.html_escape(fenced), 256).alias("html_sha"))


def list_pieces(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.when(F.col("item_id") % 3 == 0, "– ").otherwise(""), F.regexp_replace("text", " (.) ", " • $1 "), F.lit(" * last one"))
    return table(spark, d, "benchmark").select("item_id", F.posexplode(rendering.list_pieces(s)).alias("p", "piece")).select("item_id", F.col("p").cast("long").alias("piece_no"), "piece")


def item_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    pairs = docs.select("doc_id", "source", F.col("text").alias("item")).join(docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("answer")), "doc_id")
    return rendering.item_coverage(pairs, "source", "item", "answer")


def context_render(spark: SparkSession, d: str) -> DataFrame:
    top = retrieval.top_k(_hits(spark, d, 5), "q_id", "vec_id", "score", 5).withColumn("page", F.col("vec_id") % 9)
    x = top.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return rendering.context_rows(x, "q_id", "label", "page", "score", "rnk", "text").select("q_id", "fingerprint", "refs", F.sha2("prompt", 256).alias("prompt_sha"))


def answer_render(spark: SparkSession, d: str) -> DataFrame:
    wants = F.when(F.col("item_id") % 2 == 0, F.slice(F.split("text", " "), 1, 3)).otherwise(F.array().cast("array<string>"))
    shown = rendering.formatted_answer(F.col("text"), wants, F.when(F.col("item_id") % 3 == 0, "see p.1"))
    return table(spark, d, "benchmark").select("item_id", F.sha2(shown, 256).alias("answer_sha"), F.length(shown).cast("long").alias("n_chars"))


def tag_reasons(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat("event_type", F.lit(", slow,, late")).alias("tags"), F.when(F.col("event_id") % 2 == 0, "by type | took long").otherwise("by type").alias("reasons"))
    return e.select("event_id", F.inline(rendering.paired_tags(F.col("tags"), F.col("reasons"))))


def cited_titles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "n_chars")
    known = docs.groupBy("source").agg(F.max("n_chars").alias("m")).select("source", F.upper("source").alias("title"), F.when(F.col("m") % 2 == 0, F.col("m").cast("string")).alias("date"))
    cites = table(spark, d, "documents").select((F.col("doc_id") % 20).alias("q_id"), "source", F.col("doc_id").alias("pos"))
    return rendering.cited_titles(cites, known, "q_id", "source", "pos")


def section_chunks_picked(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return rendering.whole_sections(e, e.where("vec_id % 50 = 0 and label < 4"), "label", "vec_id")


def audit_export(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("entry_id"), F.array(F.col("event_type"), F.lit("seen")).alias("tags"), rendering.score_band(F.col("value") / 100).alias("band"), F.lit(1).alias("_internal"), F.col("user_id").alias("reviewer"))
    return export_rows(e, ["entry_id", "band", "comment", "tags"], rest=True)


_NORM = r"trim(regexp_replace(%s, '\s+', ' ', 'g'))"
_CONTENT = lambda c: f"list_distinct(list_filter({TOKENS.replace('lower(text)', f'lower({c})')}, lambda w: length(w) > 3 and w not in ({', '.join(repr(w) for w in rendering.CONTENT_STOP)})))"

ORACLES = {
    "reply_text": r"""with c as (select conv_id, turn, case when turn % 2 = 0 then '```json' || chr(10) || text || chr(10) || '```' else ' <b>&"' || text || '"</b>' end as t from conversations)
select conv_id, turn, sha256(case when turn % 2 = 0 then trim(substr(t, 8, length(t) - 10)) else trim(t) end) as plain_sha, sha256(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) as html_sha from c""",
    "list_pieces": rf"""with s as (select item_id, {_NORM % "(case when item_id % 3 = 0 then '– ' else '' end || regexp_replace(text, ' (.) ', ' • \\1 ', 'g') || ' * last one')"} as s from benchmark), p as (select item_id, list_filter(list_transform(string_split(regexp_replace(s, '(^| )[‒–—•*] ', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as p from s) select item_id, unnest(range(0, len(p))) as piece_no, unnest(p) as piece from p""",
    "item_coverage": f"with k as (select doc_id, source, {_CONTENT('text')} as k from documents), x as (select a.source, len(a.k) as n, len(list_intersect(a.k, b.k)) as c from k a join k b on a.doc_id = b.doc_id + 1 where len(a.k) > 0) select source, count(*) filter (c >= case when n <= 2 then 1 else 2 end) as covered, count(*) filter (c < case when n <= 2 then 1 else 2 end) as uncovered from x group by 1",
    "context_render": f"with {_HITS}, {_TOP(5)}, x as (select q_id, label, vec_id % 9 as page, printf('%.4f', score) as s, rnk, coalesce({_NORM % 'text'}, '') as n from t left join documents on doc_id = vec_id) select q_id, string_agg(label || ':' || page || ':' || s, '|' order by rnk) as fingerprint, string_agg(label || ' p.' || (page + 1) || ' (conf: ' || s || ')', ' | ' order by rnk) as refs, sha256(string_agg('[' || rnk || '] ' || n, chr(10) || chr(10) order by rnk)) as prompt_sha from x group by 1",
    "answer_render": "with a as (select item_id, array_to_string(list_filter([text, case when item_id % 2 = 0 then array_to_string(list_transform(string_split(text, ' ')[1:3], lambda r: '- ' || r), chr(10)) end, case when item_id % 3 = 0 then 'see p.1' end], lambda x: x is not null and x <> ''), chr(10) || chr(10)) as s from benchmark) select item_id, sha256(s) as answer_sha, length(s) as n_chars from a",
    "tag_reasons": "select event_id, unnest([event_type, 'slow', 'late']) as tag, unnest(['by type', case when event_id % 2 = 0 then 'took long' end, null]) as reason from events",
    "cited_titles": "with k as (select source, upper(source) as title, case when max(n_chars) % 2 = 0 then max(n_chars)::varchar else 'n.d.' end as date from documents group by 1), f as (select doc_id % 20 as q_id, source, min(doc_id) as p from documents group by 1, 2) select q_id, string_agg(title || ' (' || date || ')', '; ' order by p) as titles from f join k using (source) group by 1",
    "section_chunks_picked": "select label, vec_id, 1.0::double as score, row_number() over (partition by label order by vec_id) as pos from embeddings where label in (select label from embeddings where vec_id % 50 = 0 and label < 4)",
    "audit_export": "select event_id as entry_id, case when value / 100 >= 0.8 then 'high' when value / 100 >= 0.5 then 'medium' when value is not null then 'low' end as band, null::varchar as comment, event_type || ' | seen' as tags, user_id as reviewer from events",
}
QUERIES = {name: globals()[name] for name in ORACLES}
