"""Queries of ranked evidence and span geometry over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, ranking, retrieval, spans
from ..sources.tables import table
from .question_queries import SENTENCES, TOKENS


def _hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    near = retrieval.nearest(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q")), e, "q_id", "vec_id", k)
    return near.join(e.select("vec_id", "label"), "vec_id")


def _hits_by_label(spark: SparkSession, d: str, k: int, labels: str = "true") -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieval.nearest(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q")), e.where(labels), "q_id", "vec_id", k, within="label")


def dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    return ranking.filtered_top_k(_hits_by_label(spark, d, 3).select("vec_id", "q_id", "score", "label"), "q_id", "label", "vec_id", "score", 3)


def multi_doc_merge(spark: SparkSession, d: str) -> DataFrame:
    x = _hits_by_label(spark, d, 10, "label in (0, 3, 7)").withColumn("page", F.expr("vec_id div 3"))
    return ranking.merged_documents(x, "q_id", "label", "vec_id", "score", ["page"]).select("q_id", "vec_id", "score", "rnk")


def title_scores(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<h1[^>]*>([^<]*)", 1).alias("title"))
    asked = titles.select((F.col("page_id") + 1).alias("q_id"), F.concat(F.lit("What about "), F.substring_index("title", " ", 3), F.lit(" studies")).alias("text"))
    return ranking.title_scores(asked, titles, "q_id", "page_id")


def evidence_concentration(spark: SparkSession, d: str) -> DataFrame:
    return ranking.concentration(_hits(spark, d, ranking.TOP_HITS), "q_id", "label", "vec_id", "score")


def subquery_agreement(spark: SparkSession, d: str) -> DataFrame:
    x = retrieval.top_k(_hits(spark, d, 10), "q_id", "vec_id", "score", 10).withColumn("question", F.expr("q_id div 50 % 3"))
    fused = x.groupBy("question", "vec_id").agg(F.max("score").alias("score"))
    return ranking.subquery_agreement(x, retrieval.top_k(fused, "question", "vec_id", "score", 10).select("question", "vec_id"), "question", "q_id", "vec_id")


def _cover(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "embeddings").select("vec_id", "label", (200 + F.col("vec_id") % 5 * 100).alias("size"))
    kept = retrieval.top_k(_hits(spark, d, 10), "q_id", "vec_id", "score", 10).select("q_id", "vec_id", "label")
    return ranking.section_cover(kept, members, "q_id", "label", "vec_id", "size")


def section_completion(spark: SparkSession, d: str) -> DataFrame:
    return ranking.section_completion(_cover(spark, d), "q_id", "label")


def section_completeness(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "embeddings").select("label", F.col("label").alias("n_items")).distinct()
    return ranking.section_completeness(_cover(spark, d), items, "q_id", "label")


def item_grounding(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("source", (60.0 + F.col("doc_id") % 41).cast("double").alias("score"))
    return ranking.item_grounding(x.withColumn("label", evidence.grounding_label(F.col("score"), 92, 75)), "source")


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    return evidence.align_exact(table(spark, d, "documents"), table(spark, d, "benchmark"))


def best_doc_for_quote(spark: SparkSession, d: str) -> DataFrame:
    a = _aligned(spark, d).withColumn("score", F.lit(100.0))
    return spans.best_document(a, a.where("doc_id % 2 = 1"), "item_id", "doc_id", "score")


def snap_to_sentences(spark: SparkSession, d: str) -> DataFrame:
    return spans.snap_to_sentences(_aligned(spark, d), table(spark, d, "documents"), "doc_id", "item_id")


def evidence_alignment(spark: SparkSession, d: str) -> DataFrame:
    quotes = table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 5).alias("question"))
    chunks = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 5).alias("question"))
    return spans.alignment_rates(quotes, chunks, _aligned(spark, d).withColumn("score", F.lit(100.0)), "question", "item_id", "doc_id", "score")


def _event_spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", (F.expr("event_id % 5000") * 3).alias("start")).withColumn("end", F.col("start") + 10 + F.col("start") % 7)


def highlight_nonoverlap(spark: SparkSession, d: str) -> DataFrame:
    return spans.highlights(_event_spans(spark, d), "user_id", "event_id")


def view_spans(spark: SparkSession, d: str) -> DataFrame:
    e = _event_spans(spark, d)
    return spans.to_view(e, spans.view_segments(evidence.merge_intervals(e, "user_id"), "user_id"), "user_id", "event_id")


def offset_section(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    starts = spans.sentence_spans(docs, "doc_id").where("s > 20").select("doc_id", F.col("s").alias("start"))
    at = docs.select("doc_id", F.explode(F.array(*map(F.lit, (0, 50, 200)))).alias("j")).select("doc_id", F.col("j").cast("long").alias("no"), (F.col("j") + F.col("doc_id") % 17).cast("long").alias("at"))
    return spans.place_of(at, starts, "doc_id", "no")


_HITS = "h as (select q.vec_id as q_id, e.vec_id, e.label, round(list_inner_product(q.embedding::double[], e.embedding::double[]), 6) as score from embeddings e, embeddings q where q.vec_id % 50 = 0)"
_TOP = lambda k: f"t as (select *, row_number() over (partition by q_id order by score desc, vec_id) as rnk from h qualify rnk <= {k})"
_COVER = f"""{_HITS}, {_TOP(10)}, m as (select vec_id, label, 200 + vec_id % 5 * 100 as size from embeddings), a as (select label, count(*) as n_all, sum(size)::bigint as size from m group by 1),
c as (select q_id, label, count(*) as n_hits, n_all, count(*) / n_all as coverage, sum(m.size)::bigint as used, (a.size - sum(m.size))::bigint as cost from t join m using (vec_id, label) join a using (label) group by q_id, label, n_all, a.size)"""
_NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_ALIGNED = f"al as (select doc_id, item_id, p - 1 as start, p - 1 + length(quote) as e from (select doc_id, item_id, quote, instr(norm, quote) as p from (select doc_id, {_NORM} as norm from documents), (select item_id, {_NORM} as quote from benchmark) where length(quote) >= 12) where p > 0)"
_SPANS = f"s1 as (select doc_id, unnest(s) as t, unnest(range(0, len(s))) as i from (select doc_id, {SENTENCES} as s from documents)), ss as (select doc_id, coalesce(sum(length(t) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as s, length(t) as n from s1)"
_EVENTS = """e as (select user_id, event_id, event_id % 5000 * 3 as s, event_id % 5000 * 3 + 10 + event_id % 5000 * 3 % 7 as e from events)"""
_T = lambda c: TOKENS.replace("lower(text)", f"lower({c})")

ORACLES = {
    "dense_filtered": f"with {_HITS} select *, row_number() over (partition by q_id, label order by score desc, vec_id) as rnk from h qualify rnk <= 3",
    "multi_doc_merge": f"with {_HITS}, l as (select * from h where label in (0, 3, 7) qualify row_number() over (partition by q_id, label order by score desc, vec_id) <= 10), o as (select * from l qualify row_number() over (partition by q_id, label, vec_id // 3 order by score desc, vec_id) = 1) select q_id, vec_id, score, row_number() over (partition by q_id order by score desc, vec_id) as rnk from o qualify rnk <= 10",
    "title_scores": f"""with p as (select page_id, regexp_extract(html, '<h1[^>]*>([^<]*)', 1) as title from pages), q as (select q_id, len(t) as nq, unnest(t) as t from (select page_id + 1 as q_id, list_distinct({_T("'What about ' || array_to_string(string_split(title, ' ')[1:3], ' ') || ' studies'")}) as t from p)),
s as (select page_id, len(t) as nt, unnest(t) as t from (select page_id, list_distinct({_T('title')}) as t from p)), b as (select q_id, page_id, nq, nt, count(*) as b from q join s using (t) group by all),
r as (select q_id, page_id, round(0.85::double * (b / nq) + 0.15::double * (2 * b / (nq + nt)), 6) as score from b) select *, row_number() over (partition by q_id order by score desc, page_id) as rnk from r qualify rnk <= 10""",
    "evidence_concentration": f"with {_HITS}, {_TOP(25)}, m as (select q_id, label, sum(score) as m, count(*) as n from t group by 1, 2) select q_id, label as dominant, round(m / sum(m) over (partition by q_id), 4) as concentration, n as hits from m qualify row_number() over (partition by q_id order by round(m, 6) desc, label) = 1",
    "subquery_agreement": f"with {_HITS}, {_TOP(10)}, g as (select q_id // 50 % 3 as question, vec_id, max(score) as score, count(distinct q_id) as n from t group by 1, 2), f as (select * from g qualify row_number() over (partition by question order by score desc, vec_id) <= 10) select question, round(avg((n > 1)::int::double), 4) as agreement_ratio, round(avg(n), 3) as mean_hits from f group by 1",
    "section_completion": f"""with recursive {_COVER}, r as (select q_id, label, cost, row_number() over (partition by q_id order by n_hits desc, label) as rn from c where (coverage >= 0.3 or n_hits >= 3) and n_hits < n_all),
f as (select q_id, 0::bigint as rn, null::int as label, sum(used)::bigint as used, false as done from c group by 1 union all select r.q_id, r.rn, r.label::int, (case when f.used + r.cost <= 60000 then f.used + r.cost else f.used end)::bigint, f.used + r.cost <= 60000 from f join r on r.q_id = f.q_id and r.rn = f.rn + 1)
select q_id, label, round(coverage, 4) as coverage, coalesce(done, false) as completed from c left join f using (q_id, label)""",
    "section_completeness": f"with {_COVER} select q_id, round(avg(coverage), 4) as coverage_ratio, count(*) filter (label >= 4) as list_total, count(*) filter (label >= 4 and n_hits >= n_all) as list_complete, count(*) filter (label >= 4 and n_hits < n_all) as list_partial from c group by 1",
    "item_grounding": "with x as (select source, (60 + doc_id % 41)::double as s from documents) select source, round(count(*) filter (s >= 92) / count(*), 4) as ratio, round(avg(s), 2) as mean_score, count(*) filter (s >= 92) as grounded, count(*) filter (s < 92 and s >= 75) as partial, count(*) filter (s < 75) as ungrounded from x group by 1",
    "best_doc_for_quote": f"with {_ALIGNED} select item_id, doc_id, case when doc_id % 2 = 1 then 101.5::double else 100.0::double end as adj_score from al qualify row_number() over (partition by item_id order by doc_id % 2 desc, doc_id) = 1",
    "snap_to_sentences": f"with {_ALIGNED}, {_SPANS} select doc_id, item_id, least(start, min(s)) as start, greatest(e, max(s + n)) as \"end\" from al left join ss using (doc_id) where s < e and start < s + n group by doc_id, item_id, start, e",
    "evidence_alignment": f"""with {_ALIGNED}, h as (select item_id % 5 as question, item_id, doc_id from al where item_id % 5 = doc_id % 5), q as (select item_id % 5 as question, count(*) as n from benchmark group by 1), c as (select doc_id % 5 as question, count(*) as n from documents group by 1),
f as (select question, count(distinct item_id) as i, count(distinct doc_id) as d from h group by 1) select question, round(coalesce(i, 0) / q.n, 4) as rate, round(coalesce(d, 0) / c.n, 4) as utilisation from q left join c using (question) left join f using (question)""",
    "highlight_nonoverlap": f"""with recursive {_EVENTS}, r as (select *, row_number() over (partition by user_id order by s, e, event_id) as rn from e),
f as (select user_id, event_id, s, e, rn, true as kept, e as last from r where rn = 1 union all select r.user_id, r.event_id, r.s, r.e, r.rn, r.s >= f.last, case when r.s >= f.last then r.e else f.last end from f join r on r.user_id = f.user_id and r.rn = f.rn + 1) select user_id, event_id, s as start, e as "end" from f where kept""",
    "view_spans": f"""with {_EVENTS}, r as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as reach from e), g as (select *, sum(case when reach is null or s > reach + 2 then 1 else 0 end) over (partition by user_id order by s, e rows unbounded preceding) as n from r),
m as (select user_id, n, min(s) as ms, max(e) as me from g group by 1, 2), v as (select *, coalesce(sum(me - ms + 2) over (partition by user_id order by ms rows between unbounded preceding and 1 preceding), 0) as vs from m)
select user_id, event_id, (vs + s - ms)::bigint as view_from, (vs + e - ms)::bigint as view_to from g join v using (user_id, n)""",
    "offset_section": f"with {_SPANS}, o as (select doc_id, unnest([0, 50, 200])::bigint as no from documents) select doc_id, no, max(s) as place from o left join ss on ss.doc_id = o.doc_id and s > 20 and s <= no + o.doc_id % 17 group by all".replace("select doc_id, no, max(s)", "select o.doc_id, no, max(s)"),
}
QUERIES = {name: globals()[name] for name in ORACLES}
