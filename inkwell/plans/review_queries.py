"""Queries of the layout, packing and review operators over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, layout, packing, retrieval, review
from ..sources.tables import table

KEYS = ", ".join(f"'{w}'" for w in T.KEY_STOP_WORDS)
_key_tokens = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-zA-Z]{{4,}}'), lambda w: w not in ({KEYS})))"
LINES = "(select doc, page, i as line_no, ls[i] as text from (select source as doc, doc_id as page, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents))"
KEY = r"regexp_replace(trim(regexp_replace(text, '[ \t]+', ' ', 'g')), '[0-9]+', '#', 'g')"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc", "page", (F.col("p") + 1).cast("long").alias("line_no"), "text")


def running_lines(spark: SparkSession, d: str) -> DataFrame:
    parts = F.explode(F.split("html", ">")).alias("text")
    return layout.running_lines(table(spark, d, "pages").select((F.col("page_id") % 5).alias("doc"), F.col("page_id").alias("page"), parts))


def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    x = layout.line_offsets(_lines(spark, d).drop("doc").withColumnRenamed("page", "doc").withColumn("page", F.lit(0)))
    return x.select("doc", "line_no", "start", "end")


def section_extents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.length("text").cast("long").alias("n_chars"), T.sentences(F.col("text")).alias("s"))
    heads = docs.select("doc", "n_chars", F.posexplode("s").alias("i", "t")).where("i % 5 = 0").select("doc", "n_chars", (F.col("i") * 40).cast("long").alias("start"))
    return layout.section_extents(heads).select("doc", "start", "end")


def chunk_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.sentence_chunks(table(spark, d, "documents")).withColumn("n", F.length("chunk"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("n"), 4).alias("mean_chars"), F.round(F.percentile("n", 0.95), 4).alias("p95_chars"), F.max("n").cast("long").alias("max_chars"))


def answer_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.length("text").cast("long").alias("chars"), F.bround(F.length("text") / 4, 0).cast("long").alias("approx_tokens"))


def _queries_and_hits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    hits = retrieval.nearest(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q")), e, "q_id", "vec_id", 10)
    top = retrieval.top_k(hits, "q_id", "vec_id", "score", 10)
    return top.join(e.select("vec_id", "label"), "vec_id")


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return packing.with_neighbours(_queries_and_hits(spark, d), table(spark, d, "embeddings"), "q_id", "vec_id", "label", "score")


def agreement(spark: SparkSession, d: str) -> DataFrame:
    sets = _queries_and_hits(spark, d).select(F.lit(1).alias("question"), "q_id", "vec_id")
    return packing.pairwise_agreement(sets, "question", "q_id", "vec_id")


def budget_pack(spark: SparkSession, d: str) -> DataFrame:
    hits = _queries_and_hits(spark, d).withColumn("size", 5_000 + F.col("vec_id") % 7 * 4_000)
    return packing.budget_pack(hits, "q_id", "vec_id", "rnk", "size")


def requirement_coverage(spark: SparkSession, d: str) -> DataFrame:
    b, docs = table(spark, d, "benchmark"), table(spark, d, "documents").select("doc_id", F.col("text").alias("answer"))
    pairs = b.select("item_id", "text", F.explode(F.array(*[(F.col("item_id") * 3 + i).cast("long") for i in range(4)])).alias("doc_id")).join(docs, "doc_id")
    return review.requirement_coverage(pairs, "item_id", "text", "answer")


def review_priority(spark: SparkSession, d: str) -> DataFrame:
    p = review.review_priority(F.col("n_chars") / 5_000, F.col("quality").cast("double"), F.col("toxic") / 4)
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.round(p, 4).alias("priority"))


def latest_decision(spark: SparkSession, d: str) -> DataFrame:
    return review.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def pending_queue(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.expr("event_id % 3 = 0"), "pending").otherwise("approved").alias("status"), F.round("value", 2).alias("priority"))
    return review.pending_queue(e, "event_id", "status", "priority", 50)


def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return review.status_rollup(table(spark, d, "events"), "event_type", F.col("value") >= 10)


_TOP = "(select * from (select q.vec_id as q_id, e.vec_id, e.label, round(list_inner_product(q.embedding::double[], e.embedding::double[]), 6) as score from embeddings e, embeddings q where q.vec_id % 50 = 0) qualify row_number() over (partition by q_id order by score desc, vec_id) <= 10)"
_SENTENCES = rf"string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1))"
ORACLES = {
    "running_lines": f"with l as (select page_id % 5 as doc, page_id as page, unnest(string_split(html, '>')) as text from pages), k as (select doc, page, {KEY} as key from l), p as (select doc, count(distinct page) as pages from l group by 1) select doc, key, count(distinct page) as n_pages from k join p using (doc) where length(key) between 1 and 90 group by doc, key, pages having count(distinct page) >= greatest(3, floor(pages * 0.25))",
    "line_offsets": f"select page as doc, line_no, e - length(text) as start, e as \"end\" from (select page, line_no, text, (sum(length(text) + 1) over (partition by page order by line_no) - 1)::bigint as e from {LINES})",
    "section_extents": f"""select doc, start, greatest(coalesce(lead(start) over (partition by doc order by start), n_chars), start + 1)::bigint as "end" from (select doc_id as doc, length(text) as n_chars, unnest(range(0, len({_SENTENCES}), 5)) * 40 as start from documents)""",
    "chunk_diagnostics": f"select doc_id, count(*) as chunks, round(avg(n), 4) as mean_chars, round(quantile_cont(n::double, 0.95), 4) as p95_chars, max(n)::bigint as max_chars from (select doc_id, length(array_to_string(s[i + 1 : i + 6], ' ')) as n from (select doc_id, s, unnest(range(0, len(s), 3)) as i from (select doc_id, {_SENTENCES} as s from documents))) where n / 4 > 15 group by doc_id",
    "answer_length": "select conv_id, turn, length(text) as chars, round_even(length(text) / 4, 0)::bigint as approx_tokens from conversations where role = 'assistant'",
    "neighbours": f"with t as {_TOP} select n.q_id, n.vec_id, n.label, coalesce(t.score, 0.0::double) as score from (select distinct t.q_id, e.vec_id, e.label from t join embeddings e on e.label = t.label and e.vec_id between t.vec_id - 1 and t.vec_id + 1) n left join t on n.q_id = t.q_id and n.vec_id = t.vec_id",
    "agreement": f"with t as {_TOP}, s as (select q_id, list(vec_id) as v from t group by 1) select 1::int as question, round(avg(len(list_intersect(a.v, b.v)) / len(list_distinct(list_concat(a.v, b.v)))), 4) as agreement from s a join s b on a.q_id < b.q_id",
    "budget_pack": f"with recursive t as (select q_id, vec_id, 5000 + vec_id % 7 * 4000 as size, row_number() over (partition by q_id order by score desc, vec_id) as rnk from {_TOP}), f as (select q_id, vec_id, rnk, size <= 60000 as kept, (case when size <= 60000 then size else 0 end)::bigint as used from t where rnk = 1 union all select t.q_id, t.vec_id, t.rnk, f.used + t.size <= 60000, (case when f.used + t.size <= 60000 then f.used + t.size else f.used end)::bigint from f join t on t.q_id = f.q_id and t.rnk = f.rnk + 1) select q_id, vec_id, rnk, used from f where kept",
    "requirement_coverage": f"select item_id, count(*) filter (hit) as covered, count(*) filter (not hit) as uncovered from (select item_id, len(list_intersect(r, a)) >= (case when len(r) <= 2 then 1 else 2 end) as hit from (select item_id, {_key_tokens('b.text')} as r, {_key_tokens('d.text')} as a from (select item_id, text, unnest([item_id * 3, item_id * 3 + 1, item_id * 3 + 2, item_id * 3 + 3]) as doc_id from benchmark) b join documents d using (doc_id))) group by item_id",
    "review_priority": "select doc_id, round(coalesce(greatest(0.0::double, least(1.0::double, (case when quality is null then n_chars / 5000 else 0.5::double * (n_chars / 5000) + 0.5::double * quality end) - coalesce(toxic / 4, 0.0::double))), 0.0::double), 4) as priority from documents left join labels using (doc_id)",
    "latest_decision": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "pending_queue": "select event_id, 'pending' as status, round(value, 2) as priority, row_number() over (order by round(value, 2), event_id) as pos from events where event_id % 3 = 0 qualify pos <= 50",
    "status_rollup": "select event_type, count(*) as total, count(*) filter (value >= 10) as ok_count, count(*) filter (not value >= 10) as error_count from events group by event_type",
}
QUERIES = {name: globals()[name] for name in ORACLES}
