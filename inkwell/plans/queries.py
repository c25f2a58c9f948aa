"""Queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, evidence, grading, lexical, retrieval, session
from ..sources.tables import table
from . import detail_queries, model_queries, question_queries, ranking_queries, rendering_queries, review_queries, segment_queries, structure_queries
from .queries_sql import NORM, SENTENCES, TOKENS



def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    n = T.normalize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(n).cast("long").alias("norm_chars"), F.sha2(n, 256).alias("norm_sha"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("max_sentence_chars"))


def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.sentence_chunks(table(spark, d, "documents"))
    return c.select("chunk_id", "doc_id", "n_sent", "token_count", F.sha2("chunk", 256).alias("chunk_sha"))


def stem_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = retrieval.term_counts(table(spark, d, "documents"), "doc_id").where("t is not null")
    return t.groupBy(F.col("t").alias("token")).agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("term_freq"))


def key_tokens(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "benchmark").select("item_id", F.array_sort(T.key_tokens(F.col("text"))).alias("k"))
    return k.select("item_id", F.size("k").cast("long").alias("n_tokens"), F.array_join("k", ",").alias("tokens_csv"))


def doc_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    f = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "source", F.col("n_chars").cast("string"), F.lit("chunk_size=6"), F.lit("min_tokens=15")), 256)
    return table(spark, d, "documents").select("doc_id", f.alias("fp64"), F.substring(f, 1, 16).alias("fp16"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id", 10)


def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    return grading.retrieval_quality(bm25_topk(spark, d), "item_id")


def _dense(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieval.nearest(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q")), e, "q_id", "vec_id", k)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top_k(_dense(spark, d, 10), "q_id", "vec_id", "score", 10)


def dense_precision(spark: SparkSession, d: str) -> DataFrame:
    hits = _dense(spark, d, 10).withColumnRenamed("vec_id", "item").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "label"), "item")
    top = retrieval.top_k(hits.select("q_id", "item", "label", "score"), "q_id", "item", "score", 10).drop("rnk")
    return retrieval.precision_filter(top, "q_id", "label")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    hits = _dense(spark, d, 40)
    fused = retrieval.reciprocal_rank_fusion(retrieval.top_k(hits, "q_id", "vec_id", "score", 40).withColumn("question", F.lit(1)), "question", "vec_id")
    return retrieval.top_k(fused, "question", "vec_id", "rrf", 60)


def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and dense rankings of the same questions in one: vector ids count as document ids, every fiftieth as a question."""
    found = lexical.bm25(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id", 40)
    near = _dense(spark, d, 40).select(F.expr("q_id div 50").alias("item_id"), F.col("vec_id").alias("doc_id"), "score")
    both = found.unionByName(retrieval.top_k(near, "item_id", "doc_id", "score", 40))
    return retrieval.top_k(retrieval.reciprocal_rank_fusion(both, "item_id", "doc_id"), "item_id", "doc_id", "rrf", 60)


def align_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return evidence.align_fuzzy(table(spark, d, "documents"), table(spark, d, "benchmark"))


def align_original(spark: SparkSession, d: str) -> DataFrame:
    """Exact places of quotes in the documents' own texts."""
    docs, quotes = table(spark, d, "documents"), table(spark, d, "benchmark")
    pairs = evidence.align_exact(docs, quotes).select("doc_id", "item_id").join(docs.select("doc_id", "text"), "doc_id").join(quotes.select("item_id", F.col("text").alias("quote")), "item_id")
    return evidence.in_original(pairs, "text", "quote").select("doc_id", "item_id", "start", "end")


def multiquery_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The best score of each vector over all queries: vectors look for the query nearest to them."""
    e = table(spark, d, "embeddings")
    best = retrieval.nearest(e.withColumnRenamed("embedding", "q"), e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "q_id"), "vec_id", "q_id", 1)
    return best.select("vec_id", retrieval.rounded(F.col("score"), 4).alias("score"))


def align_exact(spark: SparkSession, d: str) -> DataFrame:
    return evidence.align_exact(table(spark, d, "documents"), table(spark, d, "benchmark"))


def source_view(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", (F.expr("event_id % 5000") * 3).alias("start")).withColumn("end", F.col("start") + 10 + F.col("start") % 7)
    return evidence.merge_intervals(e, "user_id")


def judge_consensus(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "labels").select("doc_id", F.explode(F.array(F.col("quality").cast("double"), F.col("toxic").cast("double"))).alias("score"))
    return grading.judge_consensus(s, "doc_id")


def history_window(spark: SparkSession, d: str) -> DataFrame:
    return session.history_window(table(spark, d, "conversations"))


def transcript_turns(spark: SparkSession, d: str) -> DataFrame:
    return session.transcript_turns(table(spark, d, "conversations"))


def doc_registry(spark: SparkSession, d: str) -> DataFrame:
    return session.registry(table(spark, d, "documents"))


def batch_clean(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "documents").select(F.substring_index("text", "\n", 1).alias("question"), "doc_id")
    return session.ordered_distinct(q, "question", "doc_id")


_SCORED = "select q.vec_id as q_id, e.vec_id, e.label, round(list_inner_product(q.embedding::double[], e.embedding::double[]), 6) as score from embeddings e, embeddings q where q.vec_id % 50 = 0"
_BM25 = f"""q as (select distinct item_id, unnest({TOKENS}) as t from benchmark),
d as (select doc_id, {TOKENS} as ts from documents), st as (select count(*) as n, avg(len(ts)) as avgdl from d),
tf as (select doc_id, dl, t, count(*) as tf from (select doc_id, len(ts) as dl, unnest(ts) as t from d) group by all),
df as (select t, ln((n - df + 0.5) / (df + 0.5)) as raw from (select t, count(*) as df from tf group by t), st), fl as (select avg(raw) * 0.25 as floor from df),
s as (select item_id, doc_id, round(sum(case when raw < 0 then floor else raw end * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from q join tf using (t) join df using (t), st, fl group by all),
top as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rnk from s where score > 0 qualify rnk <= 10)"""
ORACLES = {
    "text_normalize": f"select doc_id, length({NORM}) as norm_chars, sha256({NORM}) as norm_sha from documents",
    "sentence_split": f"select doc_id, len(s) as n_sentences, list_max(list_transform(s, lambda x: length(x))) as max_sentence_chars from (select doc_id, {SENTENCES} as s from documents)",
    "sentence_chunks": f"select doc_id * 16777216 + i // 3 as chunk_id, doc_id, len(p) as n_sent, length(c) / 4 as token_count, sha256(c) as chunk_sha from (select *, array_to_string(p, ' ') as c from (select doc_id, i, s[i + 1 : i + 6] as p from (select doc_id, s, unnest(range(0, len(s), 3)) as i from (select doc_id, {SENTENCES} as s from documents)))) where length(c) / 4 > 15",
    "stem_tokens": f"select token, count(distinct doc_id) as doc_freq, count(*) as term_freq from (select doc_id, unnest({TOKENS}) as token from documents) group by token",
    "key_tokens": "select item_id, len(k) as n_tokens, array_to_string(k, ',') as tokens_csv from (select item_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zA-Z]{4,}'), lambda w: w not in (%s)))) as k from benchmark)" % ", ".join(f"'{w}'" for w in T.KEY_STOP_WORDS),
    "doc_fingerprint": "select doc_id, f as fp64, f[1:16] as fp16 from (select doc_id, sha256(concat_ws('|', doc_id, source, n_chars, 'chunk_size=6', 'min_tokens=15')) as f from documents)",
    "bm25_topk": f"with {_BM25} select item_id, doc_id, score, rnk from top",
    "retrieval_quality": f"""with {_BM25}, r as (select item_id, max(score) as hi, min(score) as lo from top group by 1)
select item_id, round(max(score), 4) as s_max, round(min(score), 4) as s_min, round(avg(score), 4) as s_mean, round(max(score) - min(score), 4) as spread, round(avg((score < 0.4)::int::double), 4) as weak_raw,
round(avg(case when hi = lo then 0.0 else ((score - lo) / (hi - lo) < 0.5)::int::double end), 4) as weak_rescaled from top join r using (item_id) group by item_id""",
    "hybrid_fusion": f"""with {_BM25}, a as (select item_id, doc_id, row_number() over (partition by item_id order by score desc, doc_id) as rnk from s where score > 0 qualify rnk <= 40),
b as (select q_id // 50 as item_id, vec_id as doc_id, row_number() over (partition by q_id order by score desc, vec_id) as rnk from ({_SCORED}) qualify rnk <= 40),
f as (select item_id, doc_id, round(sum(1.0::double / (59 + rnk)), 6) as rrf from (select * from a union all select * from b) group by 1, 2) select *, row_number() over (partition by item_id order by rrf desc, doc_id) as rnk from f qualify rnk <= 60""",
    "align_original": rf"""with p as (select doc_id, item_id, d.text, regexp_extract(d.text, replace(regexp_escape(trim(regexp_replace(b.text, '\s+', ' ', 'g'))), '\ ', '\s+')) as hit from documents d, benchmark b where length({NORM.replace('text', 'b.text')}) >= 12 and instr({NORM.replace('text', 'd.text')}, {NORM.replace('text', 'b.text')}) > 0)
select doc_id, item_id, instr(text, hit) - 1 as start, instr(text, hit) - 1 + length(hit) as "end" from p""",
    "dense_topk": f"select q_id, vec_id, score, row_number() over (partition by q_id order by score desc, vec_id) as rnk from ({_SCORED}) qualify rnk <= 10",
    "dense_precision": f"""with t as (select *, row_number() over (partition by q_id order by score desc, vec_id) as rn, max(score) over (partition by q_id) as best from ({_SCORED}) qualify rn <= 10),
k as (select * from t where (score >= 0.42 or (best < 0.42 and rn = 1)) and score >= 0.72 * best),
m as (select q_id, label, sum(score) as mass, min(rn) as first from k group by 1, 2), l as (select q_id, arg_max(label, (mass, -first)) as lead, max(mass) / sum(mass) as share from m group by 1)
select q_id, vec_id as item, label, score, row_number() over (partition by q_id order by score desc, vec_id) as rnk from k join l using (q_id) where share < 0.6 or label = lead qualify rnk <= 6""",
    "rrf_fusion": f"with r as (select q_id, vec_id, row_number() over (partition by q_id order by score desc, vec_id) as rnk from ({_SCORED}) qualify rnk <= 40), f as (select 1::int as question, vec_id, round(sum(1.0::double / (59 + rnk)), 6) as rrf from r group by vec_id) select *, row_number() over (order by rrf desc, vec_id) as rnk from f qualify rnk <= 60",
    "multiquery_fusion": f"select vec_id, round(max(score), 4) as score from ({_SCORED}) group by vec_id",
    "align_exact": f"select doc_id, item_id, p - 1 as start, p - 1 + length(quote) as \"end\", 'grounded' as label from (select doc_id, item_id, quote, instr(norm, quote) as p from (select doc_id, {NORM} as norm from documents), (select item_id, {NORM} as quote from benchmark) where length(quote) >= 12) where p > 0",
    "source_view": """with e as (select user_id, event_id % 5000 * 3 as start, event_id % 5000 * 3 + 10 + event_id % 5000 * 3 % 7 as "end" from events),
r as (select *, max("end") over (partition by user_id order by start, "end" rows between unbounded preceding and 1 preceding) as reach from e),
g as (select *, sum(case when reach is null or start > reach + 2 then 1 else 0 end) over (partition by user_id order by start, "end" rows unbounded preceding) as merged_no from r)
select user_id, merged_no::bigint as merged_no, min(start) as start, max("end") as "end" from g group by 1, 2""",
    "judge_consensus": "select doc_id, round(avg(score), 4) as mean, round(median(score), 4) as median, min(score) as lower, max(score) as upper, round(stddev_pop(score), 4) as std from (select doc_id, unnest([quality::double, toxic::double]) as score from labels) where score is not null group by doc_id",
    "history_window": "select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc, role desc) as pos from conversations qualify pos <= 6",
    "transcript_turns": "select conv_id, p as pos, role, p // 2 + (case when role = 'user' then 1 else 0 end) as turn_no from (select conv_id, role, row_number() over (partition by conv_id order by turn, role) - 1 as p from conversations where role in ('user', 'assistant'))",
    "doc_registry": "select 'd' || row_number() over (order by source) as reg_id, source as label, n_pages from (select source, count(*) as n_pages from documents group by source)",
    "batch_clean": "select row_number() over (order by first_id) as pos, question from (select question, min(doc_id) as first_id from (select trim(split_part(text, chr(10), 1)) as question, doc_id from documents) where question <> '' group by question)",
}
#: What compares by subsequences has no SQL; a test holds it against a plain version.
PLAIN = ("align_fuzzy",)
QUERIES = {name: globals()[name] for name in (*ORACLES, *PLAIN)} | review_queries.QUERIES | question_queries.QUERIES | ranking_queries.QUERIES | rendering_queries.QUERIES | structure_queries.QUERIES | segment_queries.QUERIES | model_queries.QUERIES | detail_queries.QUERIES
ORACLES |= review_queries.ORACLES | question_queries.ORACLES | ranking_queries.ORACLES | rendering_queries.ORACLES | structure_queries.ORACLES | segment_queries.ORACLES | model_queries.ORACLES | detail_queries.ORACLES
