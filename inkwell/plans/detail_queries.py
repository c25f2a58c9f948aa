"""Queries of listings, keys, bands, prompts, page chunks and title fields over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T
from ..operators import catalog, chunking, claims, ranking, rendering, retrieval, review, spans, structure, understanding, validation
from ..sources.tables import table
from .queries_sql import SENTENCES, TOKENS


def file_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", dates.file_fingerprint(F.col("url"), F.length("html"), F.col("page_id") * 7, structure.CHUNK, structure.OVERLAP).alias("fingerprint"))


def document_listing(spark: SparkSession, d: str) -> DataFrame:
    """Sources are documents, each text a chunk on one of 37 pages and in one of its language's sections; one source has no chunks."""
    docs = table(spark, d, "documents").select("source", (F.col("doc_id") % 37).alias("page"), "lang", "text")
    return catalog.listing(docs.select("source").distinct(), docs.where("source <> 'src3'"), "source", "page", "lang", "text")


def document_labels(spark: SparkSession, d: str) -> DataFrame:
    """Events name documents by their user's id; a registry may hold an id twice."""
    r = table(spark, d, "documents").select((F.col("doc_id") % 90).alias("reg_id"), F.concat(F.lit("label "), F.col("doc_id").cast("string")).alias("label"), F.col("doc_id").alias("at"))
    return catalog.labels_of(table(spark, d, "events").select("event_id", (F.col("event_id") % 130).alias("reg_id")), r, "reg_id", "label", "at")


def claim_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Sentences are claims; every fourth says that the context is silent, verdicts go by place. Both ways to count."""
    c = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "s"))
    verdict = F.element_at(F.array(*map(F.lit, ("supported", "unsupported", "supported", "error", "contradicted"))), (F.col("i") % 5 + 1).cast("int"))
    c = c.select("doc_id", F.when(F.col("i") % 4 == 3, "The context is silent.").otherwise(F.col("s")).alias("claim"), verdict.alias("verdict"))
    strict = claims.claim_rollup(c, "doc_id", meta_counts=True).select("doc_id", F.col("ratio").alias("ratio_of_all"))
    return claims.claim_rollup(c, "doc_id").select("doc_id", "total", "meta", "ratio").join(strict, "doc_id")


def answer_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(claims.answer_sentences(F.col("text"))).alias("no", "s")).select("doc_id", F.col("no").cast("long").alias("no"), F.sha2("s", 256).alias("sentence_sha"))


def display_bands(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    share = F.when(F.col("quality").isNotNull(), F.col("n_chars") % 97 / 96)
    return x.select("doc_id", rendering.percent(share).alias("pct"), rendering.band(share, "confidence").alias("confidence"), rendering.band(share * 100, "match").alias("match"), rendering.band(F.col("n_chars") % 101 * 1.0, "majority").alias("majority"))


def question_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations are questions: their last turn, the turns before it as history, three documents as passages."""
    c = table(spark, d, "conversations")
    q = c.groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "role", "text")).alias("question"), F.max("turn").alias("last"))
    turns = c.join(q.select("conv_id", "last"), "conv_id").where("turn < last").select("conv_id", "turn", "role", F.substring("text", 1, 80).alias("text"))
    docs = table(spark, d, "documents").where("doc_id < 200").select("doc_id", "source", F.substring("text", 1, 60).alias("text"))
    hits = q.select("conv_id", F.explode(F.array(*[F.struct(F.lit(k).alias("rnk"), ((F.col("conv_id") * 3 + k) % 200).alias("doc_id")) for k in range(3)])).alias("h")).where("conv_id % 5 > 0").select("conv_id", "h.rnk", "h.doc_id").join(docs, "doc_id")
    hits = hits.select("conv_id", "rnk", "source", (F.col("doc_id") % 9).alias("page"), (1 - F.col("rnk") / 4).alias("score"), "text")
    x = rendering.prompts(q.select("conv_id", "question"), hits, turns, "conv_id", "ROLE {x}\n{history}\nCONTEXT{context}\nQ: {question}\n")
    return x.select("conv_id", F.sha2("prompt", 256).alias("prompt_sha"), F.length("prompt").cast("long").alias("n_chars"))


def review_calls(spark: SparkSession, d: str) -> DataFrame:
    """Questions are documents; the retrieval mean is missing where nothing was retrieved, a judge where it has no label."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    priority, always = review.guidance_priority(F.when(F.col("doc_id") % 6 > 0, F.col("n_chars") % 64 / 64), F.col("quality").cast("double"), F.col("toxic") / 4)
    return x.select("doc_id", F.round(priority, 4).alias("priority"), always.alias("no_context"))


def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents are pages of their source."""
    x = chunking.page_chunks(table(spark, d, "documents").withColumnRenamed("source", "doc"), "doc", "doc_id")
    return x.select("doc", F.col("doc_id").alias("page"), "window", "n_sent", "token_count", F.sha2("chunk", 256).alias("chunk_sha"))


def line_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of documents' lines by their length; every third line has none. Offsets are every 333 characters."""
    docs = table(spark, d, "documents")
    lines = structure.text_lines(docs).where("no > 0").select("doc_id", "start", F.when(F.col("no") % 3 > 0, F.length("line") % 40 * 1.5).alias("x"))
    at = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(333))).alias("at")).select("doc_id", F.col("at").cast("long").alias("at"), F.col("at").cast("long").alias("key"))
    return spans.line_edges(at, lines, "doc_id", "key").select("doc_id", F.col("key").alias("at"), "x")


def section_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles are the first words of documents, full titles with their source's number, paths with the language's first document."""
    s = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 25).alias("title"), F.concat_ws(" ", F.substring("text", 1, 40), "source").alias("full_title"), F.concat_ws(" > ", "lang", F.substring("text", 1, 90)).alias("path"))
    return ranking.section_title_scores(table(spark, d, "benchmark"), s, "item_id", "doc_id")


def section_concentration(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") % 400).alias("q"), (F.col("l_partkey") % 12).alias("sec"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("item"), F.col("l_quantity").cast("double").alias("score"))
    x = x.groupBy("q", "sec", "item").agg(F.max("score").alias("score"))
    sections = x.select("sec").distinct().withColumn("navigational", F.col("sec") % 5 == 0)
    return ranking.section_concentration(x, sections, "q", "sec", "item", "score")


def grader_suite(spark: SparkSession, d: str) -> DataFrame:
    """Answers are documents; graders are labels, lengths of the English ones, and rounded shares of every third."""
    docs = table(spark, d, "documents")
    judge = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("judge"), F.max("toxic").alias("flagged"))
    size = docs.where("lang = 'en'").select("doc_id", F.col("n_chars").alias("chars"))
    share = docs.where("doc_id % 3 = 0").select("doc_id", (F.col("n_chars") % 10 / 10).alias("share"))
    return validation.flat_suite(docs.select("doc_id", "source"), [judge, size, share], "doc_id")


def hits_over_documents(spark: SparkSession, d: str) -> DataFrame:
    """Labels are documents, pages tens of vectors; texts repeat by thirds. Queries ask for two labels, for all, or for none, by their id."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    text = F.concat(F.lit("same beginning of sixty characters and more, for all of a third "), (F.col("vec_id") % 3).cast("string"))
    pages = e.select("vec_id", F.expr("vec_id div 10").alias("page"), F.when(F.col("vec_id") % 2 == 0, text).otherwise(F.concat("vec_id", text)).alias("text"))
    # the best of each document, so the best of all are among them
    hits = retrieval.nearest(q, e.withColumn("doc", F.col("label").cast("long")), "q_id", "vec_id", 10, within="doc").join(pages, "vec_id")
    i = F.expr("q_id div 50")
    asked = q.select("q_id", F.explode(F.when(i % 3 == 0, F.array(i % 10, (i + 1) % 10)).when(i % 3 == 1, F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))).alias("doc"))
    return ranking.hits_over_documents(hits, asked, e.select(F.col("label").cast("long").alias("doc")), "q_id", "doc", "page", "text", "vec_id", "score")


def doc_name_match_base(spark: SparkSession, d: str) -> DataFrame:
    """Base names are the sources, labels say something else; questions are the sources, cut by the document's id."""
    docs = table(spark, d, "documents")
    registry = docs.groupBy("source").agg(F.min("doc_id").alias("i")).select(F.concat(F.lit("id"), F.col("i").cast("string")).alias("reg_id"), F.concat(F.lit("Label "), F.col("i").cast("string")).alias("label"), F.col("source").alias("base_name"))
    q = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("id"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 4 == 1, F.col("source")).when(F.col("doc_id") % 4 == 2, F.expr("substring(source, 2, 3)")).otherwise("LABEL 1").alias("text"))
    return understanding.document_matches(q, registry, "doc_id")


_L = r"l as (select doc_id, generate_subscripts(ls, 1) - 1 as no, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents)), s as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding), 0)::bigint as start from l)"
_BAND = lambda v, c: f"case when {c} " + f" when {c} ".join(f">= {a} then '{w}'" for a, w in rendering.BANDS[v] if a is not None) + f" when {c} is not null then '{rendering.BANDS[v][-1][1]}' end"
_FIELD = lambda e: f"list_distinct({TOKENS.replace('text', e)})"

ORACLES = {
    "file_fingerprint": f"select page_id, sha256(concat_ws('|', url, length(html), page_id * 7, {structure.CHUNK}, {structure.OVERLAP}, 'v3'))[1:16] as fingerprint from pages",
    "document_listing": "select r.source, coalesce(max(case when d.source is not null then d.doc_id % 37 end) + 1, 0) as pages, count(d.source) as chunks, count(distinct d.lang) as sections, coalesce(sum(length(d.text)), 0)::bigint as chars from (select distinct source from documents) r left join (select * from documents where source <> 'src3') d using (source) group by 1",
    "document_labels": "with r as (select doc_id % 90 as reg_id, 'label ' || min(doc_id) as label from documents group by 1) select event_id, event_id % 130 as reg_id, label from events left join r on r.reg_id = event_id % 130",
    "claim_ratios": f"with c as (select doc_id, unnest(s) as s, generate_subscripts(s, 1) - 1 as i from (select doc_id, {SENTENCES} as s from documents)), k as (select doc_id, i % 4 = 3 as meta, ['supported', 'unsupported', 'supported', 'error', 'contradicted'][i % 5 + 1] as v from c), n as (select doc_id, count(*) as total, count(*) filter (meta) as meta, count(*) filter (not meta and v = 'supported') as ok from k group by 1) select doc_id, total, meta, case when total > meta then round(ok / (total - meta), 4) end as ratio, round(ok / total, 4) as ratio_of_all from n",
    "answer_sentences": r"with p as (select doc_id, list_filter(string_split(regexp_replace(trim(text, ' '), '([.;:])\s+([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_matches(s, '\S')) as ls from documents) select doc_id, unnest(generate_series(0, len(ls) - 1)) as no, sha256(unnest(ls)) as sentence_sha from p",
    "display_bands": f"with x as (select documents.doc_id, n_chars, case when quality is not null then n_chars % 97 / 96 end as share from documents left join labels using (doc_id)) select doc_id, coalesce(round(share * 100)::bigint || '%', '–') as pct, {_BAND('confidence', 'share')} as confidence, {_BAND('match', 'share * 100')} as match, {_BAND('majority', '(n_chars % 101)')} as majority from x",
    "question_prompts": r"""with q as (select conv_id, arg_max(text, (turn, role, text)) as question, max(turn) as last from conversations group by 1), h as (select c.conv_id, turn, role, text[1:80] as text from conversations c join q using (conv_id) where turn < last qualify row_number() over (partition by c.conv_id order by turn desc) <= 6),
hs as (select conv_id, chr(10) || '## CONVERSATION HISTORY' || chr(10) || string_agg(case when role = 'user' then 'User: ' else 'Assistant: ' end || text || chr(10), '' order by turn) || chr(10) as history from h group by 1),
p as (select conv_id, k, d.* from q, (values (0), (1), (2)) as v(k) join documents d on d.doc_id = (conv_id * 3 + k) % 200 where conv_id % 5 > 0), n as (select *, row_number() over (partition by conv_id order by k) as i from p),
cs as (select conv_id, string_agg(printf('%s[Context %d] Source: %s | Page: %d | Confidence: %.4f%s%s%s', chr(10), i, source, doc_id % 9, 1 - k / 4, chr(10), text[1:60], chr(10)), '' order by i) as context from n group by 1),
t as (select conv_id, 'ROLE {x}' || chr(10) || coalesce(history, '') || chr(10) || 'CONTEXT' || coalesce(context, '') || chr(10) || 'Q: ' || question || chr(10) as prompt from q left join hs using (conv_id) left join cs using (conv_id)) select conv_id, sha256(prompt) as prompt_sha, length(prompt) as n_chars from t""",
    "review_calls": "with x as (select documents.doc_id, case when documents.doc_id % 6 > 0 then n_chars % 64 / 64 end as m, quality, toxic from documents left join labels using (doc_id)) select doc_id, round(coalesce(greatest(0.0::double, least(1.0::double, (case when quality is null then m else 0.5::double * m + 0.5::double * quality end) - coalesce(toxic / 4, 0.0::double))), 0.0::double), 4) as priority, m is null as no_context from x",
    "page_chunks": f"select source as doc, doc_id as page, i // 3 as \"window\", len(p) as n_sent, length(c) / 4 as token_count, sha256(c) as chunk_sha from (select *, array_to_string(p, ' ') as c from (select source, doc_id, i, s[i + 1 : i + 6] as p from (select source, doc_id, s, unnest(range(0, len(s), 3)) as i from (select source, doc_id, {SENTENCES} as s from documents)))) where length(c) / 4 > 15",
    "line_edges": f"with {_L}, e as (select doc_id, start, coalesce(case when no % 3 > 0 then length(line) % 40 * 1.5 end, -1.0)::double as x from s where no > 0), o as (select doc_id, unnest(range(0, length(text) + 1, 333)) as at from documents) select o.doc_id, o.at, coalesce(arg_max(e.x, e.start), -1.0::double) as x from o left join e on e.doc_id = o.doc_id and e.start <= o.at group by 1, 2",
    "section_titles": f"with q as (select item_id, list_distinct({TOKENS}) as t from benchmark), f as (select doc_id, unnest([{_FIELD('(text[1:25])')}, {_FIELD('(text[1:40] || chr(32) || source)')}, {_FIELD('(lang || chr(32) || chr(62) || chr(32) || text[1:90])')}]) as t from documents), b as (select item_id, doc_id, len(list_intersect(q.t, f.t)) as b, len(q.t) as nq, len(f.t) as nt from q, f) select item_id, doc_id, round(max(0.85::double * (b / nq) + 0.15::double * (2 * b / (nq + nt))), 6) as score from b where b > 0 group by 1, 2",
    "section_concentration": "with x as (select l_orderkey % 400 as q, l_partkey % 12 as sec, l_orderkey || '-' || l_linenumber as item, max(l_quantity)::double as score from lineitem group by 1, 2, 3), t as (select * from x qualify row_number() over (partition by q order by score desc, item) <= 25), m as (select q, sec, sum(score) as m, count(*) as n from t where sec % 5 <> 0 group by 1, 2) select q, arg_max(sec, (round(m, 6), -sec)) as dominant, round(arg_max(m, (round(m, 6), -sec)) / sum(m), 4) as concentration, arg_max(n, (round(m, 6), -sec)) as hits from m group by 1",
    "hits_over_documents": """with e as (select vec_id, label::bigint as doc, vec_id // 10 as page, case when vec_id % 2 = 0 then '' else vec_id::varchar end || 'same beginning of sixty characters and more, for all of a third ' || vec_id % 3 as text, embedding::double[] as v from embeddings), h as (select q.vec_id as q_id, e.doc, e.page, e.text, e.vec_id, round(list_inner_product(q.v, e.v), 6) as score from e, e q where q.vec_id % 50 = 0),
p as (select *, q_id // 50 % 3 = 0 as picky from h), o as (select * from p where picky and doc in (q_id // 50 % 10, (q_id // 50 + 1) % 10) qualify row_number() over (partition by q_id, doc order by score desc, vec_id) <= 10), u as (select * from o qualify row_number() over (partition by q_id, doc, page, text[1:60] order by score desc, vec_id) = 1)
select q_id, doc, page, vec_id, score, row_number() over (partition by q_id order by score desc, vec_id) as rnk from (select * from u union all select * from p where not picky) qualify rnk <= 10""",
    "doc_name_match_base": "with r as (select 'id' || min(doc_id) as reg_id, 'Label ' || min(doc_id) as label, source as base from documents group by source), q as (select doc_id, lower(case doc_id % 4 when 0 then 'id' || doc_id when 1 then source when 2 then source[2:4] else 'LABEL 1' end) as q from documents), m as (select q.doc_id, max(case when lower(reg_id) = q then label end) as named, count(distinct case when contains(lower(label), q) or contains(lower(base), q) then label end) as n, min(case when contains(lower(label), q) or contains(lower(base), q) then label end) as one from q, r group by 1) select doc_id, case when named is not null then 1 else n end as n_matches, coalesce(named, case when n = 1 then one end) as resolved from m",
    "grader_suite": "with j as (select doc_id, max(quality) as judge, max(toxic) as flagged from labels group by 1) select documents.doc_id, source, judge, flagged, case when lang = 'en' then n_chars end as chars, case when documents.doc_id % 3 = 0 then n_chars % 10 / 10 end as share from documents left join j using (doc_id)",
}
QUERIES = {name: globals()[name] for name in ORACLES}
