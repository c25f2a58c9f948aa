"""Queries of model replies, stores, registries and lossless alignment over the driver's tables; DuckDB SQL where it can say the same."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evidence, grading, models, replies, review, routing, spans
from ..sources import exports, files, registry
from ..sources.shared import shared_folder
from ..sources.tables import table
from ..streaming import intake


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    """A stub stands for the model: a fenced array of two paraphrases, one of them twice, a number and a blank."""
    stub = lambda ps: ["```json\n" + json.dumps([f"what is {p}", 7, f" explain: {p} ", "", f"what is {p}"]) + "\n```" for p in ps]
    q = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    return models.expanded(q, stub, "item_id").select("item_id", F.col("pos").cast("long").alias("pos"), F.sha2("sub_query", 256).alias("sub_sha"))


def narratives(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one source and language as one question's context; the stub notes a part's first 400 characters."""
    stub = lambda ps: [p[:400] for p in ps]
    docs = table(spark, d, "documents").select(F.concat_ws("-", (F.col("doc_id") % 50).cast("string"), "lang").alias("q"), "doc_id", "text")
    return models.map_reduced(docs, stub, "q", "doc_id", "text").select("q", F.sha2("narrative", 256).alias("narrative_sha"), "passes", "rounds")


def reply_store(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over one store: the first model answers no prompt that ends in an odd length, the second all that are asked."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    folder, gate = _folder(spark, "replies"), replies.Gate(tries=1, wait=0.0, shut=10**9)
    first = lambda ps: [f"one {len(p)}" if len(p) % 2 == 0 else None for p in ps]
    replies.with_replies(c, F.col("text"), first, folder, gate=gate)
    x = replies.with_replies(c, F.col("text"), lambda ps: [f"two {len(p)}" for p in ps], folder, gate=gate)
    return x.select("conv_id", "turn", "reply", "error")


def parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    """A stub answers in JSON, in prose, or out of bounds, by the prompt's length."""
    stub = lambda ps: [json.dumps({"document_title": "T", "answer": f"a{len(p)}", "confidence_score": 0.5 if len(p) % 3 else 1.5}) if len(p) % 4 else f"prose {len(p)}" for p in ps]
    q = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text", F.when(F.col("conv_id") % 5 > 0, F.lit("context")).alias("context"))
    return models.answered(q, stub, "text", "context").select("conv_id", "turn", F.col("parsed.document_title").alias("title"), F.sha2("parsed.answer", 256).alias("answer_sha"), F.col("parsed.confidence_score").alias("confidence"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Quotes are each document's characters 100 to 220 with its e's changed, item by document; each is held against its own document and the next one."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    quotes = docs.select(F.col("doc_id").alias("item_id"), F.translate(F.substring("text", 101, 120), "e", "3").alias("quote"))
    return quotes.select("*", F.explode(F.array("item_id", F.col("item_id") + 1)).alias("doc_id")).join(docs, "doc_id")


def align_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evidence.align_pairs(_pairs(spark, d), ["doc_id", "item_id"]).drop("quote")


def best_document_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """The document where each quote aligns best, those of an even id preferred."""
    even = _pairs(spark, d).where("doc_id % 2 = 0").select("item_id", "doc_id")
    return spans.best_document(align_pairs(spark, d), even, "item_id", "doc_id", "score")


def evidence_alignment_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Questions are groups of fifty items, their context the documents that the items are held against."""
    pairs = _pairs(spark, d).select(F.expr("item_id div 50").alias("question"), "item_id", "doc_id")
    return spans.alignment_rates(pairs.select("question", "item_id").distinct(), pairs.select("question", "doc_id").distinct(), align_pairs(spark, d), "question", "item_id", "doc_id", "score")


def generative_extraction(spark: SparkSession, d: str) -> DataFrame:
    """The stub quotes each context's second 60 characters as they are, with every fourth letter changed, and a text that isn't there."""

    def stub(ps: list[str]) -> list[str]:
        out = []
        for p in ps:
            q = p[60:120]
            edited = "".join("#" if i % 6 == 3 else c for i, c in enumerate(q))
            groups = [{"heading": "As it is", "items": [{"text": "one", "evidence": q}, {"text": "two", "evidence": q}]}, {"heading": "Empty", "items": []}, {"items": [{"text": "three", "evidence": edited}, {"text": "§§ nothing of the kind §§"}]}]
            out.append("```json\n" + json.dumps({"title": "t", "groups": groups}) + "\n```")
        return out

    q = table(spark, d, "documents").select("doc_id", "text")
    segments = q.select("doc_id", (F.col("doc_id") % 100).alias("doc_start"), (F.col("doc_id") % 100 + 100).alias("doc_end"), F.lit(0).cast("long").alias("view_start"))
    x = models.generative_extraction(q, stub, "doc_id", F.col("text"), "text", segments)
    return x.select("doc_id", "item_id", "heading", F.sha2("evidence", 256).alias("evidence_sha"), "start", "end", "doc_start", "doc_end", "score", "grounding")


def semantic_utilisation(spark: SparkSession, d: str) -> DataFrame:
    """Answers are the stated query vectors, their chunks the vectors of the same label, in the order of their ids."""
    e = table(spark, d, "embeddings")
    answers = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "label", "embedding")
    # the first chunks of each label, before they meet its answers
    of = e.where("embedding is not null").withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where(F.col("_n") <= models.CHUNKS)
    chunks = answers.select("q", "label").join(of.select("label", "vec_id", "embedding"), "label").select("q", F.col("vec_id").alias("rnk"), "embedding")
    return models.semantic_utilisation(answers, chunks, "q")


def registry_dense(spark: SparkSession, d: str) -> DataFrame:
    """Labels are documents, registered in two appends, of which the second replaces the even ones; queries ask for the label after their own."""
    e, folder = table(spark, d, "embeddings"), _folder(spark, "registry")
    registry.register(e.withColumn("embedding", F.when(F.col("label") % 2 == 0, F.transform("embedding", lambda v: -v)).otherwise(F.col("embedding"))), folder, "label", "vec_id", embedding="embedding")
    registry.register(e.where("label % 2 = 0"), folder, "label", "vec_id", embedding="embedding")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), ((F.col("label") + 1) % 10).alias("doc"), "embedding")
    return registry.dense_search(q, folder, "q_id", "doc", "embedding").withColumnRenamed("item", "vec_id")


def registry_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Sources are documents and their texts chunks; each item asks two of them."""
    docs, folder = table(spark, d, "documents"), _folder(spark, "registry")
    registry.register(docs, folder, "source", "doc_id", text="text")
    q = table(spark, d, "benchmark").select("item_id", "text", F.explode(F.array(*[F.concat(F.lit("src"), ((F.col("item_id") + i) % 20).cast("string")) for i in (0, 7)])).alias("doc")).select(F.concat_ws(":", F.col("item_id").cast("string"), "doc").alias("q"), "doc", "text")
    return registry.lexical_search(q, folder, "q", "doc").withColumnRenamed("item", "doc_id")


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """Documents and what is known of them, as the signals that graders give; labels are missing for some."""
    n, i = F.col("n_chars"), F.col("doc_id")
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", n.alias("n"), i.alias("i"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.col("quality").alias("quality"))


def error_tags(spark: SparkSession, d: str) -> DataFrame:
    return grading.error_tags(_tag_signals(spark, d))


def _tag_signals(spark: SparkSession, d: str) -> DataFrame:
    n, i = F.col("n"), F.col("i")
    unsupported = F.when(F.col("quality") == 0, i % 3).otherwise(F.lit(0).cast("long"))
    return _signals(spark, d).select("doc_id", (n > 150).alias("has_context"), (0.3 + n % 97 / 128).alias("grounding"), (i % 11 / 16).alias("weak"), unsupported.alias("unsupported"), F.when(F.col("toxic") == 1, i % 2).otherwise(F.lit(0).cast("long")).alias("contradicted"), (n % 64 / 64).alias("judge"), (n % 3).alias("uncovered"), (i % 13 == 0).alias("admits"))


def error_reasons(spark: SparkSession, d: str) -> DataFrame:
    return grading.error_reasons(error_tags(spark, d))


def review_grades(spark: SparkSession, d: str) -> DataFrame:
    n, i = F.col("n"), F.col("i")
    part = lambda x, m: F.when(i % m > 0, x)
    s = _signals(spark, d).select("doc_id", part(n % 61 / 61, 5).alias("judge"), part(n % 31 / 31, 7).alias("claims"), part(i % 17 / 17, 3).alias("items"), F.col("quality").cast("double").alias("semantic"), part(n % 7 / 7, 4).alias("coverage"), (i % 127 / 127).alias("structure"), part(i % 4 / 4, 6).alias("sections"), F.col("toxic").alias("contradicted"), (n % 3).cast("int").alias("partial_sections"), (i % 2).cast("int").alias("structure_flags"), F.when(i % 9 > 0, n > 500).alias("sufficient"))
    return review.review_grades(s)


def signal_router(spark: SparkSession, d: str) -> DataFrame:
    """Questions are orders: titles by quantity, concentration by discount, hits and items by lines."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.max("l_quantity") / 64).cast("double").alias("title"), F.round(F.max("l_discount") * 4, 6).cast("double").alias("concentration"), F.count(F.lit(1)).alias("hits"), F.max("l_linenumber").cast("long").alias("title_items"), (F.min("l_partkey") % 9).cast("long").alias("dominant_items"))
    return routing.route(x.withColumn("wants_set", F.col("l_orderkey") % 2 == 0))


def routed_questions(spark: SparkSession, d: str) -> DataFrame:
    """The stub routes to two sections, to all passages, to a scope that there isn't, or says something else, by the prompt's length."""

    def stub(ps: list[str]) -> list[str]:
        said = (json.dumps({"scope": "section", "sections": ["s1", "s2"]}), json.dumps({"scope": "hybrid", "sections": ["s3"]}), json.dumps({"scope": "none"}), "prose")
        return [said[len(p) % 4] for p in ps]

    x = models.routed(table(spark, d, "conversations").select("conv_id", "turn", "text"), stub, F.col("text"))
    return x.select("conv_id", "turn", "scope", F.array_join("sections", ",").alias("sections"))


def answer_relevancy(spark: SparkSession, d: str) -> DataFrame:
    """The stub's score is the prompt's length modulo eleven, in tenths; none at ten."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("question"), "text")
    stub = lambda ps: [f"score 0.{n}" if (n := len(p) % 11) < 10 else "no idea" for p in ps]
    return models.relevancy(c, stub, "question", "text").select("conv_id", "turn", "relevancy", "relevant")


def fallback_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Answers are user turns, the chunk the longest assistant turn; the stub embeds by counts of four vowels."""
    stub = lambda ps: [[float(p.count(v)) for v in "aeio"] for p in ps]
    c = table(spark, d, "conversations")
    pair = c.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("answer"), F.max(F.when(F.col("role") == "assistant", F.struct(F.length("text"), "text"))).alias("best"))
    x = models.fallback_sentences(pair.select("conv_id", "answer", F.col("best.text").alias("chunk")).where("answer is not null and chunk is not null"), stub, "conv_id", "answer", "chunk")
    return x.select("conv_id", F.sha2("sentence", 256).alias("sentence_sha"), "match")


def document_spans(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders are stretches of a view, 50 apart with 40 shown; every line of a part's order is a span in the view."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    k = F.col("l_linenumber").cast("long")
    segs = x.select("l_orderkey", (k * 1_000).alias("doc_start"), (k * 1_000 + 40).alias("doc_end"), (k * 50).alias("view_start"))
    views = x.select("l_orderkey", (k * 50 + F.col("p") % 60).alias("start"), (k * 50 + F.col("p") % 60 + 15).alias("end"))
    return spans.document_spans(views, segs, "l_orderkey")


def registered_stream(spark: SparkSession, d: str) -> DataFrame:
    """Vectors come as a stream of documents into a registry, twice; the second stream brings nothing new. A stream takes a single file by a pattern only."""
    schema, folder = table(spark, d, "embeddings").schema, _folder(spark, "intake")
    for k in range(2):
        stream = spark.readStream.schema(schema).parquet(f"{d}/embeddings.parque[t]").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("label"), "embedding")
        intake.register_documents(stream, f"{folder}/registry", f"{folder}/c{k}", 64).awaitTermination()
    return spark.read.parquet(f"{folder}/registry").select("doc_id", "label", F.size("embedding").cast("long").alias("dims"))


def audit_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events come as a stream of audit entries with lists."""
    schema, folder = table(spark, d, "events").schema, _folder(spark, "audit")
    tags = F.filter(F.array(F.when(F.col("event_id") % 2 == 0, "even"), F.when(F.col("event_id") % 3 == 0, "third")), lambda t: t.isNotNull())
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").select("event_id", tags.alias("tags"))
    intake.append_audit(stream, f"{folder}/log", f"{folder}/c", ("tags",)).awaitTermination()
    x = spark.read.parquet(f"{folder}/log")
    n = x.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return x.join(n, "entry_id", "left").select("event_id", "tags", F.col("n").isNull().alias("own_number"))


def loaded_questions(spark: SparkSession, d: str) -> DataFrame:
    """First lines of documents go into CSV question files in quotes, with a heading, and are read back, as many as there are of each."""
    folder = _folder(spark, "questions") + ".csv"
    q = table(spark, d, "documents").select(F.trim(F.substring_index("text", "\n", 1)).alias("q"))
    line = F.concat(F.lit('"'), F.replace("q", F.lit('"'), F.lit('""')), F.lit('",more'))
    q.select(line.alias("value")).unionByName(spark.range(1).select(F.lit("Question").alias("value"))).write.text(folder)
    return exports.load_questions(spark, folder).groupBy(F.sha2("question", 256).alias("question_sha")).agg(F.count(F.lit(1)).alias("n"))


def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """A cache holds the vectors of the English texts, a stub embeds the others; those marked were in the cache."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    cache = docs.where("lang = 'en'").select(F.sha2("text", 256).alias("text_sha")).distinct().withColumn("embedding", F.array(F.lit(-1.0)))
    with_, _ = files.embedded(docs, cache, lambda ts: [[float(len(t))] for t in ts])
    return with_.select("doc_id", F.col("embedding")[0].alias("first"))


_B = "b as (select item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as q from benchmark)"
_SIG = "g as (select documents.doc_id, n_chars as n, documents.doc_id as i, coalesce(toxic, 0) as toxic, quality from documents left join labels on labels.doc_id = documents.doc_id)"
_TAG = """concat_ws(', ', case when not has_context or grounding <= 0.34 then 'retrieval_failure' when grounding < 0.8 or weak >= 0.5 or unsupported > 0 then 'partial_retrieval' when admits then 'missing_context' end,
case when contradicted > 0 then 'contradiction' end, case when has_context and grounding >= 0.8 and weak < 0.5 and unsupported = 0 and not admits and judge < 0.7 then 'misinterpretation' end, case when uncovered > 0 then 'coverage_gap' end)"""
_SUM = " + ".join(f"coalesce({n} * {w}::double, 0)" for n, w in review.WEIGHTS.items())
_WEIGHT = " + ".join(f"(case when {n} is null then 0 else {w}::double end)" for n, w in review.WEIGHTS.items())
_FLAGS = "list_filter([case when semantic < 0.45 then 'low_semantic_match' end, case when contradicted > 0 then 'contradicted_claims' end, case when claims < 0.7 then 'weak_claim_grounding' end, case when coverage < 0.6 then 'items_missing_from_answer' end, case when partial_sections > 0 then 'incomplete_list_section' end, case when structure_flags > 0 then 'weak_structure' end, case when not sufficient then 'context_insufficient' end], lambda f: f is not null)"
_product = "round(list_inner_product(q.embedding::double[], e.embedding::double[]), 6)"

ORACLES = {
    "query_expansion": f"with {_B} select item_id, pos, sha256(case pos when 0 then q when 1 then 'what is ' || lower(q) else 'explain: ' || lower(q) end) as sub_sha from b, (values (0::bigint), (1), (2)) as p(pos)",
    "reply_store": "select conv_id, turn, case when text is null then null when length(text) % 2 = 0 then 'one ' || length(text) else 'two ' || length(text) end as reply, null::varchar as error from conversations",
    "parsed_answers": r"""with p as (select conv_id, turn, case when conv_id % 5 > 0 then length('context' || chr(10) || chr(10) || text) end as n from conversations where role = 'user')
select conv_id, turn, case when n % 4 = 0 or n % 3 = 0 then 'PARSE_ERROR' when n is not null then 'T' end as title, sha256(case when n % 4 = 0 then 'The reply is not of the expected form.' || chr(10) || chr(10) || 'Raw output:' || chr(10) || 'prose ' || n when n % 3 = 0 then 'The reply is not of the expected form.' || chr(10) || chr(10) || 'Raw output:' || chr(10) || '{"document_title": "T", "answer": "a' || n || '", "confidence_score": 1.5}' else 'a' || n end) as answer_sha, case when n % 4 = 0 or n % 3 = 0 then 0.0::double when n is not null then 0.5::double end as confidence from p""",
    "semantic_utilisation": "select q, round(avg((s >= 0.3)::int::double), 4) as utilisation from (select q.vec_id as q, list_inner_product(q.embedding::double[], e.embedding::double[]) as s, row_number() over (partition by q.vec_id order by e.vec_id) as n from embeddings q join embeddings e using (label) where q.vec_id % 50 = 0) where n <= 60 group by 1",
    "registry_dense": f"select q.vec_id as q_id, e.label::varchar as doc, e.vec_id, {_product} as score, row_number() over (partition by q.vec_id order by {_product} desc, e.vec_id) as rnk from embeddings q join embeddings e on e.label = (q.label + 1) % 10 where q.vec_id % 50 = 0 qualify rnk <= 10",
    "error_tags": f"with {_SIG}, s as (select doc_id, n > 150 as has_context, 0.3::double + n % 97 / 128 as grounding, i % 11 / 16 as weak, case when quality = 0 then i % 3 else 0 end as unsupported, case when toxic = 1 then i % 2 else 0 end as contradicted, n % 64 / 64 as judge, n % 3 as uncovered, i % 13 = 0 as admits from g) select *, {_TAG} as tags from s",
    "review_grades": f"with {_SIG}, s as (select doc_id, case when i % 5 > 0 then n % 61 / 61 end as judge, case when i % 7 > 0 then n % 31 / 31 end as claims, case when i % 3 > 0 then i % 17 / 17 end as items, quality::double as semantic, case when i % 4 > 0 then n % 7 / 7 end as coverage, i % 127 / 127 as structure, case when i % 6 > 0 then i % 4 / 4 end as sections, toxic as contradicted, (n % 3)::int as partial_sections, (i % 2)::int as structure_flags, case when i % 9 > 0 then n > 500 end as sufficient from g) select * exclude (f), array_to_string(f, ',') as flags, case when overall is not null then round(greatest(0.0::double, overall - 0.1::double * len(f)), 4) end as priority from (select *, case when {_WEIGHT} > 0 then round(({_SUM}) / ({_WEIGHT}), 4) end as overall, {_FLAGS} as f from s)",
    "routed_questions": "select conv_id, turn, case length(text) % 4 when 0 then 'section' when 1 then 'hybrid' end as scope, case length(text) % 4 when 0 then 's1,s2' end as sections from conversations",
    "answer_relevancy": "with x as (select conv_id, turn, (length(role) + 1 + length(text)) % 11 as n from conversations) select conv_id, turn, case when n < 10 then n / 10 end as relevancy, case when n < 10 then n >= 5 end as relevant from x",
    "fallback_sentences": "with p as (select conv_id, trim(max(case when role = 'user' then text end)) as a, arg_max(text, (length(text), text)) filter (role = 'assistant') as c from conversations group by 1), s0 as (select conv_id, a, string_split(regexp_replace(trim(c), '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)) as ls from p where a is not null and c is not null), s as (select conv_id, a, unnest(ls) as b0, generate_subscripts(ls, 1) as no from s0), t as (select conv_id, a, b0, trim(b0) as b, no from s), v as (select *, "
    + ", ".join(f"(length({c}) - length(replace({c}, '{x}', '')))::double as {c}{x}" for c in "ab" for x in "aeio")
    + " from t), w as (select *, aa * ba + ae * be + ai * bi + ao * bo as dot, sqrt(aa * aa + ae * ae + ai * ai + ao * ao) * sqrt(ba * ba + be * be + bi * bi + bo * bo) as size from v), m as (select *, case when size > 0 and a <> '' and b <> '' then round(greatest(0.0, least(1.0, dot / size)), 4) end as match from w) select conv_id, sha256(b0) as sentence_sha, match from m qualify row_number() over (partition by conv_id order by coalesce(match, -1.0) desc, no) = 1",
    "document_spans": "with x as (select l_orderkey, l_linenumber as k, min(l_partkey) as p from lineitem group by 1, 2), v as (select l_orderkey, k * 50 + p % 60 as a, k * 50 + p % 60 + 15 as z from x), s as (select l_orderkey, k * 1000 as d, k * 50 as v0, k * 50 + 40 as v1 from x) select v.l_orderkey, greatest(a, v0) + d - v0 as start, least(z, v1) + d - v0 as \"end\" from v join s using (l_orderkey) where a < v1 and v0 < z",
    "registered_stream": "select vec_id as doc_id, 'v' || vec_id as label, len(embedding) as dims from embeddings",
    "audit_stream": "select event_id, concat_ws(' | ', case when event_id % 2 = 0 then 'even' end, case when event_id % 3 = 0 then 'third' end) as tags, true as own_number from events",
    "loaded_questions": "select sha256(q) as question_sha, count(*) as n from (select trim(split_part(text, chr(10), 1)) as q from documents) where q <> '' and lower(q) <> 'question' group by 1",
    "embedding_cache": "select doc_id, case when sha256(text) in (select sha256(text) from documents where lang = 'en') then -1.0::double else length(text)::double end as first from documents",
    "signal_router": "with x as (select l_orderkey, (max(l_quantity) / 64)::double as title, round(max(l_discount) * 4, 6)::double as concentration, count(*) as hits, max(l_linenumber)::bigint as title_items, min(l_partkey) % 9 as dominant_items, l_orderkey % 2 = 0 as wants_set from lineitem group by l_orderkey) select *, case when why is not null and (wants_set or case when why = 'title' then title_items else dominant_items end >= 4) then 'section' else 'hybrid' end as mode from (select *, case when title >= 0.62 then 'title' when concentration >= 0.3 or hits >= 6 then 'evidence' end as why from x)",
}
#: Stubs that cut texts or compare subsequences, and formatted numbers, have no SQL; tests hold them against plain versions.
PLAIN = ("narratives", "align_pairs", "best_document_fuzzy", "evidence_alignment_fuzzy", "generative_extraction", "error_reasons", "registry_lexical")
QUERIES = {name: globals()[name] for name in (*ORACLES, *PLAIN)}
