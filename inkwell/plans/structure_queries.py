"""Queries of structure, routing, dates, models and validation over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import models, routing, structure, validation
from ..sources.tables import table


def cleaned_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents' lines without those that open at least three documents of the same source."""
    docs = table(spark, d, "documents")
    lines = structure.text_lines(docs)
    keyed = lines.join(docs.select("doc_id", "source"), "doc_id").withColumn("key", F.regexp_replace(F.trim(F.regexp_replace("line", r"[ \t]+", " ")), "[0-9]+", "#"))
    often = keyed.where("key <> ''").groupBy("source", "key").agg(F.countDistinct("doc_id").alias("n")).where("n >= 3")
    running = keyed.join(often, ["source", "key"]).select("doc_id", "key")
    return structure.clean_lines(lines, running).select("doc_id", F.col("no").cast("long").alias("no"), F.sha2("line", 256).alias("line_sha"))


def text_headings(spark: SparkSession, d: str) -> DataFrame:
    return structure.headings(_numbered(spark, d)).select("doc_id", "start", "level", "number", "title")


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose lines of at most 60 characters are numbered headings, by their place."""
    n = F.when(F.col("no") % 3 == 0, F.expr("cast(no div 3 + 1 as string)")).otherwise(F.concat_ws(".", F.expr("cast(no div 3 + 1 as string)"), (F.col("no") % 3).cast("string")))
    x = structure.text_lines(table(spark, d, "documents")).withColumn("line", F.when(F.length("line").between(5, 60) & (F.col("no") < 90), F.concat_ws(" ", n, "line")).otherwise(F.col("line")))
    t = x.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "line"))), lambda s: s["line"]), "\n").alias("text"))
    return t.withColumn("n_chars", F.length("text").cast("long"))


def section_tree(spark: SparkSession, d: str) -> DataFrame:
    docs = _numbered(spark, d)
    return structure.section_tree(structure.headings(docs).join(docs.select("doc_id", "n_chars"), "doc_id"))


def section_bodies(spark: SparkSession, d: str) -> DataFrame:
    docs = _numbered(spark, d)
    tree = structure.section_tree(structure.headings(docs).join(docs.select("doc_id", "n_chars"), "doc_id"))
    return structure.section_text(tree, docs).select("doc_id", "sec_no", F.sha2("body", 256).alias("body_sha"))


def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = _numbered(spark, d)
    tree = structure.section_tree(structure.headings(docs).join(docs.select("doc_id", "n_chars"), "doc_id"))
    return structure.section_chunks(structure.section_text(tree, docs))


def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    return structure.chunk_index(table(spark, d, "conversations").where("role = 'assistant'"), ["conv_id"], "turn")


def context_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).cast("long").alias("context_chars"))


def indent_levels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 2, F.col("l_quantity").cast("double")).otherwise(F.lit(-1.0)).alias("x"))
    return structure.indent_levels(e, "l_orderkey").select("l_orderkey", "l_linenumber", "depth")


def doc_inference(spark: SparkSession, d: str) -> DataFrame:
    registry = table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("base_name"), F.concat((F.col("doc_id") % 9000 + 1000).cast("string"), F.lit("-01")).alias("version_label"))
    return routing.infer_documents(table(spark, d, "benchmark"), registry, "item_id", "doc_id")


def _titles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("sec"), F.col("l_linenumber").alias("no"), "l_quantity", "l_discount")
    titles = x.groupBy("q", "sec").agg(F.max("l_quantity").cast("double").alias("score"), F.max(F.col("no") % 3 == 0).alias("navigational"))
    return titles, x.groupBy("q", "sec").agg(F.round(F.sum("l_discount"), 6).cast("double").alias("mass"), F.min("no").cast("long").alias("first"))


def router_shortlist(spark: SparkSession, d: str) -> DataFrame:
    titles, mass = _titles(spark, d)
    return routing.shortlist(titles, mass, "q", "sec")


def forced_mode(spark: SparkSession, d: str) -> DataFrame:
    _, mass = _titles(spark, d)
    o = F.col("o_orderkey")
    routes = table(spark, d, "orders").select(o.alias("q"), F.when(o % 2 == 0, "section").otherwise("hybrid").alias("mode"), F.when(o % 2 == 0, o % 7).alias("sec"), F.when(o % 3 == 0, "section").when(o % 3 == 1, "hybrid").alias("forced"))
    return routing.forced(routes, mass, "q", "sec")


def section_family(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    s = table(spark, d, "documents").select(F.col("source").alias("doc"), F.concat_ws(".", (i % 5 + 1).cast("string"), (i % 7).cast("string"), i.cast("string")).alias("number"), i.alias("char_start"), (i + F.col("n_chars")).alias("char_end"))
    picked = s.select("doc", F.regexp_extract("number", r"^(\d+\.\d+)", 1).alias("number")).where("number like '2.%'").unionByName(s.where("number like '1.3.%'").select("doc", "number")).distinct()
    return routing.family(picked, s, "doc")


def covered_lists(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sec"), F.col("l_linenumber").alias("chunk"), "l_quantity")
    items = x.groupBy("sec").agg(F.sum("chunk").cast("long").alias("n_items"))
    return routing.covered_lists(x.where("l_quantity > 10"), x, items, "sec", "chunk")


def _files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    day = lambda n: F.date_add(F.lit("2001-01-31").cast("date"), (i % n).cast("int"))
    stamp = lambda c: F.concat(F.lit("D:"), F.date_format(c, "yyyyMMdd"), F.lit("120000"))
    created, modified = F.when(i % 3 == 0, day(5000)), F.when(i % 3 == 1, day(7000))
    text = F.when(i % 5 == 0, F.concat(F.col("text"), F.lit(" May  2019 and June 2020"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", "source", text.alias("text"), created.alias("created"), modified.alias("modified"), day(9000).alias("mtime"), stamp(created).alias("c"), stamp(modified).alias("m"))


def display_dates(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return f.select("doc_id", dates.year_month(F.col("c"), F.col("m"), F.col("mtime")).alias("year_month"), dates.display_date(F.col("text"), F.col("created"), F.col("modified"), F.col("mtime")).alias("display"))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", dates.cache_name(F.concat("url", F.lit(".pdf"))).alias("cache_name"), dates.stable_key(F.col("page_id").cast("string"), F.col("url")).alias("stable_key"))


def doc_titles(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    meta = F.when(i % 4 == 0, F.concat(F.regexp_extract("text", "^([^ \n]+ [^ \n]+ [^ \n]+)", 1), F.lit(" | FDA"))).when(i % 4 == 1, F.lit("Guidance for Industry")).when(i % 4 == 2, F.lit("Two words"))
    page = F.when(i % 8 == 3, F.concat(F.lit("Center for it\n"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(dates.document_title(meta, page), 256).alias("title_sha"))


def cross_rerank(spark: SparkSession, d: str) -> DataFrame:
    """A stub stands for the model: the passage's length; without the model the fused score ranks."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("conv_id").cast("string").alias("q"), F.concat(F.col("turn").cast("string"), F.lit(" "), "text").alias("t"), (-F.col("turn")).cast("double").alias("rrf"))
    stub = lambda ps: [str(len(p)) for p in ps]
    with_ = models.reranked(c, stub, "conv_id", "q", "t").select("conv_id", "turn", F.col("rank").alias("by_model"))
    return with_.join(models.reranked(c, None, "conv_id", "q", "t").select("conv_id", "turn", F.col("rank").alias("by_fusion")), ["conv_id", "turn"])


def judge_calls(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("role = 'assistant'").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer"), "text")
    stubs = {"strict": lambda ps: [f"score: {len(p) % 11}" for p in ps], "lenient": lambda ps: [f"score: {10 - len(p) % 3}" for p in ps]}
    return models.judged(c, stubs, "answer", F.col("text"))


def answer_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims without a model, and their check by a stub that finds short ones supported."""
    c = table(spark, d, "conversations").where("role = 'assistant'").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer"), F.regexp_replace(F.trim("text"), r"\s+", " ").alias("text"))
    found = models.claims(c, None, "answer", "text").join(c, "answer")
    stub = lambda ps: ["Supported." if len(p.split("\n")[0]) < 60 else "this is Unsupported" if len(p) % 2 else "?" for p in ps]
    x = models.verified(found, stub, "claim", "text")
    return x.select("answer", F.col("claim_no").cast("long").alias("claim_no"), F.sha2("claim", 256).alias("claim_sha"), "verdict")


def semantic_match(spark: SparkSession, d: str) -> DataFrame:
    """A stub stands for the embedder: counts of four vowels."""
    stub = lambda ps: [[float(p.count(v)) for v in "aeio"] for p in ps]
    c = table(spark, d, "conversations")
    pair = c.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("a"), F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("b"))
    return models.semantic_match(pair, stub, "a", "b").select("conv_id", "match")


def _decisions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = F.col("event_id")
    log = table(spark, d, "orders").select(F.col("o_orderkey").alias("entry_id"), F.concat(F.lit("answer "), F.col("o_orderkey").cast("string")).alias("answer"))
    status = F.element_at(F.array(*map(F.lit, ("Approved ", "rejected", "maybe", "skipped"))), (e % 4 + 1).cast("int"))
    entry = F.when(e % 11 == 0, None).otherwise(e % 500)
    dec = table(spark, d, "events").select(entry.alias("entry_id"), status.alias("status"), F.when(e % 3 == 0, " ").otherwise(" ann ").alias("reviewer"), F.lit("").alias("comment"), F.when(e % 5 == 0, F.concat(F.lit("fixed "), e.cast("string"))).alias("corrected"), e.alias("at"))
    return log, dec


def checked_decisions(spark: SparkSession, d: str) -> DataFrame:
    log, dec = _decisions(spark, d)
    return validation.checked_decisions(dec, log).select("at", "entry_id", "status", "reviewer", "comment", "corrected", "error")


def decided_log(spark: SparkSession, d: str) -> DataFrame:
    log, dec = _decisions(spark, d)
    return validation.with_decisions(log, dec).drop("comment", "corrected")


def upload_checks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.when(i % 5 == 0, None).when(i % 5 == 1, F.lit("  ")).when(i % 5 == 2, F.lit("a.PDF")).otherwise(F.concat("source", F.lit(".txt")))
    return validation.upload_errors(table(spark, d, "documents").select("doc_id", name.alias("name"), F.when(i % 7 > 0, F.col("n_chars")).alias("bytes")))


def reply_schema(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    reply = F.when(i % 4 == 0, F.concat(F.lit('{"answer": "a'), i.cast("string"), F.lit('", "confidence": 0.'), (i % 10).cast("string"), F.lit("}")))
    reply = reply.when(i % 4 == 1, F.lit('{"confidence": 0.5}')).when(i % 4 == 2, F.lit('{"answer": "x", "confidence": 7.0}')).otherwise(F.lit('{"answer": "no number"}'))
    return validation.parsed_replies(table(spark, d, "documents").select("doc_id", reply.alias("reply"))).drop("reply")


def metadata_passages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", (F.col("conv_id") % 7).alias("doc"), F.lit(0.5).alias("score"), "text")
    docs = spark.range(7).select(F.col("id").alias("doc"), F.concat(F.lit("Title "), F.col("id").cast("string")).alias("title"), F.when(F.col("id") % 2 == 0, F.lit("May 2019")).alias("date"))
    return validation.with_metadata(c, docs, "conv_id", "doc").select("conv_id", "doc", "score", F.sha2("text", 256).alias("text_sha"), "synthetic")


def item_links(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    items = x.select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").cast("long").alias("no"), F.concat(F.lit(" q"), (F.col("l_partkey") % 5).cast("string"), F.lit(" ")).alias("quote"))
    spans = x.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").cast("long").alias("place"), F.concat(F.lit("q"), (F.col("l_suppkey") % 5).cast("string")).alias("quote"), F.concat(F.lit("ev"), F.col("l_linenumber").cast("string")).alias("span_id"))
    return validation.linked_items(items, spans, "answer")


def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    p = F.col("l_partkey")
    a = x.select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").cast("long").alias("no"), (F.col("l_suppkey") % 2).alias("doc"), (p % 3 * 10).alias("start"), (p % 3 * 10 + 9).alias("end"), (F.col("l_quantity") * 2).cast("double").alias("score"), F.repeat(F.lit("x"), (p % 20 + 1).cast("int")).alias("quote"))
    return validation.evidence_spans(a, "answer")


_L = r"(select doc_id, generate_subscripts(ls, 1) - 1 as no, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents))"
_NUM = rf"""n as (select doc_id, string_agg(case when length(line) between 5 and 60 and no < 90 then case when no % 3 = 0 then (no // 3 + 1)::varchar else (no // 3 + 1) || '.' || no % 3 end || ' ' || line else line end, chr(10) order by no) as text from {_L} group by 1),
nl as (select doc_id, no, line, coalesce(sum(length(line) + 1) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding), 0)::bigint as start from (select doc_id, generate_subscripts(ls, 1) - 1 as no, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from n))),
h0 as (select doc_id, start, regexp_extract(line, '^([0-9]{{1,2}}(\.[0-9]{{1,2}}){{0,3}})\s+([A-Z][^\n]{{3,90}})$', 1) as number, trim(regexp_extract(line, '^([0-9]{{1,2}}(\.[0-9]{{1,2}}){{0,3}})\s+([A-Z][^\n]{{3,90}})$', 3)) as title from nl where regexp_matches(line, '^([0-9]{{1,2}}(\.[0-9]{{1,2}}){{0,3}})\s+([A-Z][^\n]{{3,90}})$')),
h as (select doc_id, start, length(number) - length(replace(number, '.', '')) + 1 as level, number, title, number || ' ' || title as full_title from h0 union all select doc_id, 0, 1, '', 'Document', 'Document' from n where doc_id not in (select doc_id from h0)),
hn as (select *, row_number() over (partition by doc_id order by start) - 1 as i from h),
anc as (select b.doc_id, b.i, a.i as j, a.full_title as t from hn b join hn a on a.doc_id = b.doc_id and a.i <= b.i and (a.i = b.i or (a.level < b.level and not exists (select 1 from hn k where k.doc_id = b.doc_id and k.i > a.i and k.i <= b.i and k.level <= a.level)))),
tree as (select hn.doc_id, hn.i as sec_no, p.path, level, start as char_start, case when coalesce(lead(start) over (partition by hn.doc_id order by start), length(n.text)) > start then coalesce(lead(start) over (partition by hn.doc_id order by start), length(n.text)) else least(length(n.text), start + 1) end as char_end from hn join n using (doc_id) join (select doc_id, i, string_agg(t, ' > ' order by j) as path from anc group by 1, 2) p on p.doc_id = hn.doc_id and p.i = hn.i),
full_tree as (select * from tree union all select doc_id, -1, 'Front matter', 1, 0, char_start from tree where sec_no = 0 and char_start > 200)"""
_DAY = lambda n: f"(date '2001-01-31' + (doc_id % {n})::int)"
_FILES = f"f as (select doc_id, case when doc_id % 5 = 0 then text || ' May  2019 and June 2020' else text end as text, case when doc_id % 3 = 0 then {_DAY(5000)} when doc_id % 3 = 1 then {_DAY(7000)} end as own, {_DAY(9000)} as mtime from documents)"
_MASS = "m as (select l_orderkey as q, l_partkey as sec, max(l_quantity)::double as score, bool_or(l_linenumber % 3 = 0) as navigational, round(sum(l_discount), 6)::double as mass, min(l_linenumber)::bigint as first from lineitem group by 1, 2)"
_DEC = "dec as (select case when event_id % 11 = 0 then null else event_id % 500 end as entry_id, ['approved', 'rejected', 'maybe', 'skipped'][event_id % 4 + 1] as status, case when event_id % 3 = 0 then null else 'ann' end as reviewer, null::varchar as comment, case when event_id % 5 = 0 then 'fixed ' || event_id end as corrected, event_id as \"at\" from events), chk as (select dec.*, case when status = 'maybe' then 'status' when entry_id is null then 'missing id' when entry_id not in (select o_orderkey from orders) then 'unknown id' end as error from dec)"
_CONV = "(select conv_id || '-' || turn as answer, text from conversations where role = 'assistant')"

ORACLES = {
    "cleaned_lines": rf"""with l as (select doc_id, no, trim(regexp_replace(line, '[ \t]+', ' ', 'g')) as line from {_L}), k as (select l.*, source, regexp_replace(line, '[0-9]+', '#', 'g') as key from l join documents using (doc_id)),
r as (select source, key from k where key <> '' group by 1, 2 having count(distinct doc_id) >= 3), c as (select k.* from k left join r using (source, key) where r.key is null and not regexp_full_match(line, '[0-9]{{1,4}}')),
w as (select *, lag(line) over (partition by doc_id order by no) as prev, max(case when line <> '' then no end) over (partition by doc_id) as last from c)
select doc_id, no, sha256(line) as line_sha from w where line <> '' or (prev <> '' and no < last)""",
    "text_headings": f"with {_NUM} select doc_id, start, level, number, title from h",
    "section_tree": f"with {_NUM} select * from full_tree",
    "section_bodies": f"with {_NUM} select doc_id, sec_no, sha256(substr(text, char_start + 1, char_end - char_start)) as body_sha from full_tree join n using (doc_id)",
    "chunk_index": "select conv_id, string_agg(turn::varchar, ',' order by turn) as chunks, count(*) as n_chunks from conversations where role = 'assistant' group by 1",
    "context_size": "select conv_id, sum(length(text))::bigint as context_chars from conversations group by 1",
    "doc_inference": """with r as (select doc_id, lower(split_part(text, chr(10), 1)) as b, (doc_id % 9000 + 1000)::varchar as y from documents), w as (select doc_id, unnest(regexp_extract_all(b, '[a-z]{4,}')) as w from r), q as (select item_id, lower(text) as q from benchmark)
select item_id, doc_id from (select item_id, doc_id, 1 as p from w join q on contains(q, w) union all select item_id, doc_id, 2 from r join q on contains(q, y)) group by 1, 2 having sum(p) >= 2""",
    "router_shortlist": f"""with {_MASS}, a as (select q, sec, rn as o from (select *, row_number() over (partition by q order by score desc, sec) as rn from m) where rn <= 10 and not navigational), b as (select q, sec, rn + 10 as o from (select *, row_number() over (partition by q order by mass desc, sec) as rn from m) where rn <= 18),
u as (select q, sec, min(o) as o from (select * from a union all select * from b) group by 1, 2) select q, sec, row_number() over (partition by q order by o, sec) as place from u qualify place <= 18""",
    "forced_mode": f"""with {_MASS}, t as (select q, arg_max(sec, (mass, -first, sec)) as top from m group by 1), r as (select o_orderkey as q, o_orderkey % 2 = 0 as s, o_orderkey % 3 as f from orders)
select r.q, case when f = 0 then 'section' when f = 1 then 'hybrid' when s then 'section' else 'hybrid' end as mode, case when f = 0 then coalesce(case when s then r.q % 7 end, top) when f = 2 and s then r.q % 7 end as sec from r left join t using (q)""",
    "section_family": r"""with s as (select source as doc, (doc_id % 5 + 1) || '.' || doc_id % 7 || '.' || doc_id as number, doc_id as a, n_chars as size from documents), p as (select doc, regexp_extract(number, '^(\d+\.\d+)', 1) as base from s where number like '2.%' union select doc, number from s where number like '1.3.%'),
f as (select s.doc, s.number, min(a) as o, min(size) as size, bool_or(number = base) as own from s join p on s.doc is not distinct from p.doc and (s.number = base or starts_with(s.number, base || '.')) where s.doc is not null group by 1, 2),
w as (select *, sum(size) over (partition by doc) as everything, min(case when own then o end) over (partition by doc) as lead from f) select doc, number from w where everything <= 120000 or (own and o = lead)""",
    "covered_lists": "with c as (select l_orderkey as sec, l_linenumber, max(l_quantity) as most, sum(l_linenumber) as n_items from lineitem group by 1, 2) select sec, count(*) as n, sum(n_items)::bigint as n_items from c group by 1 having min(most) > 10 and sum(n_items) >= 4",
    "display_dates": rf"with {_FILES} select doc_id, strftime(coalesce(own, mtime), '%Y-%m') as year_month, case when regexp_matches(text, '\b({'|'.join(dates.MONTHS)})\s+\d{{4}}\b') then regexp_replace(regexp_extract(text, '\b({'|'.join(dates.MONTHS)})\s+\d{{4}}\b'), '\s+', ' ') else strftime(coalesce(own, mtime), '%-m/%-d/%y') end as display from f",
    "cache_keys": r"select page_id, regexp_replace(regexp_extract(url || '.pdf', '([^/]*)$', 1), '\.[^.]*$', '') || '__' || sha256(url || '.pdf')[1:10] || '.pkl' as cache_name, sha256(concat_ws('||', page_id, url)) as stable_key from pages",
    "cross_rerank": "select conv_id, turn, row_number() over (partition by conv_id order by length(turn || ' ' || text) desc, turn || ' ' || text) as by_model, row_number() over (partition by conv_id order by turn) as by_fusion from conversations",
    "judge_calls": f"select answer, 'strict' as judge, 'score: ' || length(text) % 11 as reply from {_CONV} union all select answer, 'lenient', 'score: ' || 10 - length(text) % 3 from {_CONV}",
    "answer_claims": rf"""with c as (select answer, trim(regexp_replace(trim(text), '\s+', ' ', 'g')) as t from {_CONV}), s as (select answer, t, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)) as ls from c), u as (select answer, t, unnest(list_filter(ls, lambda x: x <> '')) as claim, generate_subscripts(list_filter(ls, lambda x: x <> ''), 1) - 1 as claim_no from s)
select answer, claim_no, sha256(claim) as claim_sha, case when length(claim) < 60 then 'supported' when (length(claim) + 1 + length(t)) % 2 = 1 then 'unsupported' else 'unverified' end as verdict from u""",
    "semantic_match": "with p as (select conv_id, trim(max(case when role = 'user' then text end)) as a, trim(max(case when role = 'assistant' then text end)) as b from conversations group by 1), v as (select conv_id, "
    + ", ".join(f"(length({c}) - length(replace({c}, '{x}', '')))::double as {c}{x}" for c in "ab" for x in "aeio")
    + " from p), s as (select conv_id, aa * ba + ae * be + ai * bi + ao * bo as dot, sqrt(aa * aa + ae * ae + ai * ai + ao * ao) * sqrt(ba * ba + be * be + bi * bi + bo * bo) as size from v) select conv_id, case when size > 0 then round(greatest(0.0, least(1.0, dot / size)), 4) end as match from s",
    "checked_decisions": f"with {_DEC} select \"at\", entry_id, status, reviewer, comment, corrected, error from chk",
    "decided_log": f"with {_DEC}, l as (select * from chk where error is null qualify row_number() over (partition by entry_id order by \"at\" desc, status) = 1) select o_orderkey as entry_id, coalesce(corrected, 'answer ' || o_orderkey) as answer, status, reviewer from orders left join l on entry_id = o_orderkey",
    "upload_checks": "select *, case when name is null or trim(name) = '' then 'no file' when lower(name) not like '%.pdf' then 'not a pdf' when coalesce(bytes, 0) = 0 then 'empty file' end as error from (select doc_id, case doc_id % 5 when 0 then null when 1 then '  ' when 2 then 'a.PDF' else source || '.txt' end as name, case when doc_id % 7 > 0 then n_chars end as bytes from documents)",
    "reply_schema": "select doc_id, case doc_id % 4 when 0 then 'a' || doc_id when 2 then 'x' when 3 then 'no number' end as answer, case doc_id % 4 when 0 then (doc_id % 10) / 10.0::double when 1 then 0.5 when 2 then 7.0 end as confidence, doc_id % 4 = 0 as valid from documents",
    "metadata_passages": "select conv_id, conv_id % 7 as doc, 0.5::double as score, sha256(text) as text_sha, false as synthetic from conversations union all select distinct conv_id, conv_id % 7, 1.0::double, sha256('Title: Title ' || conv_id % 7 || chr(10) || 'Date: ' || case when conv_id % 7 % 2 = 0 then 'May 2019' else 'unknown' end), true from conversations",
    "item_links": "with s as (select l_orderkey as answer, l_linenumber as place, l_suppkey % 5 as k from lineitem where l_linenumber <= 3), b as (select answer, k, min(place) as place from s group by 1, 2) select i.l_orderkey as answer, i.l_linenumber::bigint as no, case when b.place is not null then 'ev' || b.place when i.l_linenumber <= 3 then 'ev' || i.l_linenumber end as span_id from lineitem i left join b on b.answer = i.l_orderkey and b.k = i.l_partkey % 5",
    "evidence_ids": """with a as (select l_orderkey as answer, l_suppkey % 2 as doc, l_partkey % 3 * 10 as start, min(l_linenumber)::bigint as no, max(l_quantity * 2)::double as score from lineitem where l_partkey % 20 + 1 >= 12 group by 1, 2, 3)
select answer, 'ev' || row_number() over (partition by answer order by no, doc, start) as span_id, doc, start, start + 9 as "end", score, case when score >= 90 then 'grounded' when score >= 78 then 'partial' else 'ungrounded' end as label from a""",
}
#: Those that fold or pack have no SQL; tests hold them against plain versions.
PLAIN = ("section_chunks", "indent_levels", "doc_titles")
QUERIES = {name: globals()[name] for name in (*ORACLES, *PLAIN)}
