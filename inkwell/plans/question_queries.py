"""Queries of question understanding, lists, the catalog and text graders, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, claims, items, session, understanding
from ..sources.tables import table
from .queries_sql import SENTENCES, TOKENS

_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_asks = lambda p: f"regexp_matches(lower(text), '(^|[^a-z0-9_])({p})([^a-z0-9_]|$)')"


def lexical_variants(spark: SparkSession, d: str) -> DataFrame:
    return understanding.lexical_variants(table(spark, d, "benchmark"), "item_id")


def question_expansion(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark")
    return understanding.ordered_expansion(q, understanding.lexical_variants(q, "item_id"), "item_id")


def rule_expansion(spark: SparkSession, d: str) -> DataFrame:
    return understanding.rule_expansion(table(spark, d, "conversations").where("role = 'user'").withColumn("question", F.concat_ws(":", "conv_id", "turn")), "question")


def enumeration_cues(spark: SparkSession, d: str) -> DataFrame:
    return understanding.enumeration_cues(table(spark, d, "conversations")).select("conv_id", "turn", "cues", "wants_set", "cue_score")


def doc_name_match(spark: SparkSession, d: str) -> DataFrame:
    docs = session.registry(table(spark, d, "documents"))
    n = F.substring("reg_id", 2, 9).cast("long")
    asked = F.when(n % 4 == 0, F.upper("reg_id")).when(n % 4 == 1, F.substring("label", 1, 3)).when(n % 4 == 2, F.upper("label")).otherwise("no such document")
    return understanding.document_matches(docs.select(n.alias("q_id"), asked.alias("text")), docs, "q_id")


def list_markers(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<li[^>]*>([^<]*)"), F.lit(1))).alias("line_no", "item"))
    i = F.col("line_no")
    roman = F.element_at(F.array(*map(F.lit, items.ROMAN)), i % 20 + 1)
    lead = F.when(i % 6 == 0, F.concat((i + 1).cast("string"), F.lit(") "))).when(i % 6 == 1, F.concat(F.char(97 + i % 26), F.lit(")  "))).when(i % 6 == 2, F.concat(roman, F.lit(". "))).when(i % 6 == 3, F.concat((i + 1).cast("string"), F.lit(". "))).when(i % 6 == 4, "  • ").otherwise("")
    return items.with_markers(li.select("page_id", i.cast("long").alias("line_no"), F.concat(lead, "item").alias("text"))).drop("text")


def nav_sections(spark: SparkSession, d: str) -> DataFrame:
    n, ratio, nav = items.navigational(F.col("ls"))
    # every third document gets leaders of a table of contents at its line ends
    lines = F.transform(F.split("text", "\n"), lambda x: F.when((F.col("doc_id") % 3 == 0) & (F.length(x) % 2 == 0), F.concat(x, F.lit(" ..... 12"))).otherwise(x))
    return table(spark, d, "documents").select("doc_id", lines.alias("ls")).select("doc_id", n.alias("n_lines"), F.round(ratio, 4).alias("leader_ratio"), nav.alias("is_nav"))


def full_text_rebuild(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", items.rebuilt_text(F.col("text")).alias("t")).where("t <> ''")
    return x.select("doc_id", F.length("t").cast("long").alias("rebuilt_chars"), F.sha2("t", 256).alias("rebuilt_sha"))


def doc_labels(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/in/"), F.lpad("doc_id", 9, "0")).alias("path"), F.when(F.col("doc_id") % 5 == 0, F.concat("source", F.lit("-"), "doc_id")).otherwise(F.col("source")).alias("base_name"), (2000 + F.col("n_chars") % 20).cast("string").alias("version_label"))
    return catalog.distinct_labels(x).select("doc_id", "label")


def cache_worklist(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("fingerprint"))
    was = docs.where("path % 3 <> 0").select(F.when(F.col("path") % 7 == 0, F.col("path") + 1_000_000_000).otherwise(F.col("path")).alias("path"), F.when(F.col("path") % 5 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return catalog.cache_status(docs, was)


def _replies(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("doc_id").cast("string")
    forms = [F.concat(F.lit('{"confidence": 0.'), q, F.lit(', "reasoning": "ok"}')), F.concat(F.lit("Verdict follows. {\"score\": "), F.expr("cast(doc_id % 130 as string)"), F.lit("} Thanks.")), F.concat(F.lit("Confidence: "), F.expr("cast(doc_id % 100 as string)"), F.lit("%")), F.lit("score is .9"), F.lit("I cannot say."), F.lit("")]
    return table(spark, d, "labels").select("doc_id", F.element_at(F.array(*forms), (F.col("doc_id") % 6 + 1).cast("int")).alias("reply"))


def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).select("doc_id", F.round(claims.judge_score(F.col("reply")), 6).alias("confidence"))


def meta_claims(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    phrase = F.element_at(F.array(*map(F.lit, claims.META)), ((F.col("conv_id") + F.col("turn")) % len(claims.META) + 1).cast("int"))
    verdict = F.element_at(F.array(*map(F.lit, ["supported", "unsupported", "contradicted", "error", "supported"])), (F.col("turn") % 5 + 1).cast("int"))
    return claims.claim_rollup(c.select("conv_id", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("The  "), F.upper(phrase), F.lit(" this."))).otherwise(F.col("text")).alias("claim"), verdict.alias("verdict")), "conv_id")


def numeric_tokens(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("doc_id", F.array_sort(claims.numbers(F.col("text"))).alias("n"))
    return n.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.array_join("n", ",").alias("numbers_csv"))


def numeric_consistency(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    pairs = docs.select("doc_id", F.col("text").alias("answer")).join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("context")), "doc_id")
    return claims.numeric_consistency(pairs).drop("answer", "context")


def structure_score(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 2 == 0).alias("wants_set"), (F.col("doc_id") % 10).alias("n_items"))
    return claims.structure_score(c).select("doc_id", "n_sentences", "n_paragraphs", "score", "flags")


def version_dates(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    day = F.date_format("ts", "yyyyMMdd")
    created = F.when(i % 4 == 0, F.concat(F.lit("D:"), day, F.lit("120000Z"))).when(i % 4 == 1, "D:20241399")
    modified = F.when(i % 4 == 1, F.when(i % 8 == 1, F.concat(F.lit("D:"), day)).otherwise("soon"))
    text = F.when(i % 3 == 0, F.concat(F.lit("Issued "), F.upper(F.element_at(F.array(*map(F.lit, claims.MONTHS)), (i % 12 + 1).cast("int"))), F.lit("  20"), F.lpad((i % 30).cast("string"), 2, "0"), F.lit(". May 1999"))).otherwise("Mayor 2001")
    x = claims.version(e.select("event_id", created.alias("created"), modified.alias("modified"), text.alias("text"), F.col("ts").alias("mtime")), "created", "modified", "text", "mtime")
    return x.select("event_id", F.date_format("version_date", "yyyy-MM-dd").alias("version_date"), "version_source")


_VARIANTS = f"""t as (select item_id, text, {TOKENS} as t from benchmark),
s as (select item_id, list_aggregate(list_transform(list_sort(list_transform(list_distinct(t), lambda w: [list_position(t, w)::varchar.lpad(9, '0'), w])), lambda p: p[2])[1:6], 'string_agg', ' ') as six from t),
f as (select item_id, text, unnest([1, 2, 3])::bigint as variant_no, unnest([array_to_string(t, ' '), array_to_string(t[greatest(len(t) - 3, 1) : len(t)], ' '), coalesce(six, '')]) as variant from t join s using (item_id)),
v as (select item_id, variant_no, variant from f where variant <> '' and lower(variant) <> lower(text))"""
_STYLE = r"""case when regexp_matches(t, '^\s*(\d{1,3})\)(?:\s+|\s*$)') then 'paren_num' when regexp_matches(t, '^\s*([a-z])\)(?:\s+|\s*$)') then 'paren_alpha' when regexp_matches(t, '^\s*((?i:x{0,3}(?:ix|iv|v?i{1,3}|v)))\.(?:\s+|\s*$)') then 'roman' when regexp_matches(t, '^\s*(\d{1,3})\.(?:\s+[A-Za-z(]|\s*$)') then 'dot_num' when regexp_matches(t, '^\s*([•●▪–\-])(?:\s+|\s*$)') then 'bullet' end"""
_NUMBERS = r"list_distinct(regexp_extract_all(regexp_replace(%s, '[^A-Za-z0-9_.]', ' ', 'g'), '\b(\d+(?:\.\d+)?)\b', 1))"
_COUNT = r"(len(regexp_extract_all(trim(%s), '[.;:]\s+[A-Z0-9(]')) + 1)"
_UNIT = lambda x: f"greatest(0.0::double, least(1.0::double, case when try_cast({x} as double) > 1 then try_cast({x} as double) / 100 else try_cast({x} as double) end))"

ORACLES = {
    "lexical_variants": f"with {_VARIANTS} select item_id, variant_no, variant from v",
    "question_expansion": f"with {_VARIANTS}, a as (select item_id, 0::bigint as n, trim(text) as sub_query from benchmark union all select item_id, variant_no, variant from v) select item_id, row_number() over (partition by item_id order by n) as pos, sub_query from (select item_id, sub_query, min(n) as n from a where sub_query <> '' group by 1, 2)",
    "rule_expansion": "with r(no, t, s) as (values " + ", ".join(f"({i + 1}, {_list(t)}, {_list(s)})" for i, (t, s) in enumerate(understanding.RULES)) + ") select conv_id || ':' || turn as question, no::bigint as rule_no, unnest(s) as sub_query from conversations, r where role = 'user' and len(list_filter(t, lambda w: contains(lower(text), w))) > 0",
    "enumeration_cues": f"""with c as (select conv_id, turn, text, {TOKENS} as t from conversations),
h as (select conv_id, turn, list_filter([{', '.join(f"case when {_asks(p)} then '{n}' end" for n, p in understanding.CUES.items())}, case when list_contains(t, 'criteria') or len(list_filter(t[greatest(len(t) - 2, 1) : len(t)], lambda w: length(w) > 3 and w[-1] = 's')) > 0 then 'plural head noun' end], lambda x: x is not null) as h, {_asks(understanding.FACT)} as f from c),
g as (select conv_id, turn, h, f and not list_contains(h, 'quantifier') as f from h)
select conv_id, turn, array_to_string(list_concat(h, case when f then ['-specific fact form'] else [] end), ',') as cues, len(h) > 0 and (not f or len(h) >= 2) as wants_set, round(least(1.0::double, len(h) / 3), 2) as cue_score from g""",
    "doc_name_match": """with r as (select row_number() over (order by source) as n, source as label from (select distinct source from documents)),
q as (select n as q_id, lower(case n % 4 when 0 then 'd' || n when 1 then label[1:3] when 2 then label else 'no such document' end) as q from r order by n limit 50),
m as (select q_id, count(*) as n, min(label) as one, max(case when q = 'd' || r.n then label end) as named from q join r on q = 'd' || r.n or contains(lower(label), q) group by 1)
select q_id, case when named is not null then 1 else coalesce(n, 0) end::bigint as n_matches, coalesce(named, case when n = 1 then one end) as resolved from q left join m using (q_id)""",
    "list_markers": rf"""with p as (select page_id, regexp_extract_all(html, '<li[^>]*>([^<]*)', 1) as l from pages), i as (select page_id, unnest(range(0, len(l))) as i, unnest(l) as item from p),
l as (select page_id, i as line_no, (case i % 6 when 0 then (i + 1) || ') ' when 1 then chr((97 + i % 26)::int) || ')  ' when 2 then {_list(items.ROMAN)}[i % 20 + 1] || '. ' when 3 then (i + 1) || '. ' when 4 then '  • ' else '' end) || item as t from i),
s as (select *, {_STYLE} as style from l),
m as (select *, case when style is not null then regexp_extract(t, '^\s*([A-Za-z0-9]+|[•●▪–\-])', 1) end as marker from s)
select page_id, line_no, style, marker, case when style in ('paren_num', 'dot_num') then marker::bigint when style = 'paren_alpha' then ascii(marker)::bigint - 96 when style = 'roman' then nullif(list_position({_list(items.ROMAN)}, lower(marker)), 0)::bigint end as ordinal,
trim(case when style is null then t else regexp_replace(t, '^\s*([A-Za-z0-9]+[).]|[•●▪–\-])\s*', '') end) as body from m""",
    "nav_sections": r"""with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: case when doc_id % 3 = 0 and length(x) % 2 = 0 then x || ' ..... 12' else x end), lambda x: regexp_matches(x, '\S')) as f from documents),
r as (select doc_id, len(f) as n, case when len(f) > 0 then len(list_filter(f, lambda x: regexp_matches(x, '\.{3,}\s*\d+\s*$') or regexp_matches(x, '^\s*\d+(\.\d+)*\s+\S.*\s\d{1,3}\s*$'))) / len(f) else 0.0::double end as r from l) select doc_id, n as n_lines, round(r, 4) as leader_ratio, n >= 10 and r > 0.4 as is_nav from r""",
    "full_text_rebuild": f"""with s as (select doc_id, {SENTENCES} as s from documents), w as (select doc_id, i, s[i + 1 : i + 6] as p from (select doc_id, s, unnest(range(0, len(s), 3)) as i from s)),
x as (select doc_id, unnest(p) as x, unnest(range(0, len(p))) + i as n from w where length(array_to_string(p, ' ')) / 4 > 15), f as (select doc_id, x, min(n) as n from x where x <> '' group by 1, 2), t as (select doc_id, string_agg(x, ' ' order by n) as t from f group by 1) select doc_id, length(t) as rebuilt_chars, sha256(t) as rebuilt_sha from t""",
    "doc_labels": "with x as (select doc_id, '/in/' || lpad(doc_id::varchar, 9, '0') as path, case when doc_id % 5 = 0 then source || '-' || doc_id else source end as b, (2000 + n_chars % 20)::varchar as v from documents) select doc_id, case when count(*) over (partition by b) = 1 then b when row_number() over (partition by b, v order by path) = 1 then b || ' [' || v || ']' else b || ' [' || v || '] (' || sha256(path)[1:6] || ')' end as label from x",
    "cache_worklist": "with c as (select doc_id as path, sha256(text) as f from documents), m as (select case when path % 7 = 0 then path + 1000000000 else path end as path, case when path % 5 = 0 then 'old' else f end as f from c where path % 3 <> 0) select path, case when c.f is null then 'stale' when c.f = m.f then 'hit' else 'miss' end as status from c full join m using (path)",
    "judge_parse": f"""with r as (select doc_id, case doc_id % 6 when 0 then '0.' || doc_id when 1 then (doc_id % 130)::varchar when 2 then (doc_id % 100)::varchar when 3 then '9' end as v from labels) select doc_id, round(case when v is null then null else {_UNIT('v')} end, 6) as confidence from r""",
    "meta_claims": f"""with c as (select conv_id, case when turn % 3 = 0 then 'The  ' || upper({_list(claims.META)}[(conv_id + turn) % {len(claims.META)} + 1]) || ' this.' else text end as claim, ['supported', 'unsupported', 'contradicted', 'error', 'supported'][turn % 5 + 1] as v from conversations),
k as (select conv_id, case when len(list_filter({_list(claims.META)}, lambda p: contains(lower(regexp_replace(claim, '\\s+', ' ', 'g')), p))) > 0 then 'meta' else v end as k from c),
g as (select conv_id, count(*) as total, {', '.join(f"count(*) filter (k = '{n}') as {n}" for n in ('supported', 'unsupported', 'contradicted', 'error', 'meta'))} from k group by 1) select *, case when total > meta then round(supported / (total - meta), 4) end as ratio from g""",
    "numeric_tokens": f"select doc_id, len(n) as n_numbers, array_to_string(list_sort(n), ',') as numbers_csv from (select doc_id, {_NUMBERS % 'text'} as n from documents)",
    "numeric_consistency": f"""with n as (select doc_id, {_NUMBERS % 'text'} as n from documents), p as (select a.doc_id, a.n as a, b.n as c from n a join n b on b.doc_id = a.doc_id + 1)
select doc_id, len(a) as total, len(list_intersect(a, c)) as grounded, case when len(a) > 0 then round(len(list_intersect(a, c)) / len(a), 4) end as consistency, array_to_string(list_transform(list_sort(list_transform(list_filter(a, lambda x: not list_contains(c, x)), lambda x: [lpad(length(x)::varchar, 9, '0'), x])), lambda x: x[2]), ',') as ungrounded from p""",
    "structure_score": rf"""with x as (select doc_id, text, doc_id % 2 = 0 as w, doc_id % 10 as i, {_COUNT % 'text'} as s, list_filter(string_split_regex(text, '\n\s*\n'), lambda p: regexp_matches(p, '\S')) as p, regexp_matches(text, '(?m)^\s*([-•*]|\d+[.)]|[a-z][.)])\s+') as b, regexp_matches(text, '(?m)^\s*[A-Z][^\n]{{0,60}}:\s*$') or regexp_matches(text, '\*\*[^*]+\*\*') as h, regexp_matches(text, '\S') as there from documents),
f as (select doc_id, s, len(p) as n, there, [there and s >= 8 and len(p) <= 1 and not b, there and list_max(list_transform(p, lambda q: {_COUNT % 'q'})) > 6 and not b, there and w and i >= 4 and not (b or h or len(p) >= 3), there and (w or i >= 8) and not (b or h)] as f from x)
select doc_id, s as n_sentences, n as n_paragraphs, case when there then round(greatest(0.0::double, 1 - (case when f[1] then 0.45::double else 0 end + case when f[2] then 0.2::double else 0 end + case when f[3] then 0.25::double else 0 end + case when f[4] then 0.1::double else 0 end)), 3) end as score, array_to_string(list_filter([case when f[1] then 'wall_of_text' end, case when f[2] then 'overlong_paragraph' end, case when f[3] then 'set_question_not_grouped' end, case when f[4] then 'no_visual_structure' end], lambda t: t is not null), ',') as flags from f""",
    "version_dates": """with e as (select event_id, ts::date as day, case when event_id % 4 = 0 or event_id % 8 = 1 then ts::date end as pdf, case when event_id % 3 = 0 then make_date(2000 + event_id % 30, event_id % 12 + 1, 1) end as named from events)
select event_id, strftime(coalesce(pdf, named, day), '%Y-%m-%d') as version_date, case when event_id % 4 = 0 then 'metadata_creation' when event_id % 8 = 1 then 'metadata_modification' when named is not null then 'text' else 'file_time' end as version_source from e""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
