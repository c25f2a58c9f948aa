"""Queries of enumerated items, heading places and page maps over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import placement, segments, structure
from ..operators.items import ROMAN
from ..sources.tables import table

#: By (7 no + 3 doc_id) mod 11: the mark put before a line of a document, which has none of its own.
MARKS = {0: "1) ", 1: "2)  ", 2: "3) ", 3: "a) ", 4: "b) ", 5: "• ", 6: "ii. ", 7: "9) "}
_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PAGE_LINES = 12  # lines of a page of those documents


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Every document with marks before most of its lines, whole; it begins at 1,000 times its id modulo 7."""
    k = (F.col("no") * 7 + F.col("doc_id") * 3) % 11
    mark = F.coalesce(*[F.when(k == i, m) for i, m in MARKS.items()], F.lit(""))
    x = structure.text_lines(table(spark, d, "documents")).withColumn("line", F.concat(mark, "line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "line"))), lambda s: s["line"]), "\n")
    return x.groupBy("doc_id").agg(body.alias("body")).withColumn("char_start", F.col("doc_id") % 7 * 1_000)


def section_items(spark: SparkSession, d: str) -> DataFrame:
    x = segments.section_items(_marked(spark, d), ["doc_id"])
    return x.select("doc_id", "index", "depth", "style", "marker", F.sha2("label", 256).alias("label_sha"), F.sha2(F.array_join("parents", " > "), 256).alias("parents_sha"), F.sha2("text", 256).alias("text_sha"), F.sha2("raw", 256).alias("raw_sha"), "char_start", "char_end")


def section_item_groups(spark: SparkSession, d: str) -> DataFrame:
    return segments.item_groups(segments.section_items(_marked(spark, d), ["doc_id"]), ["doc_id"], label=None)


def list_sections(spark: SparkSession, d: str) -> DataFrame:
    return segments.list_sections(section_item_groups(spark, d), ["doc_id"])


def picked_items(spark: SparkSession, d: str) -> DataFrame:
    """Groups and items of the documents that are picked, every third one."""
    picked = table(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id")
    return structure.chosen_items(picked, section_item_groups(spark, d), "doc_id")


def item_groups(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("pos")).agg((F.min("l_partkey") % 3).cast("long").alias("depth"))
    return segments.item_groups(items, ["l_orderkey"], "pos", label=None).select("l_orderkey", "group_no", "heading", "n_items")


def structural_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Questions are benchmark items; each picks three documents as sections. A view shows every even document's first 2,000 characters."""
    docs = _marked(spark, d)
    sections = docs.select((F.col("doc_id") % 20).alias("doc"), F.col("doc_id").alias("sec"), F.concat(F.lit("Section "), F.col("doc_id").cast("string")).alias("title"), "body", "char_start")
    picked = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.explode(F.array(*[(F.col("item_id") * 3 + i) % 150 for i in range(3)])).alias("sec")).withColumn("doc", F.col("sec") % 20)
    view = picked.where("sec % 2 = 0").select("q", "doc", (F.col("sec") % 7 * 1_000).alias("doc_start"), (F.col("sec") % 7 * 1_000 + 2_000).alias("doc_end"), (F.col("sec") * 10).alias("view_start"))
    x = segments.structural_extraction(picked, sections, view, "q", "doc", "sec")
    return x.select("q", "item_id", F.sha2("heading", 256).alias("heading_sha"), "section", F.sha2("text", 256).alias("text_sha"), "marker", "depth", "char_start", "char_end", "view_start", "view_end", "score", "grounding")


def _paged(spark: SparkSession, d: str) -> DataFrame:
    """Lines (doc, page, line_no, text) of all documents; some have a number before them, on the same line or one above."""
    n = F.concat_ws(".", (F.col("no") % 30 + 1).cast("string"), (F.col("no") % 4 + 1).cast("string"))
    text = F.when(F.col("no") % 4 == 1, F.concat(n, F.lit(" "), "line")).when(F.col("no") % 4 == 2, F.concat(n, F.lit("\n"), "line")).otherwise(F.col("line"))
    x = structure.text_lines(table(spark, d, "documents"))
    return x.select(F.col("doc_id").alias("doc"), F.expr(f"no div {PAGE_LINES}").alias("page"), F.col("no").alias("line_no"), text.alias("text"), "line", n.alias("n"))


def heading_places(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks of every fifth and every seventh line, on pages up to two away; one in eleven is of a title that isn't there."""
    lines = _paged(spark, d)
    title = F.when(F.col("line_no") % 11 == 5, F.concat(F.lit("Zq "), "line")).when(F.col("line_no") % 3 == 0, F.translate("line", _LOW, _UP)).otherwise(F.col("line"))
    marks = lines.where("line_no % 5 = 1 or line_no % 7 = 2").select("doc", F.col("line_no").alias("seq"), (F.col("line_no") % 3 + 1).alias("level"), F.concat_ws("  ", "n", title).alias("title"), (F.col("page") + 1 + F.col("line_no") % 5 - 2).alias("page"))
    found = placement.located(placement.bookmark_entries(marks), placement.page_texts(lines))
    return found.select("doc", "seq", "level", "number", F.sha2("title", 256).alias("title_sha"), "page", "start")


def bookmark_tree(spark: SparkSession, d: str) -> DataFrame:
    """Sections of bookmarks of which every third stands at the same place as the one before it."""
    lines = structure.text_lines(table(spark, d, "documents")).where("no % 4 = 0")
    heads = lines.select("doc_id", (F.col("no") / 4).cast("long").alias("seq"), F.expr("(no div 4) % 3 + 1").cast("long").alias("level"), F.concat(F.lit("H"), F.col("no").cast("string")).alias("full_title"), F.when(F.expr("(no div 4) % 3 = 2"), F.col("start") - 1).otherwise(F.col("start")).alias("at"))
    docs = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"))
    flat = heads.select("doc_id", "seq", "level", "full_title", F.expr("at div 400 * 400").alias("start"))
    return structure.section_tree(flat.join(docs, "doc_id"), order="seq")


def page_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of seven lines of each document, by the pages they begin and end on."""
    lines = _paged(spark, d)
    texts = placement.page_texts(lines)
    spans = texts.select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long"), F.lit(500).cast("long"))).alias("char_start")).withColumn("char_end", F.col("char_start") + 700)
    return placement.with_page_stamps(spans, texts)


def paged_text(spark: SparkSession, d: str) -> DataFrame:
    x = placement.paged_text(placement.page_texts(_paged(spark, d)))
    back = F.forall("segments", lambda s: s["doc_end"] > s["doc_start"])
    return x.select("doc", F.sha2("text", 256).alias("text_sha"), F.size("segments").cast("long").alias("pages"), F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + s["view_start"]).alias("starts"), back.alias("whole"))


_LINES = r"l as (select doc_id, generate_subscripts(ls, 1) - 1 as no, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null))"
_MARK = " ".join(f"when {i} then '{m}'" for i, m in MARKS.items())
_ROMAN = "list_position([" + ", ".join(f"'{r}'" for r in ROMAN) + "], lower(m))"
_STYLES = {"paren_num": r"^\s*(\d{1,3})\)(?:\s|$)", "paren_alpha": r"^\s*([a-z])\)(?:\s|$)", "roman": r"^\s*((?i:x{0,3}(?:ix|iv|v?i{1,3}|v)))\.(?:\s|$)", "dot_num": r"^\s*(\d{1,3})\.(?:\s+[A-Za-z(]|\s*$)", "bullet": r"^\s*([•●▪–\-])(?:\s|$)"}
_STYLE = lambda c: "case " + " ".join(f"when regexp_matches({c}, '{p}') then '{s}'" for s, p in _STYLES.items()) + " end"
_GROUP = lambda c, s: f"case {s} " + " ".join(f"when '{k}' then regexp_extract({c}, '{p}', 1)" for k, p in _STYLES.items()) + " end"
_END = {"bullet": "", "roman": r"\.", "dot_num": r"\."}
_TOKEN = lambda c, s, g: f"regexp_extract({c}, {g}, 0)"
# A line's place is the sum of the lines before it; the runs of numbers at each depth are a list that goes from mark to mark.
_ITEMS = rf"""with recursive {_LINES},
k as (select doc_id, no, case (no * 7 + doc_id * 3) % 11 {_MARK} else '' end || line as line from l),
a as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding), 0)::bigint as place, {_STYLE("line")} as style from k),
g as (select *, max(case when style is not null then no end) over (partition by doc_id order by no) as mark from a),
p as (select doc_id, mark as no, min(place) as place, arg_min(style, no) as style, arg_min(line, no) as head, string_agg(line, chr(10) order by no) as piece from g where mark is not null group by 1, 2),
s as (select *, {_GROUP("head", "style")} as m, min(no) over (partition by doc_id, style) as seen from p),
v as (select doc_id, place, piece, style, dense_rank() over (partition by doc_id order by seen) as d, row_number() over (partition by doc_id order by no) as i, case when style in ('paren_num', 'dot_num') then m::bigint when style = 'paren_alpha' then ascii(m) - 96 when style = 'roman' then {_ROMAN} end as val from s),
f as (select doc_id, 0::bigint as i, [null, null, null, null, null]::bigint[] as runs, true as ok from (select distinct doc_id from v)
union all select v.doc_id, v.i, case when val is null then list_transform(range(1, 6), lambda j: case when j = d then null else runs[j] end) when {{ok}} then list_transform(range(1, 6), lambda j: case when j < d then runs[j] when j = d then val end) else runs end, {{ok}} from f join v on v.doc_id = f.doc_id and v.i = f.i + 1),
b as (select v.*, sum(f.ok::int) over (partition by v.doc_id order by v.i) as g, f.ok from v join f using (doc_id, i)),
t as (select doc_id, g, min(place) as place, min(case when ok then d end) as d, regexp_replace(string_agg(piece, chr(10) order by i), '\s+$', '') as raw from b where g > 0 group by 1, 2),
n as (select *, dense_rank() over (partition by doc_id order by d) - 1 as depth from t),
e as (select *, row_number() over (partition by doc_id order by g) as index, trim(regexp_replace(string_split(raw, chr(10))[1], '\s+', ' ', 'g')) as label, trim(regexp_replace(raw, '\s*\n\s*', ' ', 'g')) as flat from n where length(regexp_replace(raw, '^\s+', '')) >= 5),
o as (select *, {_STYLE("flat")} as style from e),
h as (select *, case style {" ".join(f"when '{s}' then regexp_extract(flat, '{p.split('(?:', 1)[0] if s != 'roman' else r'^\s*(?i:x{0,3}(?:ix|iv|v?i{1,3}|v))\.'}', 0)" for s, p in _STYLES.items())} end as token from o),
r as (select h.*, coalesce((select string_agg(q.label, ' > ' order by q.g) from h q where q.doc_id = h.doc_id and q.g < h.g and q.depth < h.depth and not exists (select 1 from h z where z.doc_id = h.doc_id and z.g > q.g and z.g < h.g and z.depth <= q.depth)), '') as parents from h),
item as (select doc_id, index, depth, style, trim(token) as marker, label, parents, coalesce(nullif(trim(substr(flat, length(token) + 1)), ''), flat) as text, raw, doc_id % 7 * 1000 + place as char_start, doc_id % 7 * 1000 + place + length(raw) as char_end from r)""".replace("{ok}", "(val is null or runs[d] is null or (val > runs[d] and val <= runs[d] + 3) or (d > 1 and val = 1))")
_GROUPS = lambda src, key, pos: f"""gh as (select *, coalesce(depth = 0 and lead(depth) over (partition by {key} order by {pos}) > 0, false) as heads from {src}),
gl as (select *, last_value(case when depth = 0 then heads end ignore nulls) over (partition by {key} order by {pos} rows between unbounded preceding and 1 preceding) as top, row_number() over (partition by {key} order by {pos}) as rn from gh),
gg as (select *, sum((heads or rn = 1 or (depth = 0 and coalesce(top, false)))::int) over (partition by {key} order by {pos})::bigint as group_no from gl)"""  # noqa: E731
_PAGED = rf"""{_LINES}, pl as (select doc_id as doc, no, no // {PAGE_LINES} as page, line, (no % 30 + 1) || '.' || (no % 4 + 1) as n from l), pt as (select *, case no % 4 when 1 then n || ' ' || line when 2 then n || chr(10) || line else line end || chr(10) as t from pl),
pp as (select doc, page, string_agg(t, '' order by no) || chr(10) as body from pt group by 1, 2), po as (select *, (sum(length(body)) over (partition by doc order by page))::bigint as e from pp), pg as (select doc, page, body, e - length(body) as s, e from po), tx as (select doc, string_agg(body, '' order by page) as text, max(page) as last from pg group by 1)"""
_page = lambda at: f"coalesce((select min(page) from pg where pg.doc = x.doc and s <= {at} and {at} < e), last)"

ORACLES = {
    "section_items": _ITEMS + " select doc_id, index, depth, style, marker, sha256(label) as label_sha, sha256(parents) as parents_sha, sha256(text) as text_sha, sha256(raw) as raw_sha, char_start, char_end from item",
    "section_item_groups": _ITEMS + ", " + _GROUPS("item", "doc_id", "index") + " select doc_id, group_no, max(case when heads then index end) as heading, count(*) filter (not heads) as n_items, min(case when not heads then index end) as first, max(case when not heads then index end) as last from gg group by 1, 2 having count(*) filter (not heads) > 0",
    "list_sections": _ITEMS + ", " + _GROUPS("item", "doc_id", "index") + ", gr as (select doc_id, group_no, count(*) filter (not heads) as n from gg group by 1, 2) select doc_id, sum(n)::bigint as n_items from gr group by 1 having sum(n) >= 5",
    "picked_items": _ITEMS + ", " + _GROUPS("item", "doc_id", "index") + ", gr as (select doc_id, group_no, count(*) filter (not heads) as n from gg group by 1, 2 having count(*) filter (not heads) > 0) select doc_id, count(*) as n_groups, sum(n)::bigint as n_items from gr where doc_id % 3 = 0 group by 1",
    "item_groups": "with i as (select l_orderkey, l_linenumber::bigint as pos, min(l_partkey) % 3 as depth from lineitem group by 1, 2), " + _GROUPS("i", "l_orderkey", "pos") + " select l_orderkey, group_no, max(case when heads then pos end) as heading, count(*) filter (not heads) as n_items from gg group by 1, 2 having count(*) filter (not heads) > 0",
    "structural_extraction": _ITEMS + ", " + _GROUPS("item", "doc_id", "index") + """, sh as (select *, max(case when heads then label end) over (partition by doc_id, group_no) as heading from gg), pk as (select distinct item_id as q, unnest([item_id * 3 % 150, (item_id * 3 + 1) % 150, (item_id * 3 + 2) % 150]) as sec from benchmark),
vw as (select q, sec % 20 as doc, sec % 7 * 1000 as a, sec % 7 * 1000 + 2000 as z, sec * 10 as v from pk where sec % 2 = 0), it as (select pk.q, sh.*, row_number() over (partition by pk.q order by doc_id % 20, doc_id, index) - 1 as no from pk join sh on sh.doc_id = pk.sec where not heads),
seen_at as (select it.q, doc_id, index, min((v + char_start - a, v + char_start - a + greatest(1, least(char_end, z) - char_start))) as v from it join vw on vw.q = it.q and vw.doc = doc_id % 20 and a <= char_start and char_start < z group by 1, 2, 3)
select it.q, 'i' || lpad(no::varchar, 4, '0') as item_id, sha256(coalesce(heading, 'Section ' || doc_id)) as heading_sha, 'Section ' || doc_id as section, sha256(text) as text_sha, marker, depth, char_start, char_end, v[1] as view_start, v[2] as view_end, case when v is null then 0.0::double else 100.0::double end as score, case when v is null then 'ungrounded' else 'grounded' end as grounding from it left join seen_at using (q, doc_id, index)""",
    "heading_places": rf"""with recursive {_PAGED}, bm as (select doc, no as seq, no % 3 + 1 as level, trim(regexp_replace(n || '  ' || case when no % 11 = 5 then 'Zq ' || line when no % 3 = 0 then translate(line, '{_LOW}', '{_UP}') else line end, '\s+', ' ', 'g')) as whole, page + no % 5 - 2 as page, row_number() over (partition by doc order by no) as i from pl where no % 5 = 1 or no % 7 = 2),
en as (select doc, seq, level, page, i, whole, regexp_matches(whole, '^\d{{1,2}}(\.\d{{1,2}}){{0,4}}\s+.{{2,120}}$') as has from bm), es as (select en.doc, seq, level, page, i, case when has then regexp_extract(whole, '^(\d{{1,2}}(?:\.\d{{1,2}}){{0,4}})\s', 1) else '' end as number, case when has then trim(regexp_replace(whole, '^\d{{1,2}}(\.\d{{1,2}}){{0,4}}\s+', '')) else whole end as title, greatest(0, least(last, page)) as pg from en join tx using (doc)),
ew as (select es.*, (select s from pg where pg.doc = es.doc and page = greatest(0, es.pg - 1)) as lo, (select e from pg where pg.doc = es.doc and page = least(last, es.pg + 1)) as hi, (select s from pg where pg.doc = es.doc and page = es.pg) as top, (select e from pg where pg.doc = es.doc and page = es.pg) as foot from es join tx using (doc)),
f as (select doc, 0::bigint as i, 0::bigint as start from tx union all
select doc, i, case when hit >= cur then hit else greatest(cur, top) end from (select doc, i, cur, top, b + coalesce(case when number <> '' then coalesce(nullif(strpos(w, number || chr(10) || title), 0), nullif(strpos(w, number || ' ' || title), 0), nullif(strpos(w, chr(10) || number || chr(10)), 0)) end, nullif(strpos(w, title), 0), nullif(strpos(lower(w), lower(title)[1:60]), 0)) - 1 as hit
from (select *, substr(text, b + 1, z - b) as w from (select ew.*, f.start as cur, text, case when greatest(lo, f.start) < hi then greatest(lo, f.start) else top end as b, case when greatest(lo, f.start) < hi then hi else foot end as z from f join ew on ew.doc = f.doc and ew.i = f.i + 1 join tx on tx.doc = f.doc))))
select es.doc, seq, level, number, sha256(title) as title_sha, page, start from es join f using (doc, i)""",
    "bookmark_tree": rf"""with {_LINES}, st as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding), 0)::bigint as start from l), h as (select doc_id, no // 4 as i, (no // 4) % 3 + 1 as level, 'H' || no as t, (case when (no // 4) % 3 = 2 then start - 1 else start end) // 400 * 400 as start, length(text) as n from st join documents using (doc_id) where no % 4 = 0),
tr as (select h.doc_id, i as sec_no, coalesce((select string_agg(a.t, ' > ' order by a.i) from h a where a.doc_id = h.doc_id and a.i < h.i and a.level < h.level and not exists (select 1 from h z where z.doc_id = h.doc_id and z.i > a.i and z.i < h.i and z.level <= a.level)) || ' > ', '') || t as path, level, start as char_start, coalesce(lead(start) over (partition by doc_id order by i), n) as e, n from h)
select doc_id, sec_no, path, level, char_start, case when e > char_start then e else least(n, char_start + 1) end as char_end from tr union all select doc_id, -1, 'Front matter', 1, 0, char_start from tr where sec_no = 0 and char_start > 200""",
    "page_stamps": f"with {_PAGED}, x as (select doc, last, unnest(range(0, length(text) + 1, 500)) as char_start from tx) select doc, char_start, char_start + 700 as char_end, {_page('char_start')} as page_start, {_page('(char_start + 699)')} as page_end from x",
    "paged_text": f"with {_PAGED}, v as (select *, '[Page ' || page + 1 || ']' || chr(10) as head from pg), w as (select *, (sum(length(head) + length(body)) over (partition by doc order by page))::bigint - length(body) as view_start from v) select doc, sha256(string_agg(head || body, '' order by page)) as text_sha, count(*) as pages, sum(view_start)::bigint as starts, bool_and(e > s) as whole from w group by 1",
}
QUERIES = {name: globals()[name] for name in ORACLES}
