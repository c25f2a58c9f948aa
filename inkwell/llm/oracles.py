"""DuckDB SQL for the numbered queries that SQL can express: plain forms of what each returns, over the whole table."""

from __future__ import annotations

from .mixing import BLOCKS, MOST, SEED, SHARD_DOCS, SHARD_WORDS, WEIGHTS

#: Only A-Z are lowered; a word is a run without space, tab and the other ASCII line and form breaks.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

SUFFIX_DEDUP = """with d as (select doc_id, encode(coalesce(text, '')) as b from documents), l as (select doc_id, b, octet_length(b) as n from d),
p as (select doc_id, b, unnest(range(0, n - 199)) as p from l where n >= 200),
h as (select doc_id, p, md5(b[p + 1 : p + 200]) as h from p),
r as (select doc_id, p from h qualify count(*) over (partition by h) > 1),
g as (select doc_id, p, sum(case when p <= prev + 200 then 0 else 1 end) over (partition by doc_id order by p) as g from (select *, coalesce(lag(p) over (partition by doc_id order by p), -1000) as prev from r)),
s as (select doc_id, g, min(p) as lo, max(p) + 200 as hi from g group by 1, 2),
k as (select doc_id, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as lo, lo as hi from s union all select doc_id, max(hi), null from s group by 1),
t as (select k.doc_id, string_agg(hex(b[k.lo + 1 : coalesce(k.hi, n)]), '' order by k.lo) as kept from k join l using (doc_id) group by 1),
c as (select doc_id, count(*) as spans, sum(hi - lo)::bigint as removed from s group by 1)
select l.doc_id, n as n_bytes, coalesce(removed, 0) as n_removed, coalesce(spans, 0) as n_spans, case when kept is null then sha256(b) else sha256(unhex(kept)) end as kept_sha256 from l left join c using (doc_id) left join t using (doc_id)"""

JACCARD_JOIN = f"""with recursive w as (select doc_id, {_WORDS} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from s group by 1),
sets as (select n.doc_id, n, md5(string_agg(s, chr(10) order by s)) as same from n join s using (doc_id) group by 1, 2),
one as (select same, n, min(doc_id) as rep from sets group by 1, 2),
u as (select rep, n, s from one join s on s.doc_id = rep),
b as (select a.rep as x, b.rep as y, a.n as nx, b.n as ny, count(*) as nb from u a join u b on a.s = b.s and a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
e as (select x, y from b where 100 * nb >= 80 * (nx + ny - nb)), edges as (select x, y from e union select y, x from e),
reach as (select rep as a, rep as z from one union select reach.a, edges.y from reach join edges on edges.x = reach.z),
c as (select a as rep, min(z) as component_id from reach group by 1)
select w.doc_id, coalesce(sets.n, 0) as n_shingles, coalesce(c.component_id, w.doc_id) as component_id from w left join sets using (doc_id) left join one using (same) left join c using (rep)"""

_CASE = " ".join(f"when {i} then {w}" for i, w in enumerate(WEIGHTS))

# All quotients of every source and shard are ranked; the operator compares only those near the last that wins.
MIX = rf"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5('{SEED}:' || coalesce(doc_id::varchar, '')) as h from documents),
s as (select source, sum(size)::bigint as source_size, count(*) as docs from d group by 1),
n as (select *, row_number() over (order by source nulls last) as number, case (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} {_CASE} end as weight, source_size * {MOST} as cap from s),
a as (select *, cap / weight as ratio, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, number rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, number rows between current row and unbounded following) as level, row_number() over (order by cap / weight, number) as place from n),
b as (select *, arg_min(level, place) filter (level <= ratio) over () as lv from a),
t as (select source, source_size, greatest(1, ceil(source_size / {SHARD_WORDS}), ceil(docs / {SHARD_DOCS}))::bigint as shards, number, case when ratio <= lv then cap::double else weight * lv end as target from b),
k as (select sum(source_size)::bigint as total, greatest(1, ceil(sum(source_size) / {BLOCKS}))::bigint as block from s),
q as (select number, unnest(range(0, ceil(cap / block)::bigint)) as i, target from (select t.number, t.target, source_size * {MOST} as cap, block from t, k)),
w as (select number, count(*) as blocks from (select q.*, row_number() over (order by target / (2 * i + 1) desc, number) as r from q) , k where r <= total // block group by 1),
x as (select d.*, t.number, t.source_size, t.target, coalesce(w.blocks, 0) as blocks, ('0x' || h[1:8])::bigint % t.shards as shard from d join t on d.source is not distinct from t.source left join w using (number)),
p as (select number, shard, sum(size)::bigint as shard_size, any_value(blocks) as blocks from x group by 1, 2),
pq as (select number, shard, shard_size, blocks, unnest(range(0, ceil(shard_size * {MOST} / block)::bigint)) as i from p, k),
pw as (select number, shard, count(*) as n from (select *, row_number() over (partition by number order by shard_size / (2 * i + 1) desc, shard) as r from pq) where r <= blocks group by 1, 2),
f as (select number, shard, shard_size, least(coalesce(n, 0) * block, shard_size * {MOST}) as quota from p left join pw using (number, shard), k),
o as (select x.*, shard_size, quota, coalesce(sum(size) over (partition by number, shard order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as earlier from x join f using (number, shard))
select doc_id, size, source_size, coalesce(target, 0) as target, case when shard_size > 0 then (quota // shard_size * size + greatest(0, least(size, quota % shard_size - earlier)))::bigint else 0 end as taken from o"""

_BITS = {c: 1 << i for i, c in enumerate("ABCDE")}
_BIT = lambda of: "case " + of + " " + " ".join(f"when '{c}' then {b}" for c, b in _BITS.items()) + " end"

FILTER_AUDIT = rf"""with recursive d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
+ 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask from d left join l using (doc_id)),
s as (select part, mask, count(*) as n, sum(good) as n_good, sum(toxic) as n_toxic from m group by 1, 2),
o as (select '' as o union all select o || c from o, (values ('A'), ('B'), ('C'), ('D'), ('E')) as v(c) where not contains(o, c)),
k as (select o as filter_order, step, {_BIT("o[step]")} as own, (select coalesce(sum({_BIT("o[j]")}), 0) from range(1, step) as r(j))::bigint as earlier from (select o, unnest(range(1, 6)) as step from o where length(o) = 5)),
x as (select part, filter_order, step, n, n_good, n_toxic, mask, own, mask & own > 0 as fails, mask & earlier > 0 as taken from s, k)
select part, filter_order, step::int as step, coalesce(sum(n) filter (not fails and not taken), 0)::bigint as kept, coalesce(sum(n) filter (fails and not taken), 0)::bigint as removed, coalesce(sum(n) filter (fails and taken), 0)::bigint as redundant, coalesce(sum(n) filter (mask = own), 0)::bigint as unique_fails,
coalesce(sum(n_good) filter (fails and not taken), 0)::bigint as good_lost, coalesce(sum(n_toxic) filter (fails and not taken), 0)::bigint as toxic_lost, coalesce(sum(n * (120 // greatest(1, bit_count(mask)))) filter (fails), 0)::bigint as shapley from x group by 1, 2, 3"""

COLLOCATIONS = r"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p), t as (select lang, sum(len(w))::bigint as n from w group by 1),
g as (select lang, w[i : i + k - 1] as g from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (values (1), (2), (3)) as v(k))),
f as (select lang, g, count(*) as f from g group by 1, 2 having count(*) >= 10),
c as (select a.lang, a.g, a.f as a, k, l.f as l, r.f as r, (1000000::hugeint * a.f * a.f // (l.f::hugeint * r.f))::bigint as score from (select *, unnest(range(1, len(g))) as k from f where len(g) > 1) a
join f l on l.lang = a.lang and l.g = a.g[1 : k] join f r on r.lang = a.lang and r.g = a.g[k + 1 :]),
b as (select * from c qualify row_number() over (partition by lang, g order by score, k) = 1),
h as (select lang, g, max(f) as f from (select lang, g[1 : 2] as g, f from f where len(g) = 3 union all select lang, g[2 : 3], f from f where len(g) = 3) group by 1, 2),
s as (select b.*, array_to_string(b.g, ' ') as phrase from b left join h on h.lang = b.lang and h.g = b.g where len(b.g) = 3 or h.f is null or 100 * h.f < 50 * b.a)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score from s join t using (lang) qualify rank <= 2000"""

ORACLES = {"op1_suffix_dedup": SUFFIX_DEDUP, "op4_jaccard_join": JACCARD_JOIN, "op10_mix": MIX, "op11_filter_audit": FILTER_AUDIT, "op13_collocations": COLLOCATIONS}
