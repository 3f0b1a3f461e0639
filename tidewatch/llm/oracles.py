"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPLICATES = rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORDS}) as w from documents),
n as (select doc_id, case when len(w) >= 5 then list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
x as (select doc_id, len(s) as n, unnest(s) as shingle from n),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common, any_value(a.n) as na, any_value(b.n) as nb from x a join x b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p where 100 * common >= 75 * (na + nb - common)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from n union select r.a, e.b from r join e on r.b = e.a),
c as (select a, min(b) as component_id from r group by a)
select n.doc_id, len(s)::bigint as n_shingles, component_id, n.doc_id = component_id as kept from n join c on c.a = n.doc_id"""

_ESCAPED = lambda x, more="": f"replace(replace(replace({x}, chr(92), 'xx'), '#', 'xx'), '<', 'xx')" if not more else f"replace({_ESCAPED(x)}, ':', 'xx')"

CHAT = rf"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -7, t, r, chr(92) || '### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) as v(t, r)),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as whole,
 coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
 sum(14 + length({_ESCAPED("role", ":")}) + length({_ESCAPED("text")}))::bigint as formatted_chars from c group by conv_id)
select conv_id, n_turns, sha256(whole) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g"""

MIXING = rf"""with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, {WORDS})), 0)::bigint as size,
 md5('mix-0' || coalesce(doc_id::varchar, 'null') || '/' || md5(coalesce(text, '')) || '/' || (row_number() over (partition by doc_id, source, md5(coalesce(text, ''))) - 1)::varchar) as key from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight, source_size * 2.0::double as cap from s0),
s2 as (select *, cap / weight as ratio from s1),
s3 as (select *, coalesce(sum(cap) over o, 0.0::double) as before_cap, coalesce(sum(weight) over o, 0.0::double) as before_weight, sum(source_size) over () as all_size, sum(weight) over () as all_weight
 from s2 window o as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
s4 as (select *, (all_size::double * 1.5::double - before_cap) / (all_weight - before_weight) as level from s3),
s5 as (select level as first_level from s4 where level <= ratio order by ratio, coalesce(source, '') limit 1),
s as (select source, source_size, case when (select count(*) from s5) = 0 then cap else least(cap, (select first_level from s5) * weight) end as target from s4),
q as (select doc_id, d.source, size, key, source_size, target, sum(size) over (partition by d.source order by key rows unbounded preceding) as cum from d join s on d.source is not distinct from s.source),
e as (select *, (cum + epoch * source_size) / target as finish from q cross join (select unnest([0, 1]) as epoch) where size > 0 and target > 0),
f as (select doc_id, source, size, key, sum(size) over (order by finish, key, coalesce(source, '') rows unbounded preceding) as running from e),
n as (select key, source, count(*) as copies from f where running <= (select sum(target) from s) * (1 + 1e-12::double) group by key, source)
select q.doc_id, q.source, q.size, source_size, target, coalesce(copies, 0)::bigint as copies, (coalesce(copies, 0) * q.size)::bigint as taken
from q left join n on n.key = q.key and n.source is not distinct from q.source"""
