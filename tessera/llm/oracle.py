"""DuckDB SQL for the rows of those queries that SQL can express.  It goes by plain
definitions - all windows, all pairs with a shingle in common - not by the
operators' methods."""

OP1 = """
with p as (select page_id, coalesce(html, '') as h from pages),
s as (select page_id, strlen(h) as n, sha1(h) as x, max(page_id) over (partition by h) as first from p),
d as (
  select page_id, n, first, list_aggregate(list_transform(range(32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::integer >> (15 - 5 * (i % 4))) & 31)::integer, 1)), 'string_agg', '') as digest
  from s)
select page_id, n as payload_bytes, digest as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from d
"""

# places are byte offsets: a text is written out as two hexadecimal digits a byte
OP2 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
b as (select doc_id, start, substr(x, 2 * start + 1, 2198) as y from (select doc_id, x, unnest(range(0, length(x) // 2 - 99, 1000)) as start from d where length(x) >= 200)),
w as (
  select doc_id, start + off as pos, doc_id::hugeint * 4294967296 + start + off as place, md5(substr(y, 2 * off + 1, 200)) as s
  from (select doc_id, start, y, unnest(range(least(1000, length(y) // 2 - 99))) as off from b)),
f as (select s, min(place) as first from w group by s having count(*) > 1),
g as (select doc_id, pos from w join f on w.s = f.s where place <> first),
m as (select doc_id, pos, max(pos + 100) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as before from g),
r as (select doc_id, pos, sum(case when before >= pos then 0 else 1 end) over (partition by doc_id order by pos) as run from m),
s as (select doc_id, run, min(pos) as lo, max(pos) + 100 as hi from r group by doc_id, run),
k as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as past from s),
e as (
  select d.doc_id, count(k.lo) as n_spans, coalesce(sum(hi - lo), 0)::bigint as n_removed,
    coalesce(string_agg(substr(x, 2 * past + 1, 2 * (lo - past)), '' order by lo), '') || substr(any_value(x), 2 * coalesce(max(hi), 0) + 1) as kept, any_value(length(x) // 2) as n_bytes
  from d left join k on d.doc_id = k.doc_id group by d.doc_id)
select doc_id, n_bytes, n_removed, n_spans, sha256(unhex(kept)) as kept_sha256 from e
"""

OP3 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (
  select *, length(replace(replace(replace(replace(replace(text, '\', '\\'), '[INST]', '\I'), '[/INST]', '\i'), '<', '\l'), '>', '\r')) as n_text,
    length(replace(replace(replace(replace(replace(role, '\', '\\'), '[INST]', '\I'), '[/INST]', '\i'), '<', '\l'), '>', '\r')) as n_role
  from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(case when role = 'user' then length('<s>[INST][/INST]</s>') + n_text else length('<s><<>></s>') + n_role + n_text end)::bigint as formatted_chars
from e group by conv_id
"""

OP4 = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select distinct doc_id, case when len(w) < 3 then w else w[i:i + 2] end as shingle
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 85 * (a.n + b.n - shared)),
sides as (select x, y from links union all select y, x from links),
reach as (select doc_id as x, doc_id as y from w union select r.x, e.y from reach r join sides e on r.y = e.x)
select w.doc_id, coalesce(n.n, 0) as n_shingles, c.least as component_id, w.doc_id = c.least as kept
from w left join n on n.doc_id = w.doc_id join (select x, min(y) as least from reach group by x) c on c.x = w.doc_id
"""

_letters = lambda word: "".join(f"[{c.upper()}{c}]" for c in word)
_keys = "|".join([*map(_letters, ("password", "passwd", "secret", "token")), f"{_letters('api')}_?{_letters('key')}"])
_patterns = {
    "assign": rf"""({_keys})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{16,}",
    "token": "[A-Za-z0-9+/_-]{20,}",
}
_found = " union all ".join(
    f"select row, source, lang, '{k}' as kind, string_split_regex(t, '{p}') as gaps, regexp_extract_all(t, '{p}', 0) as hits, regexp_extract_all(t, '{p}', {2 if k == 'assign' else 0}) as vals from d" for k, p in _patterns.items()
)
OP5 = f"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t, source, lang from documents),
f as ({_found}),
u as (select row, source, lang, kind, generate_subscripts(hits, 1) as i, unnest(hits) as hit, unnest(gaps[1:len(hits)]) as gap, unnest(vals) as value from f where len(hits) > 0),
p as (select *, (sum(length(gap) + length(hit)) over (partition by row, kind order by i))::bigint as e from u),
c as (
  select row, source, lang, kind, e - length(hit) as s, e, e - length(value) as v, value from p
  where case kind when 'assign' then length(value) >= 12 when 'access' then length(hit) >= 18 when 'hex' then true else regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]') end),
o as (
  select value, count(distinct coalesce('=' || source, '-')) as owners, count(distinct coalesce('=' || source, '-') || chr(0) || coalesce('=' || lang, '-')) as repos,
    len(list_distinct(string_split(value, ''))) as letters
  from c group by value),
z as (
  select row, kind, s, e, true as base, list_position(['assign', 'access', 'hex'], kind) as nth from c where kind <> 'token'
  union all
  select distinct row, k, v, e, false, list_position(['live', 'dull', 'example'], k) + 3
  from (select row, v, e, case when owners >= 3 or owners > 1 and repos >= 3 * owners then 'example' when letters >= 6 then 'live' else 'dull' end as k from c join o on c.value = o.value)),
j as (
  select row, count(*) filter (base and kind = 'assign') as a, count(*) filter (base and kind = 'access') as k, count(*) filter (base and kind = 'hex') as h,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, nth, e) filter (base) as based, string_agg(kind || ':' || s || ':' || e, ',' order by s, nth, e) as spans
  from z group by row)
select doc_id, coalesce(a, 0) as n_assign, coalesce(k, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(based, '')) as base_sha256, coalesce(spans, '') as spans
from d left join j on d.row = j.row
"""

ORACLE_SQL = {
    "op1_arc_to_warc": OP1,
    "op2_suffix_dedup": OP2,
    "op3_chat_prefix_tree": OP3,
    "op4_minhash_near_dedup": OP4,
    "op5_secret_scan": OP5,
}
