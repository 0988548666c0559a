"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

OP6 = r"""
with recursive dw as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sh as (
  select distinct doc_id, list_aggregate(w[i : i + least(5, len(w)) - 1], 'string_agg', ' ') as s
  from dw, unnest(generate_series(1, greatest(len(w) - 4, 1))) as t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from sh group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as i from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
m as (select a as doc_id, min(b) as component_id from r group by 1)
select m.doc_id, coalesce(n, 0) as n_shingles, component_id, m.doc_id = component_id as kept from m left join n using (doc_id)
"""

OP7 = r"""
with dw as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
iw as (
  select cast(item_id as varchar) as item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
win as (
  select distinct item_id, least(13, len(w)) as k, list_aggregate(w[i : i + least(13, len(w)) - 1], 'string_agg', ' ') as g
  from iw, unnest(generate_series(1, greatest(len(w) - 12, 1))) as t(i) where len(w) > 0),
ks as (select distinct k from win),
grams as (
  select doc_id, i, k, list_aggregate(w[i : i + k - 1], 'string_agg', ' ') as g
  from dw, ks, unnest(generate_series(1, len(w) - k + 1)) as t(i) where len(w) >= k),
found as (select doc_id, i, grams.k, item_id from grams join win using (g, k)),
pos as (select doc_id, count(distinct p) as n_hit from found, unnest(generate_series(i, i + k - 1)) as t(p) group by doc_id),
its as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as s from found group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join pos using (doc_id) left join its using (doc_id)
"""

OP8 = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as payload_bytes, sha256(b) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest, case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from d left join f using (payload_digest)
"""

OP9 = r"""
with l as (
  select doc_id, i, x, translate(regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(ls) as x, unnest(generate_series(1, len(ls))) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
r as (select k, max(doc_id) as last from l where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
m as (select l.*, r.k is not null and r.last <> l.doc_id as gone from l left join r using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(x, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""

OP11 = r"""
with recursive crc as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
runs as (
  select doc_id, run, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents)
  where length(run) >= 5 group by all),
bytes as (
  select run, n, flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, ''),
    lambda c: case when unicode(c) < 128 then [cast(unicode(c) as bigint)] else [cast(192 + (unicode(c) >> 6) as bigint), cast(128 + (unicode(c) & 63) as bigint)] end)) as b
  from runs),
hashed as (
  select run, n, xor(list_reduce(list_prepend(cast(4294967295 as bigint), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as h from bytes, crc),
v as (
  select word, cast(sum(n) as bigint) as n from (
    select case when h % 97 = 0 then run[1 : h % length(run)] || run[h % length(run) + 2 :] else run end as word, n from hashed)
  where length(word) >= 5 group by word having sum(n) >= 3),
cuts as (select word, n, i, word[1 : i] || word[i + 2 :] as rest from v, unnest(range(length(word))) as r(i)),
near as (
  select a.word, a.n, b.word as other, b.n as m from cuts a join cuts b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, a.n, b.word, b.n from cuts a join v b on a.rest = b.word
  union select b.word, b.n, a.word, a.n from cuts a join v b on a.rest = b.word),
best as (select word, count(*) as n_near, first(other order by m desc, other) as form, max(m) as form_n from near group by word),
forms as (
  select word, n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * n then form end as form, case when form_n >= 2 * n then form_n end as form_n
  from v left join best using (word)),
walk as (
  select word, coalesce(form, word) as root, 0 as k from forms
  union select w.word, f.form, k + 1 from walk w join forms f on f.word = w.root where f.form is not null)
select f.*, w.root from forms f join (select word, arg_max(root, k) as root from walk group by word) w using (word)
"""

OP12 = """
with v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select a.vec_id as query_id, b.vec_id, list_cosine_similarity(a.e, b.e) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 5
"""

OP13 = r"""
with t as (
  select doc_id, coalesce(text, '') as x, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
    sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents),
d as (
  select doc_id, x, u, cast(len(u) as bigint) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
    cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
  from t),
c as (
  select doc_id, x, u, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from d),
p as (
  select doc_id, x, n, form, coalesce(list_aggregate(u[1:a], 'string_agg', ''), '') as pre, coalesce(list_aggregate(u[a + 1 : b], 'string_agg', ''), '') as mid,
    coalesce(list_aggregate(u[b + 1 : n], 'string_agg', ''), '') as suf
  from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then x when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(x) as restored_sha256
from p
"""

ORACLE: dict[str, str] = {"op6_near_dedup": OP6, "op7_decontaminate": OP7, "op8_warc": OP8, "op9_line_dedup": OP9, "op11_spelling": OP11, "op12_nearest": OP12, "op13_fill_middle": OP13}
