"""DuckDB text for the queries whose results SQL can express."""

WARC_SQL = """
with r as (
  select page_id, coalesce(html, '') as body, strlen(coalesce(html, ''))::bigint as payload_bytes,
         sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from r where payload_bytes >= 100 group by 1)
select r.page_id, r.payload_bytes, r.payload_digest,
       case when r.payload_bytes >= 100 and r.page_id > f.first then 'revisit' else 'response' end as record_type,
       case when r.payload_bytes >= 100 and r.page_id > f.first then f.first end as refers_to
from r left join f using (payload_digest)
"""

_ESCAPED = r"""
replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'),
'[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'), '<start_of_turn>', '<\start_of_turn>'),
'<end_of_turn>', '<\end_of_turn>')
"""

CHAT_SQL = f"""
with t as (
  select conv_id::bigint as conv_id, turn::bigint as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
n as (
  select *, row_number() over w as k, lag(role) over w as before from t window w as (partition by conv_id order by turn nulls first, role, text)),
s as (
  select *, k = 1 or before <> role as starts from n)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length({_ESCAPED.format('text')}) + case when starts then length({_ESCAPED.format('role')}) + length('<|start|><|message|><|end|>') + 1
           else length('<|next|>') end)::bigint as formatted_chars
from s group by conv_id
"""


def _assigned(books: str) -> str:
    """(vec_id, part, d, e): the squared distance to the nearest entry of ``books`` and its index. Doubles hold these integers exactly."""
    return f"""
select vec_id, part, (least // 64)::bigint as d, (least % 64)::bigint as e from (
  select v.vec_id, v.part, min((list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, b.x) + list_inner_product(b.x, b.x))::bigint * 64 + b.e) as least
  from cut v join {books} b using (part) group by v.vec_id, v.part)"""


def _averaged(books: str, assigned: str) -> str:
    return f"""
select b.part, b.e, coalesce(m.x, b.x) as x from {books} b left join (
  select part, e, list(mean order by i) as x from (
    select part, e, i, floor(sum(v) / count(*)) as mean from (
      select c.part, a.e, unnest(c.x) as v, generate_subscripts(c.x, 1) as i from cut c join {assigned} a using (vec_id, part)) group by all)
  group by part, e) m using (part, e)"""


CODES_SQL = f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda v: floor(256 * v::double)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
cut as (select vec_id, p as part, x[p * len(x) // 16 + 1:(p + 1) * len(x) // 16] as x from kept, range(16) r(p)),
chosen as (select vec_id, row_number() over (order by vec_id) - 1 as e from kept order by vec_id limit 64),
b0 as (select part, e, x from cut join chosen using (vec_id)),
a0 as ({_assigned("b0")}), b1 as ({_averaged("b0", "a0")}),
a1 as ({_assigned("b1")}), b2 as ({_averaged("b1", "a1")}),
a2 as ({_assigned("b2")}),
coded as (select vec_id, string_agg(printf('%02x', e), '' order by part) as code, sum(d)::bigint as error from a2 group by vec_id),
digest as (select sha256(string_agg(v::bigint::varchar, ',' order by part, e, i)) as codebooks_sha256 from (
  select part, e, unnest(x) as v, generate_subscripts(x, 1) as i from b2))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join kept using (vec_id), digest
"""

MIDDLE_SQL = r"""
with units as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || doc_id) as h from documents),
drawn as (
  select *, len(u) as n, ('0x' || h[1:8])::bigint % (len(u) + 1) as c1, ('0x' || h[9:16])::bigint % (len(u) + 1) as c2,
         ('0x' || h[17:24])::bigint % 100 as c3, ('0x' || h[25:32])::bigint % 100 as c4 from units),
cut as (
  select *, array_to_string(u[1:least(c1, c2)], '') as prefix, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') as middle,
         array_to_string(u[greatest(c1, c2) + 1:], '') as suffix,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or c3 >= 100 then 'plain'
              when c4 < 50 then 'spm' else 'psm' end as form from drawn)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
       case when form <> 'plain' then length(middle) end::bigint as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256
from cut
"""

WINDOWS_SQL = r"""
with worded as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) as k from worded, unnest(range(1, len(w) - 48)) r(s)),
first as (select k, min(doc_id) as earliest from windows group by k),
gone as (select doc_id, s from windows join first using (k) where doc_id > earliest),
covered as (select distinct doc_id, unnest(range(s, s + 50)) as i from gone),
each as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from worded),
stays as (select doc_id, string_agg(word, ' ' order by i) as kept, count(*) as n from each anti join covered using (doc_id, i) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from worded left join stays using (doc_id)
"""

REPEATS_SQL = """
with h as (select doc_id, hex(coalesce(text, '')) as x, strlen(coalesce(text, ''))::bigint as n from documents),
windows as (select doc_id, s, substring(x, 2 * s + 1, 100) as k from h, unnest(range(0, n - 49)) r(s)),
first as (select k, min(doc_id) as earliest from windows group by k),
gone as materialized (select doc_id, s from windows join first using (k) where doc_id > earliest),
bytes as (select doc_id, p, substring(x, 2 * p + 1, 2) as pair from h, unnest(range(0, n)) r(p)),
marked as (select b.doc_id, b.p, b.pair, coalesce(b.p - g.s < 50, false) as removed from bytes b asof left join gone g on b.doc_id = g.doc_id and b.p >= g.s),
edged as (select *, removed and not coalesce(lag(removed) over (partition by doc_id order by p), false) as starts from marked),
summed as (select doc_id, count(*) filter (removed) as n_removed, count(*) filter (starts) as n_spans,
  string_agg(pair, '' order by p) filter (not removed) as kept from edged group by doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(kept, ''))) as kept_sha256 from h left join summed using (doc_id)
"""

NEAR_SQL = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as g from worded),
each as materialized (select doc_id, len(g) as n, unnest(g) as x from sets),
links as materialized (
  select a.doc_id as a, b.doc_id as b from each a join each b on a.x = b.x and a.doc_id <> b.doc_id group by all
  having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reached as (select doc_id, doc_id as r from sets union select doc_id, b from reached join links on r = a)
select doc_id, len(any_value(g))::bigint as n_shingles, min(r) as component_id, doc_id = min(r) as kept from sets join reached using (doc_id) group by doc_id
"""
