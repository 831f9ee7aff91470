"""DuckDB SQL for the queries that SQL can express, over the driver's views.

Sources are mixed by a schedule that looks ahead, neighbours depend on random projections, tokens on
merge tables, and scores and surrogates are learnt or keyed; those queries are compared with brute
force, exact round trips or held-out labels in tests/llm instead.
"""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '{WORDS}') as words from documents),
runs as (
  select doc_id, unnest(list_transform(range(1, greatest(len(words) - 3, 1) + 1), lambda i: array_to_string(words[i:i + 3], ' '))) as s
  from w where len(words) > 0),
shingles as (select distinct doc_id, s from runs),
sizes as (select doc_id, count(*) as n from shingles group by 1),
linked as (
  select a.doc_id as x, b.doc_id as y
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
  join sizes p on p.doc_id = a.doc_id join sizes q on q.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, p.n, q.n having 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach as (
  select doc_id as x, doc_id as y from documents
  union
  select r.x, l.y from reach r join linked l on l.x = r.y),
least as (select x as doc_id, min(y) as component_id from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join sizes using (doc_id) join least using (doc_id)"""

OP8 = """
with p as (select page_id, coalesce(html, '') as body, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages),
h as (select page_id, payload_bytes, sha1(body) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) as largest from h)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id < largest then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < largest then largest end as refers_to
from m"""

#: The CRC is a fold over the text's bytes with a table of 256 remainders, made by eight halvings each.
OP9 = """
with recursive step as (
  select unnest(range(256)) as k, unnest(range(256)) as c, 0 as i
  union all
  select k, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i + 1 from step where i < 8),
tab as (select list(c order by k) as t from step where i = 8),
d as (
  select doc_id, coalesce(text, '') as text, octet_length(encode(coalesce(text, ''))) + 1 as size from documents),
sums as (
  select doc_id, size, xor(list_reduce(list_prepend(cast(4294967295 as bigint),
    list_transform(range(1, size), lambda i: cast('0x' || substr(hex(encode(text)), 2 * i - 1, 2) as bigint))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as text_crc32 from d, tab),
crc as (
  select doc_id, size, text_crc32, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), ':' || cast(text_crc32 as varchar))), 1, 3) as integer) as vslot from sums),
slots as (
  select vslot, cast(sum(size) as bigint) as bytes, count(*) as rows, row_number() over (order by sum(size) desc, vslot) as k from crc group by vslot),
deal as (
  select cast(0 as bigint) as k, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[] as loads, cast(-1 as bigint) as vslot, cast(-1 as bigint) as shard
  union all
  select s.k, list_transform(loads, lambda l, i: case when i = list_position(loads, list_min(loads)) then l + s.bytes else l end), s.vslot, list_position(loads, list_min(loads)) - 1
  from deal join slots s on s.k = deal.k + 1),
map as (
  select s.vslot, cast(shard as integer) as shard, coalesce(sum(s.rows) over (partition by shard order by s.vslot rows between unbounded preceding and 1 preceding), 0) as first_row
  from deal join slots s on s.vslot = deal.vslot)
select doc_id, cast(size as bigint) as size, text_crc32, 'bytes' as law, shard,
  cast(first_row + row_number() over (partition by c.vslot order by doc_id, text_crc32) - 1 as bigint) as slot, cast(null as integer) as grown_shard, c.vslot as virtual_slot
from crc c join map m on m.vslot = c.vslot"""

OP10 = rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (
  select *, regexp_extract_all(text, '{WORDS}') as words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORDS}')) as lines from d),
n as (
  select *, len(words) as n_words, length(array_to_string(words, '')) as word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, len(lines) as n_lines from w),
windows as (select doc_id, unnest(range(1, n_words - 6)) as i, unnest(list_transform(range(1, n_words - 6), lambda k: array_to_string(words[k:k + 7], ' '))) as s from n where n_words >= 8),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, s) > 1),
covered as (select doc_id, count(distinct i + k) as n_repeat_words from twice, (select unnest(range(8)) as k) group by 1),
b as (select n.*, coalesce(n_repeat_words, 0) as n_repeat_words from n left join covered using (doc_id)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b)
select doc_id, n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 100 * n_symbols > 20 * n_words or (n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines) or word_chars > 14 * n_words or word_chars < 2 * n_words
    or 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 40 * word_chars
    or (n_words >= 50 and len(list_distinct(words)) * len(list_distinct(words)) < n_words) or 100 * (length(text) - length(translate(text, '!?', ''))) > 30 * n_words) as kept
from f"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1, "op8_warc_revisits": OP8, "op9_virtual_slots": OP9, "op10_rule_cascade": OP10}
