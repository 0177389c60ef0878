"""SQL for the operators that SQL can express, written apart from their implementation."""

from __future__ import annotations

from .quality_rules import COMMON_WORDS

WARC = r"""
with base as (select page_id, url, page_id * 60 as ts, '"' || md5(html) || '"' as etag, 'day ' || (page_id % 977) as modified, md5(html) as digest, octet_length(encode(html)) as length from pages),
rec as (
 select page_id * 3 as record_id, 0 as kind, url, ts, etag, modified, digest, length from base
 union all select page_id * 3 + 1, 1, url, ts + 3600, case when page_id % 4 = 0 then '"other"' else 'W/' || etag end, null, null, 0 from base
 union all select page_id * 3 + 2, 2, regexp_replace(url, '^https?://(www\.)?', 'HTTP://WWW.') || (case when contains(url, '?') then '&' else '?' end) || 'utm_source=again', ts + 86400, null, modified, null, 0 from base),
a as (select *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from rec),
b as (select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') as host,
  regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/index\.html?$', ''), '/+$', '') as path,
  list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)'))) as params from a),
c as (select *, host || path || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as page from b),
j as (select r.record_id, r.kind, r.page, r.ts, r.etag, r.modified, f.record_id as t_id, f.ts as t_ts, f.etag as t_etag, f.modified as t_mod, f.digest as t_digest, f.length as t_length,
  row_number() over (partition by r.record_id order by f.ts desc nulls last, f.record_id desc) as k
  from c r left join c f on f.kind = 0 and f.page = r.page and f.ts < r.ts where r.kind > 0),
o as (select *, case when t_id is null then 'missing' when etag is not null then (case when regexp_replace(etag, '^W/', '') = t_etag then 'resolved' else 'mismatch' end) when modified = t_mod then 'resolved' else 'mismatch' end as outcome from j where k = 1)
select record_id, page, ts, outcome, case when outcome = 'resolved' then t_id end as target_id, case when outcome = 'resolved' then t_ts end as target_ts, case when outcome = 'resolved' then t_digest end as payload_digest,
 case when outcome = 'resolved' then t_length end as payload_length,
 case when outcome = 'resolved' then 'cache-control: max-age=' || (case when kind = 1 then '3600' else '60' end) || chr(10) || 'content-length: ' || t_length || chr(10) || 'content-type: text/html' || chr(10) ||
  'date: ' || ts || chr(10) || 'etag: ' || (case when kind = 1 then etag else t_etag end) end as headers from o"""

MIX = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as key from documents),
s as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as w from (select source, sum(size)::bigint as source_size from d group by source)),
r as (select *, 3 * source_size as cap, 3 * source_size / w as ratio from s),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(w) over (order by ratio, source nulls last rows between current row and unbounded following) as level from r),
g as (select source, source_size, w, least(cap::double, max(case when level <= ratio then level end) over () * w) as target from l),
b as (select *, greatest(1, least(greatest(32, sum(source_size) over () // 1073741824), source_size // 1024))::bigint as block, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as cycles from g),
q0 as (select *, (source_size + block - 1) // block as blocks from b),
q1 as (select *, cycles * blocks + least(blocks, floor((target - cycles * source_size) / block + 0.5))::bigint as slots from q0),
q as (select *, sum(slots) over (order by source nulls last rows between unbounded preceding and current row) - slots as first, (sum(slots) over ())::bigint as n from q1),
u as (select any_value(n) as n, round(any_value(n) * 0.6180339887498949::double)::bigint as g from q),
m as (select n, min(x) as m from (select n, unnest(range(greatest(1, g), g + 1000)) as x from u) where gcd(x, n) = 1 group by n),
k as (select source, blocks, row_number() over (partition by source order by id) - 1 as rank from (select id, (id::hugeint * m % n)::bigint as p from (select unnest(range(n)) as id, m, n from m)) join q on p >= first and p < first + slots),
n as (select source, rank % blocks as block, count(*) as times from k group by all),
e as (select *, coalesce(sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start from d),
x as (select e.*, q.block as wide, source_size, target, unnest(case when size > 0 then range(start // q.block, (start + size - 1) // q.block + 1) else [null] end) as block from e join q on e.source is not distinct from q.source)
select x.doc_id, x.size, x.source_size, x.target, coalesce(sum((least(start + size, (x.block + 1) * wide) - greatest(start, x.block * wide)) * times), 0)::bigint as taken
from x left join n on x.source is not distinct from n.source and x.block = n.block group by x.doc_id, x.size, x.source_size, x.target, x.start"""

WORDS = ", ".join(f"'{w}'" for w in COMMON_WORDS)
RULES = rf"""
with d as (select doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
w as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from d),
tri as (select *, lead(word) over x as b, lead(word, 2) over x as c from w window x as (partition by doc_id order by i)),
twice as (select doc_id, word, b, c from tri where c is not null group by all having count(*) > 1),
marked as (select distinct doc_id, unnest([i, i + 1, i + 2]) as j from tri join twice using (doc_id, word, b, c)),
rep as (select doc_id, count(*) as n from marked group by doc_id),
lines as (select doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) as line from d),
dup as (select doc_id, count(*) - count(distinct line) as n from lines group by doc_id),
f as (select d.doc_id, lang, len(words) as n_words, coalesce(length(array_to_string(words, '')), 0) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words,
  len(regexp_extract_all(text, '[a-z]')) as lower, len(regexp_extract_all(text, '[A-Z]')) as upper, len(regexp_extract_all(text, '[0-9]')) as digit, len(regexp_extract_all(text, '[\x20\x09-\x0D]')) as space,
  length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) as beyond, length(text) as n_chars
  from d left join dup using (doc_id) left join rep using (doc_id)),
ch as (select doc_id, lang, unnest([lower, upper, digit, space, n_symbols, n_chars - lower - upper - digit - space - n_symbols - beyond, beyond]) as n, unnest([1, 2, 3, 4, 5, 6, 7]) as bin from f),
kw as (select d.doc_id, lang, v.word as bin, count(w.word) as n from d cross join (select unnest([{WORDS}]) as word) v left join w on w.doc_id = d.doc_id and w.word = v.word group by all),
cw as (select * from kw union all select d.doc_id, any_value(d.lang), ' other', any_value(len(d.words)) - sum(kw.n) from d join kw using (doc_id) group by d.doc_id),
p1 as (select doc_id, n::double / nullif(sum(n) over (partition by doc_id), 0) as p, sum(n) over (partition by lang, bin)::double / nullif(sum(n) over (partition by lang), 0) as q, sum(n) over (partition by doc_id) as total from ch),
p2 as (select doc_id, n::double / nullif(sum(n) over (partition by doc_id), 0) as p, sum(n) over (partition by lang, bin)::double / nullif(sum(n) over (partition by lang), 0) as q, sum(n) over (partition by doc_id) as total from cw),
j1 as (select doc_id, any_value(total) as total, sqrt(greatest(0, sum((case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end) + (case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end)) / 2)) as dist from p1 group by doc_id),
j2 as (select doc_id, any_value(total) as total, sqrt(greatest(0, sum((case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end) + (case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end)) / 2)) as dist from p2 group by doc_id),
z as (select f.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, case when j1.total >= 200 then j1.dist end as char_distance, case when n_words >= 200 then j2.dist end as word_distance from f join j1 using (doc_id) join j2 using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(char_distance, 0) <= 0.30 and coalesce(word_distance, 0) <= 0.24 as kept,
 round(char_distance, 4) as char_distance, round(word_distance, 4) as word_distance from z"""

ORACLE = {"op5_warc_revisits": WARC, "op7_quality_rules": RULES, "op9_source_mix": MIX}
