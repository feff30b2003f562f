"""SQL for the corpus queries that SQL can express, written for the checking engine from the contract alone."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+')"
_ITEM_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Links between sets of five-word shingles by shared shingles, then everything reachable.
JACCARD_JOIN = f"""
with recursive d as (
  select row_number() over () as rk, doc_id, {_WORDS} as w from documents
), s as (
  select rk, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda k : array_to_string(w[k:k + 4], ' ')) end)) as g from d
), n as (
  select rk, count(*) as n, sha256(string_agg(g, chr(10) order by g)) as fp from s group by rk
), cls as (
  select min(n.rk) as c, any_value(n.n) as n, min(doc_id) as class_id, count(*) as class_size, fp from n join d using (rk) group by fp
), cs as (
  select c, n, g from cls join s on s.rk = cls.c
), e as (
  select a.c as a, b.c as b from cs a join cs b on a.g = b.g and a.c <> b.c and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  group by a.c, b.c having 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), r as (
  select c as a, c as b from cls union select r.a, e.b from r join e on r.b = e.a
), comp as (
  select a, min(class_id) as component_id from r join cls on cls.c = r.b group by a
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id, coalesce(class_id, d.doc_id) as class_id,
  coalesce(class_size, 1) as class_size
from d left join n using (rk) left join cls on cls.fp = n.fp left join comp on comp.a = cls.c
"""

#: Windows met as strings at every place of every text.
DECONTAMINATION = f"""
with d as (
  select row_number() over () as rk, doc_id, {_ITEM_WORDS} as w from documents
), i as (
  select item_id, {_ITEM_WORDS} as w from benchmark
), wins as (
  select distinct item_id, size, array_to_string(w[p:p + size - 1], ' ') as win from (
    select item_id, w, least(len(w), 13) as size, unnest(range(1, len(w) - least(len(w), 13) + 2)) as p from i where len(w) > 0) x
), places as (
  select rk, size, p, array_to_string(w[p:p + size - 1], ' ') as win from (
    select rk, w, s.size, unnest(range(1, len(w) - s.size + 2)) as p from d, (select distinct size from wins) s where len(w) >= s.size) x
), met as (
  select q.rk, q.p, q.size, k.item_id from places q join wins k on k.win = q.win and k.size = q.size
), hits as (
  select rk, count(distinct place) as hit from (select rk, unnest(range(p, p + size)) as place from (select distinct rk, p, size from met) y) x group by rk
), named as (
  select rk, count(*) as items, string_agg(item, ',' order by item) as list from (select distinct rk, cast(item_id as varchar) as item from met) x group by rk
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(hit, 0) as bigint) as n_hit, cast(coalesce(items, 0) as bigint) as n_items,
  sha256(coalesce(list, '')) as items_sha256, coalesce(hit, 0) > 0 and 20 * coalesce(hit, 0) >= len(d.w) as contaminated
from d left join hits using (rk) left join named using (rk)
"""

#: Lines as lists of words (or characters where they have few words), met by what is left without one element.
LINE_DEDUP = """
with d as (
  select row_number() over (order by doc_id nulls last) as rk, doc_id, coalesce(text, '') as text from documents
), l as (
  select rk, unnest(string_split(text, chr(10))) as raw, unnest(range(0, len(string_split(text, chr(10))))) as line_no from d
), n as (
  select rk, line_no, array_to_string(regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') as line from l
), o as (
  select rk, line_no, line, row_number() over (order by rk, line_no) as place from n where line <> ''
), f as (
  select line, min(place) as first, len(string_split(line, ' ')) >= 8 as by_word from o group by line
), w as (
  select line, first, by_word, case when by_word then string_split(line, ' ') else string_split(line, '') end as w from f where by_word or length(line) >= 8
), cuts as (
  select line, first, by_word, w, unnest(range(1, len(w) + 1)) as i from w
), without as (
  select line, first, by_word, i, len(w) as n, list_concat(w[:i - 1], w[i + 1:]) as rest from cuts where by_word or not regexp_matches(w[i], '[0-9]')
), replaced as (
  select line, first, min(first) over (partition by by_word, n, i, rest) as least from without
), shorter as (
  select line, first, by_word, rest as w, false as whole from without union all select line, first, by_word, w, true from w
), inserted as (
  select line, first, whole, min(case when whole then first end) over g as short, min(case when not whole then first end) over g as long from shorter window g as (partition by by_word, w)
), near as (
  select line from replaced where least < first union select line from inserted where whole and long < first union select line from inserted where not whole and short < first
), gone as (
  select o.rk, o.line_no, o.place > f.first as exact from o join f using (line) left join near on near.line = o.line where o.place > f.first or near.line is not null
), s as (
  select rk, count(*) filter (exact) as n_exact, count(*) filter (not exact) as n_near, string_agg(cast(line_no as varchar), ',' order by line_no) as dropped from gone group by rk
)
select d.doc_id, cast(len(string_split(text, chr(10))) as bigint) as n_lines, coalesce(n_exact, 0) as n_exact, coalesce(n_near, 0) as n_near, coalesce(dropped, '') as dropped
from d left join s using (rk)
"""

#: Matches from what lies between them; windows of candidates as rows of characters.
SECRET_SCAN = """
with d as (
  select row_number() over () as rk, doc_id, coalesce(text, '') as t from documents
), pats(kind, p) as (
  values (0, '(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'), (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]{24,}'), (3, '[A-Za-z0-9+/_=-]{20,}')
), f as (
  select rk, kind, t, case kind
    when 0 then regexp_extract_all(t, '(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
    when 1 then regexp_extract_all(t, 'AKIA[A-Z0-9]+') when 2 then regexp_extract_all(t, '[0-9a-f]{24,}') else regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}') end as found,
    case kind when 0 then regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) end as vals,
    case kind when 0 then string_split_regex(t, '(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
    when 1 then string_split_regex(t, 'AKIA[A-Z0-9]+') when 2 then string_split_regex(t, '[0-9a-f]{24,}') else string_split_regex(t, '[A-Za-z0-9+/_=-]{20,}') end as gaps
  from d, pats
), m as (
  select rk, kind, unnest(found) as s, unnest(gaps[:len(found)]) as gap, unnest(coalesce(vals, found)) as val, unnest(range(0, len(found))) as i from f
), e as (
  select rk, kind, s, val, sum(length(gap) + length(s)) over (partition by rk, kind order by i) as stop from m
), spans as (
  select rk, kind, s, cast(stop - length(s) as bigint) as start, cast(stop as bigint) as stop from e
  where (kind = 0 and length(val) >= 6) or (kind = 1 and length(s) >= 20) or kind >= 2
), runs as (
  select rk, start, stop, s from spans c where kind = 3 and not exists (select 1 from spans b where b.rk = c.rk and b.kind < 3 and b.start < c.stop and c.start < b.stop)
), marked as (
  select rk, start, stop, chr(1) || regexp_replace(regexp_replace(s, '[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}', ' ', 'g'), '([/_=-])', chr(1) || '\1' || chr(1), 'g') || chr(1) as s from runs
), rest as (
  select rk, start, stop, replace(regexp_replace(s, '\x01(?:[A-Z]?[a-z]{1,19}|[A-Z]{1,19}|[0-9]+|[A-Za-z0-9+]*(?i:example|sample|dummy|placeholder|changeme)[A-Za-z0-9+]*)\x01', ' ', 'g'), chr(1), '') as s from marked
), pieces as (
  select rk, start, stop, regexp_replace(unnest(string_split(s, ' ')), '^[/_=-]+|[/_=-]+$', '', 'g') as p from rest
), windows as (
  select rk, start, stop, substr(p, unnest(range(1, length(p) - 18)), 20) as w from pieces where length(p) >= 20
), each_window as (
  select row_number() over () as id, * from (select distinct * from windows)
), counts as (
  select id, ch, count(*) as c from (select id, unnest(string_split(w, '')) as ch from each_window) group by id, ch
), bits as (
  select id, log2(20) - sum(c * log2(c)) / 20 as bits from counts group by id
), odd as (
  select distinct rk, 3 as kind, start, stop from each_window join bits using (id) where bits >= case
    when regexp_matches(w, '^[0-9+/_=-]+$') then 99 when regexp_matches(w, '^([0-9a-f]+|[0-9A-F]+)$') then 3.0 when regexp_matches(w, '^([a-z+/_=-]+|[A-Z+/_=-]+)$') then 4.2
    when regexp_matches(w, '^[A-Za-z+/_=-]+$') then 3.95 when regexp_matches(w, '^([a-z0-9+/_=-]+|[A-Z0-9+/_=-]+)$') then 3.7 else 3.8 end
), every as (
  select rk, kind, start, stop, (['assign', 'access', 'hex', 'entropy'])[kind + 1] || ':' || start || ':' || stop as name from (select rk, kind, start, stop from spans where kind < 3 union all select * from odd)
), s as (
  select rk, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as k, count(*) filter (kind = 2) as h, count(*) filter (kind = 3) as o,
    string_agg(name, ',' order by start, kind) filter (kind < 3) as base, string_agg(name, ',' order by start, kind) as spans from every group by rk
)
select doc_id, coalesce(a, 0) as n_assign, coalesce(k, 0) as n_access, coalesce(h, 0) as n_hex, coalesce(o, 0) as n_entropy, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join s using (rk)
"""

_TABLE = "(select i, i as c from range(256) r(i))"
for _ in range(8):
    _TABLE = f"(select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from {_TABLE})"
#: The table of the checksum, one row; and the checksum of a text by it.
_CRC = f"crc as (select list(c order by i) as tbl from {_TABLE})"


def _crc32(text: str) -> str:
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x : cast(('0x' || x) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, x : xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295)"


def _feistel(seed: int = 11) -> str:
    """One pass of the network as a chain of selects over ``n, a, b, x``; its keys are those of a multiplicative generator."""
    prime, state, q = 2147483647, seed * 2 + 1, "(select number, n, a, b, x % a as l, x // a as r from w where not x < n or step = 0)"
    for j in range(6):
        keys = []
        for _ in range(3):
            state = state * 48271 % prime
            keys.append(state)
        m = "a" if j % 2 == 0 else "b"
        t = f"((((r + {keys[0]}) % {prime}) * ((r + {keys[0]}) % {prime}) % {prime}) * {keys[1] % 65536} + {keys[2]}) % {prime}"
        q = f"(select number, n, a, b, r as l, (l + {t}) % {m} as r from {q})"
    return q


#: Numbers by checksum, then the network again and again until a number lies inside.
SHARDING = f"""
with recursive {_CRC}, d as (
  select doc_id, strlen(coalesce(text, '')) + 8 as size, {_crc32("coalesce(text, '')")} as text_crc32 from documents, crc
), n as (
  select count(*) as n, greatest(12, (count(*) + 199999) // 200000) as buckets from d
), h as (
  select doc_id, size, text_crc32, {_crc32("concat_ws(':', coalesce(cast(doc_id as varchar), ''), text_crc32, size)")} % buckets as bucket from d, n, crc
), r as (
  select doc_id, size, text_crc32, row_number() over (order by bucket, doc_id nulls last, text_crc32, size) - 1 as number from h
), s as (
  select n, a, (n + a - 1) // a as b from (select n, greatest(1, cast(floor(sqrt(n - 1)) as bigint) + 1) as a from n)
), w as (
  select number, n, a, b, number as x, 0 as step from r, s
  union all
  select number, n, a, b, l + (case when 6 % 2 = 0 then a else b end) * r as x, 1 as step from {_feistel()}
)
select doc_id, size, text_crc32, 'rows' as law, cast(x % 24 as integer) as shard, x // 24 as slot, cast(null as integer) as grown_shard, r.number
from r join w on w.number = r.number where step = 1 and x < n
"""

_QUALITY = """greatest(greatest(0.05::double, 1.0::double / (1.0::double + 20.0::double * (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g'))) / greatest(length(t), 1))), 1e-6::double)"""

#: Every source's documents in order of their keys, cut where the running size is nearest to what complete epochs leave.
MIXING = f"""
with {_CRC}, d as (
  select row_number() over () as rk, doc_id, source, coalesce(text, '') as t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size from documents
), k as (
  select rk, doc_id, source, size,
    -ln((cast(('0x' || substr(md5(concat_ws(':', '17', coalesce(cast(doc_id as varchar), ''), {_crc32("t")})), 1, 13)) as bigint)::double + 0.5::double) / 4503599627370496.0::double) / {_QUALITY} as key from d, crc
), z as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from k group by source
), c as (
  select *, (3 * source_size)::double as cap, ([5.0, 2.0, 1.0])[(place - 1) % 3 + 1]::double as weight from z
), o as (
  select *, cap / weight as bound, sum(source_size) over ()::double as total, sum(weight) over () as weights from c
), l as (
  select *, (total - coalesce(sum(cap) over f, 0)) / (weights - coalesce(sum(weight) over f, 0)) as level from o
  window f as (order by bound, source nulls last rows between unbounded preceding and 1 preceding)
), g as (
  select *, first(case when level <= bound then level end order by case when level <= bound then bound end nulls last, level) over () as final from l
), p as (
  select source, source_size, case when final is null then cap else least(cap, final * weight) end as target from g
), e as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from p
), q as (
  select *, case when epochs >= 3 then 0 else target - epochs * source_size end as rest from e
), r as (
  select k.rk, k.doc_id, k.size, q.source_size, q.target, q.epochs, q.rest, sum(k.size) over (partition by k.source order by key, k.doc_id nulls last, k.rk) as stop
  from k join q on k.source is not distinct from q.source
)
select doc_id, size, source_size, target,
  cast(size * (epochs + case when stop <= rest or (stop - size < rest and stop - rest < rest - (stop - size)) then 1 else 0 end) as bigint) as taken
from r
"""

ORACLES: dict[str, str] = {
    "op2_jaccard_join": JACCARD_JOIN,
    "op3_sharding": SHARDING,
    "op4_line_dedup": LINE_DEDUP,
    "op5_mixing": MIXING,
    "op6_secret_scan": SECRET_SCAN,
    "op8_decontamination": DECONTAMINATION,
}
