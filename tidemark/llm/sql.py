"""SQL (DuckDB) that gives the rows of queries, over whole tables."""

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = r"regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
with items as (select item_id, {_WORDS} as w from benchmark),
windows as (
  select distinct item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as words, least(10, len(w)) as n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from items where len(w) > 0)
),
docs as (select row_number() over () as row, doc_id, {_WORDS} as w from documents),
sizes as (select distinct n from windows),
places as (
  select row, i, n, array_to_string(w[i:i + n - 1], ' ') as words
  from (select row, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n)
),
hits as (select p.row, p.i, p.n, item_id from places p join windows using (words, n)),
covered as (
  select row, count(distinct place) as n_hit
  from (select row, unnest(range(i, i + n)) as place from (select distinct row, i, n from hits)) group by row
),
named as (
  select row, count(*) as n_items, string_agg(item, ',' order by item collate "C") as items
  from (select distinct row, item_id::varchar as item from hits where item_id is not null) group by row
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (row) left join named using (row)
"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: int, pattern: str, group: int, least: int, more: str = "true") -> str:
    return f"""
  select row, source, doc_id, {kind} as kind, start, start + length(whole) as "end", value from (
    select row, source, doc_id, whole[i] as whole, value[i] as value,
      list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) as start
    from (
      select *, unnest(range(1, len(whole) + 1)) as i from (
        select row, source, doc_id, string_split_regex(text, '{pattern}') as pieces, regexp_extract_all(text, '{pattern}') as whole,
          regexp_extract_all(text, '{pattern}', {group}) as value
        from docs where regexp_matches(text, '{pattern}')))
  ) where length(value) >= {least} and {more}"""


SECRETS = f"""
with docs as (select row_number() over () as row, doc_id, source, coalesce(text, '') as text from documents),
base as ({_matches(0, _ASSIGN, 2, 6)} union all {_matches(1, 'AKIA[A-Z0-9]+', 0, 20)} union all {_matches(2, '[0-9a-f]{24,}', 0, 24)}),
runs as ({_matches(3, '[A-Za-z0-9+/_=-]{20,}', 0, 20, "regexp_matches(value, '[A-Z]') and regexp_matches(value, '[a-z]') and regexp_matches(value, '[0-9]')")}),
found as (
  select * from base union all
  select * from runs r where not exists (select 1 from base b where b.row = r.row and b.start < r."end" and r.start < b."end")
),
owners as (select value, count(distinct coalesce(source, chr(1))) as n_owners from found group by value),
shown as (
  select f.*, n_owners < 3 as live, (['assign', 'access', 'hex', 'owner'])[kind + 1] || ':' || start::bigint || ':' || "end"::bigint as span
  from found f join owners using (value) where kind < 3 or n_owners < 3
),
told as (
  select row, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as c, count(*) filter (kind = 2) as h,
    string_agg(span, ',' order by start, kind) filter (kind < 3) as base, string_agg(span, ',' order by start, kind) as spans,
    count(*) filter (live) as n_live, count(*) filter (not live) as n_examples
  from shown group by row
)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(c, 0)::bigint as n_access, coalesce(h, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0)::bigint as n_live, coalesce(n_examples, 0)::bigint as n_examples
from docs left join told using (row)
"""

URL_RULES = f"""
with rules(rhost, rpath, verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut as (
  select row_number() over () as row, page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
places as (
  select row, page_id, {LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
best as (
  select row, rhost || rpath as rule, verdict,
    row_number() over (partition by row order by length(rhost) + length(rpath) desc, length(rhost) desc, rhost || rpath desc) as place
  from places join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from places left join (select * from best where place = 1) using (row)
"""


def _escaped(text: str, role: bool = False) -> str:
    out = rf"replace(replace(replace(replace({text}, '\', '\\'), '###', '\h\h\h'), '</turn>', '\l/turn>'), '<part>', '\lpart>')"
    return rf"replace({out}, ':', '\c')" if role else out


CHAT_FORMAT = rf"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
placed as (
  select *, row_number() over w as place, coalesce(role <> lag(role) over w, true) as starts from rows
  window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length({_escaped('text')}) + case when starts then length({_escaped('role', True)}) + 14 else 6 end)::bigint as formatted_chars
from placed group by conv_id
"""

_TERMS = "regexp_extract_all(lower({0}), '[a-z0-9]+(?:[.-][a-z0-9]+)*')"

LICENCES = f"""
with templates(k, licence, words) as (
  select k, licence, {_TERMS.format("words")} from (values
    (1, 'Apache-2.0', 'Licensed under the Apache License, Version 2.0.'),
    (2, 'BSD-3-Clause', 'Redistribution and use in source and binary forms, with or without modification, are permitted.'),
    (3, 'CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
    (4, 'GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'),
    (5, 'GPL-3.0', 'This program is free software: you can redistribute it under the terms of the GNU General Public License.'),
    (6, 'MIT', 'Released under the MIT License.'),
    (7, 'MIT', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software.'),
    (8, 'MPL-2.0', 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.')) v(k, licence, words)),
docs as (
  select row_number() over () as row, doc_id, coalesce(text, '') as text,
    case when doc_id % 1000 = 0 then [source, (doc_id // 1000)::varchar, 'LICENSE']
      when doc_id % 100 = 0 then [source, (doc_id // 1000)::varchar, (doc_id // 100)::varchar, 'LICENSE']
      when doc_id % 10 = 0 then [source, (doc_id // 1000)::varchar, (doc_id // 100)::varchar, (doc_id // 10)::varchar, 'LICENSE']
      else [source, (doc_id // 1000)::varchar, (doc_id // 100)::varchar, (doc_id // 10)::varchar, doc_id::varchar] end as parts
  from documents),
number as (select count(*) as n from docs),
frequent as (select term, count(distinct row) as df from (select row, unnest({_TERMS.format("text")}) as term from docs) group by term),
weight as (
  select distinct term, ln((1 + n) / (1 + coalesce(df, 0))) as w
  from (select distinct unnest(words) as term from templates) left join frequent using (term), number),
t as (select k, licence, term, count(*) * any_value(w) as w from (select k, licence, unnest(words) as term from templates) join weight using (term) group by all),
t_size as (select k, sqrt(sum(w * w)) as size from t group by k),
lines as (select row, line, unnest({_TERMS.format("words")}) as term from (
  select row, unnest(range(len(l))) as line, unnest(l) as words from (select row, string_split(text, chr(10)) as l from docs))),
vectors as (select row, line, term, count(*) * coalesce(any_value(w), any_value(ln(1 + n))) as w from lines left join weight using (term), number group by row, line, term),
v_size as (select row, line, sqrt(sum(w * w)) as size from vectors group by row, line),
dots as (select v.row, v.line, t.k, t.licence, sum(v.w * t.w) as dot from vectors v join t using (term) group by all),
scores as (select row, licence, round(dot / (v_size.size * t_size.size), 9) as cosine from dots join v_size using (row, line) join t_size using (k) where v_size.size > 0 and t_size.size > 0),
own as (select row, licence, cosine from (select *, row_number() over (partition by row order by cosine desc, licence) as place from scores where cosine >= 0.8) where place = 1),
files as (
  select dir, licence from (
    select array_to_string(parts[1:-2], '/') as dir, licence, row_number() over (partition by array_to_string(parts[1:-2], '/') order by cosine desc, licence) as place
    from docs join own using (row) where parts[-1] = 'LICENSE') where place = 1),
above as (select row, depth, array_to_string(parts[1:depth], '/') as dir from (select row, parts, unnest(range(0, len(parts))) as depth from docs where row not in (select row from own))),
nearest as (select row, dir, licence from (select row, dir, licence, row_number() over (partition by row order by depth desc) as place from above join files using (dir)) where place = 1)
select doc_id, array_to_string(parts, '/') as path, own.licence as own, coalesce(own.licence, nearest.licence) as licence, nearest.dir as from_dir
from docs left join own using (row) left join nearest using (row)
"""


#: Shares of kept terms of every source, densely.
DIVERGENCE = r"""
with d as materialized (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents),
w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as materialized (select lang, source, term, count(*) as n, count(distinct r) as docs from w group by all),
k as materialized (select lang, term, sum(n)::bigint as n from c group by all having sum(docs) >= 30),
v as (select lang, count(*) as v, sum(n)::bigint as n from k group by lang),
g as materialized (
  select lang, source, coalesce(any_value(v.v), 0) as v, coalesce(sum(c.n) filter (where k.term is not null), 0)::bigint as n
  from (select distinct lang, source from d) left join v using (lang)
  left join c using (lang, source) left join k using (lang, term) group by all),
p as materialized (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) as p,
    1 + (1000000000::hugeint * (k.n + 5)) // (v.n + 5 * v.v) as q
  from g join k using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
s as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as f from p a join p b using (lang, term) where a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.f, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from p where n > 0 and p > q)
select lang, source, part, item, value, rank::int as rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from terms))
where part = 'pair' or rank <= 50
"""


#: CRC-32 by its table of bytes; words one edit apart by the word with a letter left out or masked.
VARIANTS = r"""
with recursive bits(i, k, c) as (
  select i, 0, i from range(256) r(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end from bits where k < 8),
crc as materialized (select list(c order by i) as t from bits where k = 8),
runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents),
long as materialized (select id, run, count(*) as n from runs where length(run) >= 6 group by all),
signs as (
  select id, run, n, flatten([case when unicode(x) < 128 then [unicode(x)::bigint] else [195, unicode(x)::bigint - 64] end
    for x in string_split(id || ':' || run, '')]) as bytes from long),
marked as materialized (
  select run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, bytes),
    lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]))) as h from signs, crc),
given as (
  select case when h % 199 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, n from marked),
words as materialized (select word, sum(n)::bigint as n from given where length(word) >= 6 group by 1 having sum(n) >= 5),
cuts as materialized (
  select word, n, word[:i] as head, word[i + 2:] as tail from (select word, n, unnest(range(length(word))) as i from words)),
near as materialized (
  select a.word, b.word as other, b.n from cuts a join cuts b on a.head = b.head and a.tail = b.tail and length(a.head) = length(b.head) and a.word <> b.word
  union select c.word, w.word, w.n from cuts c join words w on w.word = c.head || c.tail
  union select w.word, c.word, c.n from cuts c join words w on w.word = c.head || c.tail),
best as (select word, count(*) as n_near, arg_min(other, struct_pack(less := -n, other := other)) as other, max(n) as most from near group by 1),
formed as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when most >= 5 * w.n then other end as form, case when most >= 5 * w.n then most end as form_n
  from words w left join best using (word)),
ends(word, top) as (
  select word, word from formed
  union all select e.word, f.form from ends e join formed f on f.word = e.top where f.form is not null),
last as (select e.word, e.top as root from ends e join formed f on f.word = e.top where f.form is null)
select word, form, root, n, n_near::bigint as n_near, form_n::bigint as form_n from formed join last using (word)
"""


#: Pairs by common shingles; components by spreading the smallest id.
JACCARD = r"""
with recursive d as materialized (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (
  select distinct r, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') as g
  from (select r, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0)),
sets as materialized (select r, count(*) as n, md5(string_agg(g, chr(10) order by g)) as h from s group by r),
one as materialized (select h, min(r) as r, any_value(n) as n from sets group by h),
u as materialized (select s.r, s.g, n from s join one using (r)),
pairs as (
  select a.r as a, b.r as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as c from u a join u b on a.g = b.g and a.r < b.r
    and 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) group by 1, 2),
links as materialized (select a, b from pairs where 100 * c >= 90 * (n + m - c)),
both_ways as materialized (select a, b from links union select b, a from links),
reach(r, other) as (select r, r from one union select e.r, l.b from reach e join both_ways l on l.a = e.other),
ids as (select one.r, min(d.doc_id) as id from one join sets using (h) join d on d.r = sets.r group by 1),
comp as (select e.r, min(ids.id) as id from reach e join ids on ids.r = e.other group by 1)
select d.doc_id, coalesce(sets.n, 0)::bigint as n_shingles, coalesce(comp.id, d.doc_id) as component_id
from d left join sets on sets.r = d.r left join one using (h) left join comp on comp.r = one.r
"""
