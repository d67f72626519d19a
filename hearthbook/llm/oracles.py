"""SQL for the numbered queries whose results SQL can give: an independent, brute-force form of each contract."""

from __future__ import annotations

UPPER, LOWER, BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"


def _reach(links: str) -> str:
    """Body of a recursive expression that gives (id, root) for links (a, b): every node with each node it reaches."""
    return f"select a as id, b as root from {links} union select b, a from {links} union select r.id, e.root from reach r join (select a, b as root from {links} union all select b, a from {links}) e on e.a = r.root"


NEAR_DEDUP = f"""
with recursive worded as (select doc_id, {WORDS.format(text=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} as w from documents),
shingled as (select doc_id, unnest(list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from worded),
sized as (select doc_id, count(*) as n from shingled group by 1),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as c from shingled x join shingled y on y.s = x.s and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from shared join sized p on p.doc_id = a join sized q on q.doc_id = b where 100 * c >= 85 * (p.n + q.n - c)),
reach as ({_reach("links")}),
lowest as (select id, min(root) as root from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(root, d.doc_id)) as kept
from documents d left join sized on sized.doc_id = d.doc_id left join lowest on lowest.id = d.doc_id"""

MIXING = f"""
with sized as (select doc_id, source, coalesce(len({WORDS.format(text="text")}), 0) as size, md5(coalesce(cast(doc_id as varchar), '')) as h from documents),
sources as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, source) as rank from sized group by 1),
weighed as (select *, case (rank - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 2e0 * source_size as cap, 15e-1 * sum(source_size) over () as budget from sources),
levels as (select *, cap / weight as fill, (budget - 2e0 * coalesce(sum(source_size) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as level from weighed),
goals as (select source, source_size, coalesce(least(cap, (select level from levels where fill > level order by fill, rank limit 1) * weight), cap) as target from levels),
placed as (select *, coalesce(sum(size) over (partition by source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from sized)
select doc_id, size, source_size, target, cast(greatest(0, least(size, floor(target) - before)) + greatest(0, least(size, floor(target) - source_size - before)) as bigint) as taken
from placed p join goals g on g.source is not distinct from p.source"""

_LETTERS = " || ".join(f"substr('{BASE32}', cast(((cast('0x' || substr(sha, {5 * k + 1}, 5) as bigint) >> {s}) & 31) + 1 as int), 1)" for k in range(8) for s in (15, 10, 5, 0))
REVISITS = f"""
with hashed as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as sha, max(page_id) over (partition by coalesce(html, '')) as last from pages)
select page_id, payload_bytes, {_LETTERS} as payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to from hashed"""


def _host(url: str) -> str:
    return f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"


def _path(url: str) -> str:
    return f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _node(url: str) -> str:
    path = _path(url)
    return f"case when contains({url}, '://') then {_host(url)} || case when {path} = '' then '/' else {path} end || regexp_extract({url}, '(?s)^[^?#]*(\\?[^#]*)', 1) end"


def _absolute(base: str, link: str) -> str:
    root = f"regexp_extract({base}, '(?s)^(.*?://)', 1) || {_host(base)}"
    return f"""case when regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*://') then {link} when starts_with({link}, '//') then 'http:' || {link} when starts_with({link}, '/') then {root} || {link}
      when regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') then null when starts_with({link}, '?') then {root} || '/' || ltrim({_path(base)}, '/') || {link} when starts_with({link}, '#') then {base} else {root} || regexp_replace('/' || ltrim({_path(base)}, '/'), '[^/]*$', '') || {link} end"""


def _steps(url: str) -> str:
    """The url without steps . and .. in its path."""
    parts = f"string_split({_path(url)}, '/')"
    walked = f"list_reduce(list_prepend(cast([] as varchar[]), list_transform({parts}, lambda p: [p])), lambda held, p: case p[1] when '.' then held when '..' then case when len(held) > 1 then held[:len(held) - 1] else held end else held || p end)"
    return f"""case when regexp_matches({_path(url)}, '(^|/)\\.\\.?(/|$)') then regexp_extract({url}, '(?s)^(.*?://[^/?#]*)', 1) || array_to_string({walked}, '/') || case when {parts}[-1] in ('.', '..') then '/' else '' end || regexp_extract({url}, '(?s)^[^?#]*(.*)$', 1) else {url} end"""


def url_filter(rules: list[tuple[str, str, str]]) -> str:
    """The verdicts of url rules with propagation over the pages' canonical links and refreshes."""
    table = " union all ".join(f"select '{v}' as verdict, '{h}' as rule_host, '{p}' as rule_path" for v, h, p in rules)
    best = "select {key}, arg_max({{'verdict': r.verdict, 'rule': rule_host || rule_path}}, (length(rule_host || rule_path), r.verdict = 'allow', rule_host || rule_path)) as own from {rows} t join rules r on (t.host = rule_host or ends_with(t.host, '.' || rule_host)) and starts_with(t.path, rule_path) group by 1"
    value = "\\s*=\\s*[\"'']?([^\"''>\\s]+)"
    return f"""
with recursive rules as ({table}),
rows as (select page_id, coalesce({_host("url")}, '') as host, coalesce({_path("url")}, '') as path, {_node("url")} as at from pages),
tags as (select url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>', '', 'g'), '(?is)<(?:link|meta)\\b[^>]*>')) as tag from pages),
found as (select url, case when regexp_matches(tag, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b') then regexp_extract(tag, '(?is)\\bhref{value}', 1)
  when regexp_matches(tag, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b') then regexp_extract(tag, '(?is)\\burl\\s*=\\s*''?([^"''>\\s]+)', 1) end as target from tags),
joined as (select url, {_absolute("url", "replace(target, '&amp;', '&')")} as link from found where target <> ''),
whole as (select url, {_steps("link")} as link from joined),
links as (select a, b from (select {_node("url")} as a, {_node("link")} as b from whole) x where a is not null and b is not null and a <> b),
reach as ({_reach("links")}),
roots as (select id, least(id, min(root)) as root from reach group by 1),
places as (select id, root, split_part(id, '/', 1) as host, regexp_extract(id, '(?s)^[^/]*(/[^?]*)', 1) as path from roots),
seeds as ({best.format(key="t.id", rows="places")}),
states as (select root, max(case own.verdict when 'allow' then 2 when 'block' then 1 else 0 end) as state from roots left join seeds on seeds.id = roots.id group by 1),
judged as ({best.format(key="t.page_id", rows="rows")})
select rows.page_id, host, path, own.rule as rule, coalesce(own.verdict, case when state = 1 then 'block' else 'allow' end) as verdict, roots.root as component
from rows left join judged on judged.page_id = rows.page_id left join roots on roots.id = rows.at left join states on states.root = roots.root"""

#: CRC-32 of a text of ASCII characters, by the table of its polynomial.
_CRC_STEPS = "list_reduce(list_prepend(x, range(8)), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
_CRC_TABLE = f"crc_table as (select list_transform(range(256), lambda x: {_CRC_STEPS}) as steps)"


def _crc32(text: str) -> str:
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split({text}, ''), lambda b: cast(ord(b) as bigint))), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


_PRINTED = lambda c: f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || {c} end"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_PRINTED(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree(name: str, leaves: str) -> str:
    """Recursive expression over (key, n, idx, h, level): every node of every key's tree."""
    return f"{name} as (select key, n, idx, h, 0 as level from {leaves} union all select key, (n + 1) // 2, idx // 2, sha256(string_agg(h, '' order by idx)), level + 1 from {name} where n > 1 group by key, n, idx // 2, level)"


MERKLE = f"""
with recursive {_CRC_TABLE},
leaves as (select doc_id, coalesce('1' || lang, '0') as key, {_leaf("n_chars")} as h, case when {_crc32("cast(doc_id as varchar)")} % 7 = 0 then {_leaf("cast(n_chars as hugeint) + 1")} else {_leaf("n_chars")} end as shown from documents, crc_table),
placed as (select *, row_number() over (partition by key order by doc_id, h) - 1 as idx, count(*) over (partition by key) as n from leaves),
{_tree("nodes", "placed")},
tops as (select '' as key, key as of, h, row_number() over (order by key) - 1 as idx, count(*) over () as n from nodes where n = 1),
{_tree("upper", "tops")},
folds as (
  select p.doc_id, p.h as leaf, p.key, p.idx, p.shown as acc, 0 as level, 0 as tree, p.n as n, cast([] as varchar[]) as proof, cast(null as varchar) as subroot from placed p
  union all
  select f.doc_id, f.leaf, case when f.n > 1 then f.key else '' end, case when f.n > 1 then f.idx // 2 else t.idx end,
    case when f.n = 1 then f.acc when f.idx % 2 = 1 then sha256(s.h || f.acc) else sha256(f.acc || coalesce(s.h, '')) end,
    case when f.n > 1 then f.level + 1 else 0 end, case when f.n > 1 then f.tree else 1 end, case when f.n > 1 then (f.n + 1) // 2 else t.n end,
    case when s.h is null then f.proof else list_append(f.proof, s.h) end, coalesce(f.subroot, t.h)
  from folds f
  left join (select *, 0 as tree from nodes union all select *, 1 from upper) s on f.n > 1 and s.tree = f.tree and s.key = f.key and s.level = f.level and s.idx = xor(f.idx, 1)
  left join tops t on f.n = 1 and t.of = f.key
  where f.n > 1 or f.tree = 0)
select doc_id, leaf, subroot, root, sha256(array_to_string(proof, '')) as proof_sha256, acc as folded_root, acc = root as verified
from folds, (select h as root from upper where n = 1) r where tree = 1 and n = 1"""

_TRIMMED = "regexp_extract(text, '(?s)^(.*[^\\x20\\x09-\\x0D])', 1)"
REPAIR = f"""
with recursive {_CRC_TABLE},
rolled as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as kind from conversations, crc_table),
damaged as (select coalesce(cast(conv_id as varchar), '') as conv, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when kind = 3 then [1, 2] else [1] end) as again from rolled where kind <> 0),
tied as (select *, md5(strlen(role) || ':' || role || text) as tie from damaged),
ordered as (select *, row_number() over (partition by conv order by turn nulls first, tie) as k from tied),
lined as (select *, row_number() over (partition by conv, role, text order by k) as sight, {_TRIMMED} as body from ordered),
rows as (select conv, turn, role, text, k, left(role, 1) as initial, case when body = '' then 'blank' when sight > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from lined),
counted as (select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) as n from rows group by 1),
pairs as (select conv, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from (select conv, initial, lag(initial) over (partition by conv order by k) as before from rows) p group by 1),
inserts as (select * from (values (0, 0, '', ''), (0, 2, 'I', '\nuser:'), (0, 3, 'II', '\nuser:\nassistant:'), (1, 1, '', ''), (1, 2, 'I', '\nuser:'), (1, 3, 'II', '\nuser:\nassistant:'), (2, 2, '', ''), (2, 3, 'I', '\nassistant:'), (3, 3, '', ''), (3, 2, 'I', '\nuser:')) v(s, t, letters, added)),
moves as (select * from (values (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')) v(s, t, to_role)),
steps as (
  select r.conv, r.k, s, s as t, 2 as price, 'D' as letter, '' as added from rows r, (values (0), (1), (2), (3)) v(s)
  union all select r.conv, r.k, m.s, m.t, case when left(to_role, 1) = initial then 0 else 1 end + case fault when 'truncated' then 5 else 0 end, case when left(to_role, 1) = initial then 'K' else 'R' end, '\n' || case when left(to_role, 1) = initial then role else to_role end || ':' || text from rows r, moves m where fault in ('', 'truncated')
  union all select conv, k, 0, 1, case fault when 'truncated' then 5 else 0 end, 'K', '\n' || role || ':' || text from rows where initial = 's' and fault in ('', 'truncated')),
ways as (
  select conv, 0 as k, 0 as state, cast(0 as bigint) as cost, '' as audit, '' as built, n from counted
  union all
  select conv, k, state, min(cost), arg_min(audit, {{'c': cost, 'a': audit}}), arg_min(built, {{'c': cost, 'a': audit}}), n from (
    select w.conv, w.k + 1 as k, p.t as state, w.cost + 5 * length(i.letters) + p.price as cost, w.audit || i.letters || p.letter as audit, w.built || i.added || p.added as built, w.n
    from ways w join inserts i on i.s = w.state join steps p on p.conv = w.conv and p.k = w.k + 1 and p.s = i.t) x group by conv, k, state, n),
ends as (select w.conv, min(cost + 5 * length(letters)) as cost, arg_min({{'a': audit || letters, 'b': built || added}}, {{'c': cost + 5 * length(letters), 'a': audit || letters}}) as best from ways w join inserts i on i.s = w.state where w.k = w.n and i.t in (0, 3) group by 1)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(best.a, '') as audit, sha256(substr(coalesce(best.b, ''), 2)) as repaired_sha256
from (select distinct conv_id from conversations) o left join counted c on c.conv = coalesce(cast(o.conv_id as varchar), '') left join pairs p on p.conv = c.conv left join ends e on e.conv = c.conv"""
