"""SQL for the queries that SQL can express; the others are tested by brute force."""

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format

SECRETS = r"""with r(kind, o, rx, least) as (values
 ('assign', 0, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', 0), ('access', 1, 'AKIA[A-Z0-9]{16,}', 20), ('hex', 2, '[0-9a-f]{24,}', 24),
 ('github', 3, 'gh(?:p|o|u|s|r)_[A-Za-z0-9]+', 40), ('pem', 4, '-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----(?:(?:[^-]|-[^-])*-----END\x20[A-Z\x20]*PRIVATE\x20KEY-----|(?:\r?\n[A-Za-z0-9+/=]{16,})*)', 0),
 ('github_pat', 5, 'github_pat_[A-Za-z0-9_]+', 40), ('slack', 6, 'xox(?:a|b|p|o|r|s)-[A-Za-z0-9-]+', 20), ('google', 7, 'AIza[A-Za-z0-9_-]+', 39), ('stripe', 8, '(?:s|r)k_(?:live|test)_[A-Za-z0-9]+', 24), ('jwt', 9, 'eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', 0)),
m as (select doc_id, kind, o, least, string_split_regex(text, rx) p, regexp_extract_all(text, rx) x from documents, r where regexp_matches(text, rx)),
s as (select doc_id, kind, o, least, x[i] as hit, cast(list_sum(list_transform(p[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(x[1:i-1], lambda z: length(z))), 0) as bigint) as a from (select *, unnest(range(1, len(x) + 1)) i from m)),
v as (select * from s where case when kind = 'assign' then length(regexp_extract(hit, '(?i)^(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?(.*)$', 1)) >= 6 else length(hit) >= least end),
f as (select doc_id, kind, o, a, kind || ':' || a || ':' || (a + length(hit)) as span from v)
select d.doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
 sha256(coalesce(string_agg(span, ',' order by a, o) filter (o < 3), '')) base_sha256, coalesce(string_agg(span, ',' order by a, o), '') spans, count(span) n_spans
from documents d left join f using (doc_id) group by d.doc_id"""

PAGES = r"""with b as (select page_id, url, string_split_regex(replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<br>', ' '), '</?(?:p|h1|h2|h3|li|ul)>') l from pages),
t as (select page_id, url, list_filter(list_transform(l, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') l from b)
select page_id, url, array_to_string(l, chr(10)) as text, length(array_to_string(l, chr(10))) n_chars, len(l) n_blocks from t"""

_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format

CONTAMINATION = f"""with i as (select item_id, {_WORDS(_LOW('text'))} w from benchmark where text is not null), iw as (select row_number() over () r, item_id, w, least(13, len(w)) n from i where len(w) > 0),
iwin as (select r, item_id, n, p as ip, array_to_string(w[p:p + n - 1], ' ') g from (select *, unnest(range(1, len(w) - n + 2)) p from iw)),
d as (select row_number() over () k, doc_id, {_WORDS(_LOW("coalesce(text, '')"))} w from documents),
dw as (select k, p, n, array_to_string(w[p:p + n - 1], ' ') g from (select k, w, n, unnest(range(1, len(w) - n + 2)) p from d, (select distinct n from iw))),
h as (select k, p, n, r, item_id, ip from dw join iwin using (n, g)),
c as (select k, count(distinct q) n_hit from (select k, unnest(range(p, p + n)) q from (select distinct k, p, n from h)) group by k),
it as (select k, count(*) n_items, string_agg(name, ',' order by name) names from (select distinct k, cast(item_id as varchar) as name from h) group by k),
run as (select k, n, p, p - row_number() over (partition by k, r, p - ip order by p) as island, r, p - ip as diag from h),
m as (select k, min(p) a, max(p) + max(n) - min(p) as words from run group by k, r, diag, island),
best as (select k, max(words) longest_match from m group by k)
select d.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(names, '')) items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) contaminated,
 coalesce(longest_match, 0) longest_match, (select min(a) - 1 from m where m.k = d.k and m.words = best.longest_match) longest_start
from d left join c using (k) left join it using (k) left join best using (k)"""

NEAR = rf"""with recursive w as (select doc_id, regexp_extract_all({_LOW("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') w from documents),
g as (select distinct doc_id, md5(array_to_string(w[p:p + 4], ' ')) g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) p from w where len(w) > 0)),
n as (select doc_id, count(*) n from g group by doc_id),
o as (select a.doc_id x, b.doc_id y, count(*) c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from o join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as x, doc_id as y from documents union select r.x, e.y from r join e on r.y = e.x),
k as (select x as doc_id, min(y) component_id from r group by x)
select k.doc_id, coalesce(n, 0) n_shingles, component_id, k.doc_id = component_id as kept from k left join n using (doc_id)"""


_TERMS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format

RANKED = f"""with d as (select row_number() over () k, doc_id, {_TERMS(_LOW('text'))} w from documents where text is not null), dn as (select k, doc_id, len(w) n from d where len(w) > 0),
c as (select count(*) as docs, sum(n)::bigint as words from dn), t as (select k, term, count(*) tf from (select k, unnest(w) term from d) group by all), f as (select term, count(*) df from t group by term),
i as (select row_number() over () r, item_id, list_distinct({_TERMS(_LOW('text'))}) w from benchmark where text is not null), q as (select r, item_id, unnest(w) term from i),
g as (select r, item_id, term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) w from q join f using (term), c),
m as (select k, doc_id, 100 - 90 + ((90 * n * docs) // words) m from dn, c),
s as (select r, item_id, k, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) score from g join t using (term) join m using (k) group by all)
select item_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by r order by score desc, doc_id) rank from s where score > 0) where rank <= 10"""

# A field: its bytes and value, or "-"; crc32: a byte at a time, eight shifts each.
_FIELD = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')".format
_LEAF = " || ".join(_FIELD(f) for f in ("doc_id", "source", "lang", "{n}", "text")).format
_CRC = "4294967295 - list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint), lambda a, c: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::bigint[], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(a, c)), 4294967295::bigint)"


def _tree(name: str, source: str) -> str:
    """Nodes of binary trees: tree, level, idx, n (nodes of the level), hash, from (tree, idx, n, hash)."""
    return f"""{name} as (select tree, 0 as level, idx, n, hash from {source} union all
 select tree, level + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(hash, '' order by idx)) from {name} where n > 1 group by tree, level, idx // 2)"""


def _sides(name: str, nodes: str) -> str:
    """Each node with what its parent covers left and right of it."""
    return f"""{name} as (select a.tree, a.level, a.idx, coalesce(case when b.idx < a.idx then b.hash end, '') l, coalesce(case when b.idx > a.idx then b.hash end, '') r
 from {nodes} a left join {nodes} b on a.tree is not distinct from b.tree and a.level = b.level and b.idx = xor(a.idx, 1) where a.n > 1)"""


MERKLE = f"""with recursive z as (select doc_id, lang as tree, sha256({_LEAF(n='n_chars')}) hash, sha256({_LEAF(n=f'(n_chars + case when ({_CRC}) % 7 = 0 then 1 else 0 end)')}) told from documents),
lv as (select *, row_number() over (partition by tree order by doc_id nulls first, hash) - 1 as idx, count(*) over (partition by tree) n from z),
{_tree('nodes', 'lv')},
tops as (select 1 as tree, tree as lang, hash, n, row_number() over (order by tree nulls first) - 1 as idx from (select tree, hash, count(*) over () n from nodes where nodes.n = 1)),
{_tree('high', 'tops')},
{_sides('s', 'nodes')},
{_sides('hs', 'high')},
p as (select lv.tree, lv.idx, lv.doc_id, lv.hash, lv.told, s.level, s.l, s.r from lv join s on lv.tree is not distinct from s.tree and s.idx = lv.idx >> s.level),
hp as (select tops.lang, hs.level + 1000 as level, hs.l, hs.r from tops join hs on hs.idx = tops.idx >> hs.level),
allp as (select tree, idx, level, l, r from p union all select lv.tree, lv.idx, hp.level, hp.l, hp.r from lv join hp on lv.tree is not distinct from hp.lang),
path as (select tree, idx, string_agg(l || r, '' order by level) as told_path, list({{'l': l, 'r': r}} order by level) steps from allp group by all),
w as (select lv.*, coalesce(told_path, '') told_path, coalesce(steps, []) steps from lv left join path on lv.tree is not distinct from path.tree and lv.idx = path.idx),
fold as (select tree, idx, 0 as step, told as acc, steps from w union all select tree, idx, step + 1, sha256(steps[step + 1].l || acc || steps[step + 1].r), steps from fold where step < len(steps)),
ends as (select tree, idx, acc from fold where step = len(steps)), top as (select hash from high where n = 1)
select w.doc_id, w.hash as leaf, tops.hash as subroot, top.hash as root, sha256(told_path) proof_sha256, acc as folded_root, acc = top.hash as verified
from w join tops on w.tree is not distinct from tops.lang join ends on ends.tree is not distinct from w.tree and ends.idx = w.idx, top"""
