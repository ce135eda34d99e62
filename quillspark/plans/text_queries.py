"""Queries over documents, lines and pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tex as TX
from ..functions import text as X
from ..operators import lines as L
from ..operators import quality as Q
from ..operators import search as S
from ..operators import structure as D
from ..sources.tables import evolved, new_only, spread, table

NEEDLE = "theand"
JUNK = [("percent", "%%%"), ("stars", r"\*\*\*"), ("hashes", "###")]

LINES = """cut as (select doc_id, string_split(text, chr(10)) s from documents),
sized as (select doc_id, s, case when s[-1] = '' then len(s) - 1 else len(s) end n from cut),
lines as (select doc_id, i - 1 as pos, s[i] as line from (select doc_id, s, unnest(range(1, n + 1)) i from sized))"""
KEY = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')".format
COLLAPSE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))".format
HEADING = """(trim({0}) <> '' and length(trim({0})) <= 90 and (regexp_matches(trim({0}), '^\\d+(\\.\\d+)*\\s+[A-Z0-9]')
 or lower(trim({0})) in (%s) or (upper(trim({0})) = trim({0}) and lower(trim({0})) <> trim({0}) and length(trim({0})) > 3)))""" % ",".join(f"'{w}'" for w in X.HEADING_WORDS)
HEADING = HEADING.format


def docs_(spark, d):
    return spread(table(spark, d, "documents"))


def lines_(spark, d):
    return L.lines(docs_(spark, d))


def library_search(spark, d):
    docs = docs_(spark, d).select("doc_id", F.lit("original").alias("side"), F.lit(1).alias("priority"), "text")
    return S.library_search(docs, table(spark, d, "benchmark"))


def find_all(spark, d):
    return S.find_all(lines_(spark, d), NEEDLE)


def span_overlay(spark, d):
    """Spans that the first occurrence of the needle in each document's joined key overlaps."""
    lines = lines_(spark, d)
    joined = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", X.match_key("line").alias("k")))), lambda s: s["k"]), "").alias("key"))
    at = F.instr("key", NEEDLE)
    matches = joined.where(at > 0).select("doc_id", (at - 1).cast("long").alias("begin"), (at - 1 + len(NEEDLE)).cast("long").alias("stop"))
    return S.span_overlay(lines, matches)


def span_overlay_all(spark, d):
    """Spans that any occurrence of the needle in each document's joined key overlaps."""
    lines = lines_(spark, d)
    return S.span_overlay(lines, S.key_places(lines, NEEDLE))


def include_closure(spark, d):
    """Documents as files that include one another: every one the file of half its number, by a command at its beginning or end or
    behind a comment sign, and the first one the fourth, which closes cycles."""
    half = F.when(F.col("doc_id") == 0, 3).otherwise(F.expr("doc_id div 2"))
    name = F.concat(F.lit("d"), half.cast("string"), F.lit("}"))
    text = F.coalesce("text", F.lit(""))
    first, last, noted = F.concat(F.lit("\\include{"), name, F.lit("\n"), text), F.concat(text, F.lit("\n\\input{"), name), F.concat(text, F.lit("\n% \\input{"), name)
    made = F.when(F.col("doc_id") % 5 == 4, noted).when(F.col("doc_id") % 3 == 0, first).otherwise(last)
    files = docs_(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".tex")).alias("path"), F.lit("").alias("folder"), made.alias("text"))
    return D.include_closure(files).select("path", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def line_source(spark, d):
    return lines_(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))


def repeated_lines(spark, d):
    return L.repeated_short(lines_(spark, d))


def lines_kept(spark, d):
    return L.without_repeated(lines_(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def heading_lines(spark, d):
    return lines_(spark, d).where(X.is_heading("line")).select("doc_id", "pos", X.strip("line").alias("line"))


def page_segments(spark, d):
    return L.segments(lines_(spark, d)).select("doc_id", "segment", "kind", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def line_positions(spark, d):
    return L.positions(lines_(spark, d)).select("doc_id", "pos", F.round("position", 9).alias("position"))


def char_coverage(spark, d):
    return L.character_counts(docs_(spark, d))


def uncovered_chars(spark, d):
    return Q.uncovered(docs_(spark, d))


MARKS = [("%%%", "\u2603"), ("***", "\U0001f600"), ("###", "\u2260")]


def uncovered_marks(spark, d):
    """Uncovered characters of texts in which they stand for the documents' marks; the last one has a command and isn't told."""
    text = F.col("text")
    for mark, ch in MARKS:
        text = F.replace(text, F.lit(mark), F.lit(ch))
    return Q.uncovered(docs_(spark, d).select("doc_id", text.alias("text")))


def source_lint(spark, d):
    """The documents read as TeX sources: their faults; no SQL."""
    return Q.delimiter_lint(docs_(spark, d))


def stray_braces(spark, d):
    out = Q.stray_braces_removed(docs_(spark, d))
    return out.select("doc_id", "removed", F.md5("text").alias("digest"))


def rewrite_rules(spark, d):
    """The rewrite rules that the documents' lines call for; no SQL."""
    return Q.rewrite_audit(lines_(spark, d))


# Marks of the documents, and the faults of a source that stand for them in the derived sources.
FAULTS = [("%%%", r"\mathbf{\alpha}", "bold_greek"), ("***", r"\sqrt[{k}/{a}]", "sqrt_index"), ("&&&", r"\mathrm{\bar{x}}", "roman_bar"), ("###", "a_i", "underscore"), ("\u00e9e", "\u00e9\ufffd", "replacement_sign")]


def repairs_by_line(spark, d):
    """Repairs of sources that are made of the documents: their own TeX signs are taken out, and marks stand for faults."""
    text = F.translate("text", "$\\_{}[]", "")
    for mark, fault, _ in FAULTS:
        text = F.replace(text, F.lit(mark), F.lit(fault))
    return Q.repairs(docs_(spark, d).select("doc_id", text.alias("text")), Q.rule_rows(spark))


def math_runs(spark, d):
    """Runs of prose and of mathematics of every document, read as one whose mathematics isn't typed, where dollars enclose it, and as one whose is (the texts don't tell); no SQL.

    A document without runs of a kind has none of it; digest: of the runs' texts in order.
    """
    ways = docs_(spark, d).select("doc_id", "text", F.explode(F.array(F.lit(False), F.lit(True))).alias("typed"))
    read = ways.select("doc_id", "typed", F.coalesce(TX.math_runs("text", F.col("typed")), F.array()).alias("runs"))
    own = lambda kind: F.transform(F.filter("runs", lambda r: r["kind"] == kind), lambda r: r["text"])
    chars = lambda texts: F.aggregate(texts, F.lit(0).cast("long"), lambda s, t: s + F.length(t))
    told = [F.struct(F.lit(k).alias("kind"), F.size(own(k)).cast("long").alias("n"), chars(own(k)).alias("chars"), F.md5(F.array_join(own(k), "\0")).alias("digest")) for k in ("prose", "math")]
    return read.select("doc_id", "typed", F.inline(F.array(*told)))


def marker_counts(spark, d):
    return L.marker_counts(docs_(spark, d))


def rewrite_audit(spark, d):
    return L.audit(lines_(spark, d), JUNK)


def _anchors(spark, d):
    return lines_(spark, d).where(F.contains("line", F.lit("%%%"))).select("doc_id", "pos")


def context_windows(spark, d):
    return L.context_windows(lines_(spark, d), _anchors(spark, d), 2).select("doc_id", "pos", F.length("line").cast("long").alias("chars"))


def context_windows_20(spark, d):
    """With the operator's own radius."""
    return L.context_windows(lines_(spark, d), _anchors(spark, d)).select("doc_id", "pos", F.length("line").cast("long").alias("chars"))


def distinct_anchors(spark, d):
    return _anchors(spark, d).select("doc_id", F.floor(F.col("pos") / 5).cast("long").alias("block")).dropDuplicates().orderBy("doc_id", "block")


def html_blocks(spark, d):
    return L.html_blocks(spread(table(spark, d, "pages"))).groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def html_markdown(spark, d):
    return L.render_markdown(L.html_blocks(spread(table(spark, d, "pages")))).select("page_id", F.length("markdown").cast("long").alias("chars"), F.md5("markdown").alias("digest"))


def outline_parents(spark, d):
    h = L.html_blocks(spread(table(spark, d, "pages"))).select(F.col("page_id").alias("doc_id"), "pos").withColumn("level", F.col("pos") % 3 + 1)
    return L.outline(h, 3)


def tag_balance(spark, d):
    return L.tag_balance(table(spark, d, "pages"))


def ingest_new(spark, d):
    docs = docs_(spark, d).select("doc_id", "source", "n_chars")
    return new_only(docs, docs.where("doc_id % 2 = 0"), "doc_id")


def evolve_schema(spark, d):
    docs = docs_(spark, d).select("doc_id", "lang", "n_chars")
    old = docs.where("doc_id % 2 = 0").drop("lang")
    both = old.unionByName(docs.where("doc_id % 2 = 1"), allowMissingColumns=True)
    return evolved(both, {"lang": ("string", "und"), "reviewed": ("boolean", False)})


def metadata_fill(spark, d):
    """Quality from labels only where the document has none of its own."""
    own = docs_(spark, d).select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit(9)).alias("own"))
    return own.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("own", "quality").cast("long").alias("quality"))


def tier_fallback(spark, d):
    """A document's rows come from the best tier that has any: labels, then a length rule."""
    exact = table(spark, d, "labels").select("doc_id", F.lit("label").alias("tier"), F.col("quality").cast("long").alias("value"))
    rule = docs_(spark, d).select("doc_id", F.lit("rule").alias("tier"), (F.col("n_chars") > 500).cast("long").alias("value"))
    return exact.unionByName(rule.join(exact.select("doc_id"), "doc_id", "left_anti"))


def union_kinds(spark, d):
    docs = docs_(spark, d)
    parts = docs.select("doc_id", F.lit("translation_segment").alias("kind"), F.col("n_chars").cast("long").alias("n")).unionByName(
        lines_(spark, d).groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("structured_block").alias("kind"), "n")
    )
    return parts.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))


def group_caps(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return docs_(spark, d).select("source", "doc_id", "n_chars", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 20")


QUERIES = {
    f.__name__: f
    for f in (
        library_search, find_all, span_overlay, span_overlay_all, include_closure, line_source, repeated_lines, lines_kept, heading_lines, page_segments, line_positions, char_coverage, uncovered_chars, uncovered_marks,
        source_lint, stray_braces, rewrite_rules, repairs_by_line, math_runs, marker_counts, rewrite_audit, context_windows, context_windows_20, distinct_anchors, html_blocks, html_markdown, outline_parents, tag_balance, ingest_new, evolve_schema,
        metadata_fill, tier_fallback, union_kinds, group_caps,
    )
}

_BLOCKS = """stripped as (select page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<nav\\b.*?</nav\\s*>|<footer\\b.*?</footer\\s*>', '', 'g') h from pages),
marked as (select page_id, regexp_replace(h, '(?is)<(/?)(h[1-6]|p|li|article|div|ul|ol|body|html)\\b([^>]*)>', chr(1) || '<\\1\\2>' || chr(2), 'g') h from stripped),
bits as (select page_id, unnest(string_split(h, chr(1))) bit, generate_subscripts(string_split(h, chr(1)), 1) k from marked),
picked as (select page_id, k, lower(regexp_extract(bit, '^<([a-zA-Z0-9]+)>', 1)) tag, string_split(bit, chr(2))[2] inner_text from bits where regexp_matches(bit, '(?i)^<(h[1-6]|p|li)>')),
blocks0 as (select page_id, row_number() over (partition by page_id order by k) - 1 as pos, tag, trim(regexp_replace(regexp_replace(inner_text, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as text from picked),
blocks as (select page_id, pos, case when tag like 'h%' then 'title' when tag = 'p' then 'paragraph' else 'item' end kind, case when tag like 'h%' then cast(substr(tag, 2, 1) as bigint) end as level, text from blocks0 where text <> '')"""

ORACLES = {
    "library_search": f"""with q as (select item_id, {KEY('text')} needle from benchmark), d as (select doc_id, text, {KEY('text')} k from documents where text is not null),
hit as (select item_id, doc_id, text, k, instr(k, needle) - 1 as pos from d, q where needle <> '' and contains(k, needle)),
ranked as (select *, row_number() over (partition by item_id order by doc_id) as r, pos / greatest(1, length(k)) as ratio from hit)
select item_id, r as rank, doc_id, 'original' as side, {COLLAPSE("substr(text, cast(least(length(text), floor(ratio * length(text))) as bigint) + 1, 160)")} as snippet, round(ratio, 4) as position_ratio from ranked where r <= 20""",
    "find_all": f"""with {LINES}, k as (select doc_id, pos, {KEY('line')} k from lines),
hit as (select doc_id, pos, i - 1 as "at" from (select doc_id, pos, k, unnest(range(1, length(k) - {len(NEEDLE)} + 2)) i from k where contains(k, '{NEEDLE}')) where substr(k, i, {len(NEEDLE)}) = '{NEEDLE}')
select doc_id, pos, "at", nth from (select *, row_number() over (partition by doc_id order by pos, "at") nth from hit) where nth <= 500""",
    "span_overlay": f"""with {LINES}, k as (select doc_id, pos, {KEY('line')} k from lines),
j as (select doc_id, string_agg(k, '' order by pos) key from k group by doc_id), m as (select doc_id, instr(key, '{NEEDLE}') - 1 as b from j where contains(key, '{NEEDLE}')),
s as (select doc_id, pos, sum(length(k)) over (partition by doc_id order by pos) as e, length(k) n from k)
select s.doc_id, m.b as "begin", m.b + {len(NEEDLE)} as stop, pos, cast(e - n as bigint) as start, cast(e as bigint) as "end" from s join m using (doc_id) where n > 0 and e - n < m.b + {len(NEEDLE)} and e > m.b""",
    "span_overlay_all": f"""with {LINES}, k as (select doc_id, pos, {KEY('line')} k from lines),
j as (select doc_id, string_split(string_agg(k, '' order by pos), '{NEEDLE}') p from k group by doc_id),
m as (select doc_id, cast(list_sum(list_transform(p[1:i], lambda x: length(x))) + {len(NEEDLE)} * (i - 1) as bigint) as b from (select doc_id, p, unnest(range(1, len(p))) i from j)),
s as (select doc_id, pos, sum(length(k)) over (partition by doc_id order by pos) as e, length(k) n from k)
select s.doc_id, m.b as "begin", m.b + {len(NEEDLE)} as stop, pos, cast(e - n as bigint) as start, cast(e as bigint) as "end" from s join m using (doc_id) where n > 0 and e - n < m.b + {len(NEEDLE)} and e > m.b""",
    "include_closure": r"""with recursive f as (select doc_id, coalesce(text, '') t, case when doc_id = 0 then 3 else doc_id // 2 end half, case when doc_id % 5 = 4 then 0 when doc_id % 3 = 0 then 1 else 2 end kind from documents),
c as (select doc_id, half, kind, t, '\' || case when kind = 1 then 'include' else 'input' end || '{d' || half || '}' as command from f),
g as (select doc_id, case when kind > 0 and half in (select doc_id from documents) then half end as into_, case kind when 1 then '' else t || chr(10) || case when kind = 0 then '% ' else '' end end as head, case kind when 1 then chr(10) || t else '' end as tail, command from c),
w as (select doc_id as root, doc_id as at_, [doc_id] as way, head as before, tail as after, into_, command from g
 union all select w.root, g.doc_id, list_append(w.way, g.doc_id), w.before || g.head, g.tail || w.after, g.into_, g.command from w join g on g.doc_id = w.into_ where not list_contains(w.way, g.doc_id) and len(w.way) <= 8),
e as (select root, before || command || after as text, row_number() over (partition by root order by len(way) desc) k from w)
select 'd' || root || '.tex' as path, length(text) chars, md5(text) digest from e where k = 1""",
    "line_source": f"with {LINES} select doc_id, count(*) n_lines, cast(sum(length(line)) as bigint) chars from lines group by doc_id",
    "repeated_lines": f"with {LINES}, k as (select doc_id, lower({COLLAPSE('line')}) key from lines) select doc_id, key, count(*) n from k where length(key) between 1 and 80 group by all having count(*) >= 2",
    "lines_kept": f"with {LINES}, k as (select doc_id, lower({COLLAPSE('line')}) key from lines), n as (select doc_id, key, count(*) over (partition by doc_id, key) n from k) select doc_id, count(*) n_lines from n where not (n >= 2 and length(key) between 1 and 80) group by doc_id",
    "heading_lines": f"with {LINES} select doc_id, pos, trim(line) as line from lines where {HEADING('line')}",
    "page_segments": f"""with {LINES}, own as (select doc_id, pos, trim(line) as line, {HEADING('line')} as heading, row_number() over (partition by doc_id order by pos) nth from lines where trim(line) <> ''),
k as (select *, case when nth = 1 and length(line) <= 120 and not heading then 'title' when heading then 'heading' else 'paragraph' end kind from own),
f as (select *, case when kind <> 'paragraph' or coalesce(lag(kind) over (partition by doc_id order by pos), '') <> 'paragraph' then 1 else 0 end st from k),
g as (select *, cast(sum(st) over (partition by doc_id order by pos) as bigint) segment from f),
t as (select doc_id, segment, kind, string_agg(line, ' ' order by pos) as text from g group by all)
select doc_id, segment, kind, length(text) chars, md5(text) digest from t""",
    "line_positions": f"with {LINES} select doc_id, pos, round(pos / greatest(1, count(*) over (partition by doc_id) - 1), 9) as position from lines",
    "char_coverage": "with c as (select unnest(string_split(text, '')) ch from documents) select printf('U+%04X', unicode(ch)) code, count(*) n from c where unicode(ch) > 127 group by ch",
    "uncovered_chars": "with c as (select unnest(string_split(text, '')) ch from documents), n as (select ch, unicode(ch) u, count(*) n from c group by ch) select ch, printf('U+%04X', u) code, n from n where u > 127 and not u between 160 and 879 and not u between 12288 and 12351 and not u between 13312 and 19903 and not u between 19968 and 40959 and not u between 63744 and 64255 and not u between 65280 and 65519 and not u between 131072 and 173791 and not contains('" + TX.SAFE_SIGNS + "".join(TX.SYMBOLS) + "', ch)",
    "uncovered_marks": "select ch, printf('U+%04X', unicode(ch)) code, cast(sum((length(text) - length(replace(text, mark, ''))) / 3) as bigint) n from documents, (values ('%%%', chr(9731)), ('***', chr(128512))) m(mark, ch) where contains(text, mark) group by ch",
    "marker_counts": r"""select doc_id, len(regexp_extract_all(text, '\x{fffd}')) n_replacement, len(regexp_extract_all(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) n_control,
len(regexp_extract_all(text, '%%%|\*\*\*|&&&|###|\$\$\$')) n_junk, length(regexp_replace(text, '%%%|\*\*\*|&&&|###|\$\$\$', '', 'g')) clean_chars from documents""",
    "rewrite_audit": f"""with {LINES}, r as (select * from (values ('percent', '%%%'), ('stars', '***'), ('hashes', '###')) t(rule, mark)),
h as (select doc_id, rule, (length(line) - length(replace(line, mark, ''))) / 3 as hits from lines, r where contains(line, mark)) select doc_id, rule, count(*) as lines, cast(sum(hits) as bigint) hits from h group by all""",
    "repairs_by_line": f"""with {LINES}, r as (select * from (values {", ".join(f"('{m}', '{rule}')" for m, _, rule in FAULTS)}) t(mark, rule)),
l as (select doc_id, pos + 1 as line, translate(line, '$\\_{{}}[]', '') as line_text from lines)
select doc_id, rule, line, cast((length(line_text) - length(replace(line_text, mark, ''))) / length(mark) as bigint) hits from l, r where contains(line_text, mark)""",
    "context_windows": f"""with {LINES}, a as (select doc_id, pos from lines where contains(line, '%%%')) select doc_id, pos, length(line) chars from lines l where exists (select 1 from a where a.doc_id = l.doc_id and abs(a.pos - l.pos) <= 2)""",
    "context_windows_20": f"""with {LINES}, a as (select doc_id, pos from lines where contains(line, '%%%')) select doc_id, pos, length(line) chars from lines l where exists (select 1 from a where a.doc_id = l.doc_id and abs(a.pos - l.pos) <= 20)""",
    "distinct_anchors": f"with {LINES} select distinct doc_id, pos // 5 as block from lines where contains(line, '%%%')",
    "html_blocks": f"with {_BLOCKS} select page_id, kind, count(*) n, cast(sum(length(text)) as bigint) chars from blocks group by all",
    "html_markdown": f"with {_BLOCKS}, m as (select page_id, string_agg(case when kind = 'title' then repeat('#', cast(level as int)) || ' ' || text when kind = 'item' then '- ' || text else text end, chr(10) || chr(10) order by pos) md from blocks group by page_id) select page_id, length(md) chars, md5(md) digest from m",
    "outline_parents": f"with {_BLOCKS}, h as (select page_id doc_id, pos, pos % 3 + 1 as level from blocks) select h.doc_id, h.pos, h.level, (select max(p.pos) from h p where p.doc_id = h.doc_id and p.pos < h.pos and p.level < h.level) as parent from h",
    "tag_balance": r"""with t as (select page_id, k, case when x like '</%' then -1 else 1 end s from (select page_id, unnest(regexp_extract_all(html, '(?i)</?p[\s>]')) x, generate_subscripts(regexp_extract_all(html, '(?i)</?p[\s>]'), 1) k from pages)),
r as (select *, sum(s) over (partition by page_id order by k) run from t), z as (select page_id, sum(case when s > 0 then 1 else 0 end) o, sum(case when s < 0 then 1 else 0 end) c, greatest(0, -min(run)) stray from r group by page_id)
select p.page_id, cast(coalesce(o, 0) as bigint) openers, cast(coalesce(c, 0) as bigint) closers, cast(coalesce(o - c + stray, 0) as bigint) unclosed, cast(coalesce(stray, 0) as bigint) stray from pages p left join z using (page_id)""",
    "ingest_new": "select doc_id, source, n_chars from documents where doc_id % 2 = 1",
    "evolve_schema": "select doc_id, case when doc_id % 2 = 0 then 'und' else lang end lang, n_chars, false as reviewed from documents",
    "metadata_fill": "select doc_id, cast(coalesce(case when doc_id % 7 = 0 then 9 end, quality) as bigint) quality from documents left join labels using (doc_id)",
    "tier_fallback": "select doc_id, 'label' tier, cast(quality as bigint) as value from labels union all select doc_id, 'rule', cast(n_chars > 500 as bigint) from documents where doc_id not in (select doc_id from labels)",
    "union_kinds": f"with {LINES} select 'translation_segment' kind, count(*) as rows, cast(sum(n_chars) as bigint) total from documents union all select 'structured_block', count(distinct doc_id), count(*) from lines",
    "group_caps": "select source, doc_id, n_chars, rank from (select source, doc_id, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents) where rank <= 20",
}
