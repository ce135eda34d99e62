"""Queries over conversations, retrieval and alignment, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import align as A
from ..operators import lines as L
from ..operators import retrieve as R
from ..operators import segmentwork as G
from ..sources.tables import table
from .text_queries import COLLAPSE, KEY, LINES, docs_, lines_

SCOPE = 5


def talk(spark, d):
    return table(spark, d, "conversations")


def history_last8(spark, d):
    return R.last_turns(talk(spark, d))


def session_titles(spark, d):
    return R.session_titles(talk(spark, d))


def render_conversation(spark, d):
    t = R.ordered_text(talk(spark, d), ["conv_id"], "turn", F.concat(F.lit("**"), F.col("role"), F.lit("**\n\n"), F.col("text")), "\n\n")
    return t.select("conv_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def session_by_document(spark, d):
    """Sessions whose list of documents holds a given one: documents are the ids modulo 7 of its turns."""
    s = talk(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_set((F.col("conv_id") + F.col("turn")) % 7)).alias("document_ids"))
    return s.where(F.array_contains("document_ids", F.lit(3).cast("long"))).select("conv_id", F.size("document_ids").cast("long").alias("n"))


def _pairs(spark, d):
    t = talk(spark, d)
    w = Window.partitionBy("conv_id").orderBy("turn")
    both = t.withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return both.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "text", "answer")


def pair_validation(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.array_join(G.issues(F.col("text"), F.col("answer")), ",").alias("issues"))


def pair_repair(spark, d):
    r = _pairs(spark, d).withColumn("fixed", G.repair(F.col("text"), F.col("answer")))
    return r.select("conv_id", "turn", (F.col("fixed") != F.col("answer")).alias("changed"), F.md5("fixed").alias("digest"))


def zip_align(spark, d):
    t = talk(spark, d)
    side = lambda role: t.where(F.col("role") == role).select("conv_id", F.col("turn").alias("ord"), "text")
    z = A.zip_pairs(side("user"), side("assistant"), "conv_id")
    return z.select("conv_id", "index", F.round("position", 9).alias("position"), F.md5("original").alias("original"), F.md5("translated").alias("translated"))


def delta_assembly(spark, d):
    """Turns as stream frames: user turns are deltas; the last assistant turn closes every even conversation."""
    t = talk(spark, d)
    done = (F.col("role") == "assistant") & (F.col("conv_id") % 2 == 0)
    frames = t.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.when(done, "done").when(F.col("role") == "user", "delta").otherwise("meta").alias("event"), "text")
    return R.deltas_to_answers(frames).select("session_id", F.md5("answer").alias("digest"), "complete")


def array_distinct_order(spark, d):
    """Distinct roles of a conversation in order of first use."""
    g = talk(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"))
    return g.select("conv_id", F.array_join(F.array_distinct(F.transform("l", lambda s: s["role"])), ",").alias("roles"))


def token_difference(spark, d):
    p = _pairs(spark, d)
    return p.select("conv_id", "turn", F.size(F.array_except(X.tokens("text"), X.tokens("answer"))).cast("long").alias("lost"), F.size(F.array_except(X.tokens("answer"), X.tokens("text"))).cast("long").alias("gained"))


def token_overlap(spark, d):
    p = _pairs(spark, d)
    return p.select("conv_id", "turn", F.size(F.array_intersect(X.tokens("text"), X.tokens("answer"))).cast("long").alias("shared"))


def _questions(spark, d):
    """Questions (user turns) and their scope of documents."""
    q = talk(spark, d).where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("q_id"), "conv_id", F.col("text").alias("question"))
    scope = q.select("q_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(SCOPE - 1)), lambda k: F.col("conv_id") * SCOPE + k)).alias("doc_id"))
    return q.select("q_id", "question"), scope


def _asked(spark, d):
    """Questions, their scope, and the blocks (lines) of its documents."""
    q, scope = _questions(spark, d)
    docs = docs_(spark, d).join(scope.select("doc_id").distinct(), "doc_id", "left_semi")
    return q, scope, R.retrieval_blocks(docs, "\n")


def token_retrieval(spark, d):
    q, scope, blocks = _asked(spark, d)
    return R.token_overlap(q, blocks, scope)


def ranked_blocks(spark, d):
    q, scope, blocks = _asked(spark, d)
    return R.rank_blocks(q, blocks, scope).select("q_id", "doc_id", "idx", F.round("position", 9).alias("position"), F.col("place").cast("long").alias("place"))


def budgeted_sources(spark, d):
    q, scope = _questions(spark, d)
    b = R.budgeted(q, docs_(spark, d), scope, total=4_000, sep="\n")
    return b.select("q_id", "label", "doc_id", "idx", F.length("content").cast("long").alias("chars"))


def _asked_of_all(spark, d):
    q = talk(spark, d).where("role = 'user'").select(F.struct("conv_id", "turn").alias("q_id"), F.col("text").alias("question"))
    return q, R.retrieval_blocks(docs_(spark, d), "\n")


def token_retrieval_all(spark, d):
    """Every question asked of every document."""
    return R.token_overlap(*_asked_of_all(spark, d)).select("q_id.conv_id", "q_id.turn", "doc_id", "idx", "overlap")


def ranked_blocks_all(spark, d):
    q, blocks = _asked_of_all(spark, d)
    r = R.rank_blocks(q, blocks.withColumn("position", F.round("position", 9)))  # a block's, not a pair's
    return r.select("q_id.conv_id", "q_id.turn", "doc_id", "idx", "position", F.col("place").cast("long").alias("place"))


def budgeted_sources_all(spark, d):
    """Sources of every question from all documents, within the operator's own budget."""
    q = talk(spark, d).where("role = 'user'").select(F.struct("conv_id", "turn").alias("q_id"), F.col("text").alias("question"))
    b = R.budgeted(q, docs_(spark, d), sep="\n")
    return b.select("q_id.conv_id", "q_id.turn", "label", "doc_id", "idx", F.length("content").cast("long").alias("chars"))


def _selections(spark, d):
    """Every tenth line of a document, looked for in its own lines from the middle of the page."""
    return lines_(spark, d).where("pos % 10 = 3 and length(line) >= 20").select((F.col("doc_id") * 100_000 + F.col("pos")).alias("n_id"), "doc_id", F.substring("line", 5, 60).alias("selected"), F.lit(0.5).alias("page_ratio"))


def _entries(spark, d):
    return L.placed_lines(docs_(spark, d)).select("doc_id", F.col("pos").alias("idx"), "position", F.col("line").alias("original"))


def locate_exact(spark, d):
    found = A.locate(_selections(spark, d), _entries(spark, d), partial=False)
    return found.where("confidence = 1").select("n_id", "idx", "confidence")


def best_page(spark, d):
    """Beginnings of lines that go astray after 70 characters, looked for in their document's lines."""
    pages = lines_(spark, d).select("doc_id", F.col("pos").alias("page"), X.match_key("line").alias("key"))
    t = pages.where("page % 7 = 2 and length(key) >= 80").select((F.col("doc_id") * 100_000 + F.col("page")).alias("t_id"), "doc_id", F.concat(F.left("key", F.lit(70)), F.lit("0000000000")).alias("needle"), F.lit(0).cast("long").alias("hint"))
    return A.best_page(t, pages)


def locate_lines(spark, d):
    """Every line, whole, looked for with all tiers in its own document from the middle of the page (its own key is always found whole)."""
    lines = lines_(spark, d)
    asked = lines.select(F.struct("doc_id", "pos").alias("n_id"), "doc_id", F.col("line").alias("selected"), F.lit(0.5).alias("page_ratio"))
    return A.locate(asked, _entries(spark, d), whole=True).select("doc_id", F.col("n_id.pos").alias("pos"), "idx", F.round("confidence", 9).alias("confidence"))


def locate_partial(spark, d):
    """Two selections of every line of 14 key characters or more: with the next line behind it, which contains
    the line, and with its last quarter gone astray, which only a common run can find."""
    lines = L.followed_lines(docs_(spark, d)).withColumn("key", X.match_key("line")).where("length(key) >= 14")
    lost = F.concat(F.left("key", F.floor(F.length("key") * 3 / 4).cast("int")), F.repeat(F.lit("0"), F.ceil(F.length("key") / 4).cast("int")))
    kinds = F.array(F.struct(F.lit(0).cast("long").alias("kind"), F.concat_ws(" ", "line", "behind").alias("selected")), F.struct(F.lit(1).cast("long").alias("kind"), lost.alias("selected")))
    asked = lines.select("doc_id", "pos", F.inline(kinds)).select(F.struct("doc_id", "pos", "kind").alias("n_id"), "doc_id", "selected", F.lit(0.5).alias("page_ratio"))
    return A.locate(asked, _entries(spark, d)).select("doc_id", "n_id.pos", "n_id.kind", "idx", F.round("confidence", 6).alias("confidence"))


def best_page_lines(spark, d):
    """Every line with an end that is nowhere, looked for in its document's lines at all cuts."""
    pages = lines_(spark, d).select("doc_id", F.col("pos").alias("page"), X.match_key("line").alias("key"))
    asked = pages.select(F.struct("doc_id", "page").alias("t_id"), "doc_id", F.concat("key", F.lit("0000000000")).alias("needle"), F.lit(0).cast("long").alias("hint"))
    return A.best_page(asked, pages).select("doc_id", F.col("t_id.page").alias("pos"), "page", "match")


def figure_pages(spark, d):
    """The first line, as a page, of a document that says "table" or "fig" and a number, for each of three numbers; lines stand for pages.

    The documents' digits follow words of their own; "table " before every number makes labels of them, at the line's start for even lines."""
    made = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("Table "), F.regexp_extract("line", r"(\d+)", 1), F.lit(" "), "line")).otherwise(F.concat("line", F.lit(" fig. "), F.regexp_extract("line", r"(\d+)", 1)))
    pages = lines_(spark, d).where(F.col("line").rlike(r"\d")).select("doc_id", F.col("pos").alias("page"), made.alias("text"))
    found = A.page_labels(pages).groupBy("doc_id", "kind", "number").agg(F.min(F.struct("rank", "page")).alias("r"))
    return found.select("doc_id", "kind", "number", "r.rank", "r.page")


def neighbour_context(spark, d):
    return A.neighbours(lines_(spark, d)).select("doc_id", "pos", F.length("before").cast("long").alias("before"), F.length("behind").cast("long").alias("behind"))


def chunk_pack(spark, d):
    """Lines packed into chunks of at most 4000 characters, joined by two."""
    rows = lines_(spark, d).where(X.strip("line") != "")
    b = G.greedy_batches(rows, "doc_id", "pos", F.length("line"), 4_000, 2)
    return b.groupBy("doc_id", "batch").agg(F.count("*").alias("n_lines"), F.min("pos").alias("first"))


def chunk_pack_cut(spark, d):
    """Like chunk_pack, with longer lines cut first, so that no chunk is above 4000 characters; no SQL."""
    line = F.when(F.length("line") <= 4_000, F.array("line")).otherwise(G.cut_long(F.col("line"), 4_000))
    rows = lines_(spark, d).where(X.strip("line") != "").select("doc_id", "pos", F.posexplode(line).alias("part", "piece"))
    rows = rows.select("doc_id", F.struct("pos", "part").alias("at"), "piece")
    b = G.greedy_batches(rows, "doc_id", "at", F.length("piece"), 4_000, 2).join(rows, ["doc_id", "at"])
    chars = (F.sum(F.length("piece")) + 2 * (F.count("*") - 1)).cast("long")
    return b.groupBy("doc_id", "batch").agg(F.count("*").alias("n_pieces"), F.min("at.pos").alias("first"), chars.alias("chars"))


def _memo(spark, d):
    """Half of the distinct lines are known."""
    seen = lines_(spark, d).select("line").distinct().where(F.pmod(F.length("line"), F.lit(2)) == 0)
    return seen.select(X.memo_key("line").alias("key"), F.concat(F.lit("<"), F.col("line"), F.lit(">")).alias("value"))


def memo_hits(spark, d):
    hits, _ = G.memo_split(lines_(spark, d), _memo(spark, d))
    return hits.select("doc_id", "pos", "key", F.md5("value").alias("digest"))


def memo_misses(spark, d):
    _, misses = G.memo_split(lines_(spark, d), _memo(spark, d))
    return misses.select("key", F.length("line").cast("long").alias("chars"))


def segment_progress(spark, d):
    """Segments done and in all, by document."""
    keyed = lines_(spark, d).withColumn("key", X.memo_key("line")).join(_memo(spark, d), "key", "left")
    return keyed.groupBy("doc_id").agg(F.count("value").alias("done"), F.count("*").alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        history_last8, session_titles, render_conversation, session_by_document, pair_validation, pair_repair, zip_align, delta_assembly, array_distinct_order,
        token_difference, token_overlap, token_retrieval, ranked_blocks, budgeted_sources, token_retrieval_all, ranked_blocks_all, budgeted_sources_all, locate_exact, locate_partial, best_page, locate_lines, best_page_lines, figure_pages, neighbour_context, chunk_pack, chunk_pack_cut, memo_hits, memo_misses, segment_progress,
    )
}

_PAIRS = "pairs as (select conv_id, turn, text, answer from (select *, lead(role) over w as next_role, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn)) where role = 'user' and next_role = 'assistant')"
_TOKENS = "list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z0-9_]{{2,}}|[\\x{{4e00}}-\\x{{9fff}}]'), lambda x: lower(x)))".format
_ASKED = f"""q as (select conv_id * 100 + turn as q_id, conv_id, text as question, {_TOKENS('text')} as toks from conversations where role = 'user'),
scope as (select q_id, unnest([conv_id * {SCOPE} + k for k in range({SCOPE})]) as doc_id from q),
kept as (select doc_id, [x for x in string_split(text, chr(10)) if length(trim(x)) >= 20] as l from documents),
blocks as (select doc_id, i - 1 as idx, {COLLAPSE('l[i]')} as block, (i - 1) / greatest(1, len(l) - 1) as position from (select doc_id, l, unnest(range(1, len(l) + 1)) i from kept)),
tok as (select doc_id, idx, {_TOKENS('block')} as toks from blocks),
over as (select s.q_id, b.doc_id, b.idx, len(list_intersect(q.toks, b.toks)) as overlap, len(q.toks) as n from scope s join q using (q_id) join tok b using (doc_id)),
scored as (select o.*, b.position, o.overlap + o.overlap / greatest(1, n) + case when regexp_matches(block, '^(#|摘要|Abstract)') then 0.25 else 0 end as score from over o join blocks b using (doc_id, idx)),
top as (select *, row_number() over (partition by q_id, doc_id order by score desc, idx) as place from scored),
three as (select q_id, doc_id, idx, position, place from top where place <= 3),
ranked as (select * from three union all select q_id, doc_id, 0, 0.0, 0 from three group by q_id, doc_id having min(idx) > 0)"""
# All documents that a budget of 26,000 characters can reach: the sum of the three shortest chunks before them is below it.
_ASKED_ALL = _ASKED.replace("conv_id * 100 + turn as q_id", "conv_id * 1000000 + turn as q_id").split("scope as")[0] + "kept as" + _ASKED.split("kept as")[1].split("over as")[0]
_REACHED = """short as (select doc_id, cast(sum(least(length(block), 4200)) as bigint) s from (select *, row_number() over (partition by doc_id order by least(length(block), 4200)) r from blocks) where r <= 3 group by doc_id),
near as (select doc_id from (select doc_id, coalesce(sum(s) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) b from short) where b < 26000),
scope as (select q_id, doc_id from q, near), over as"""
_MEMOKEY = f"sha256('{X.CONTRACT}' || chr(0) || 'ir' || chr(0) || {{0}})".format
_LEAKS = ",".join("'" + p.replace("'", "''") + "'" for p in G.LEAKS)

ORACLES = {
    "history_last8": "select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as history from (select *, row_number() over (partition by conv_id order by turn desc) r from conversations) where r <= 8 group by conv_id",
    "session_titles": f"select conv_id, case when length(t) > 36 then left(t, 36) || '…' else t end title from (select conv_id, {COLLAPSE('arg_min(text, turn)')} t from conversations where role = 'user' group by conv_id)",
    "render_conversation": "select conv_id, length(t) chars, md5(t) digest from (select conv_id, string_agg('**' || role || '**' || chr(10) || chr(10) || text, chr(10) || chr(10) order by turn) t from conversations group by conv_id)",
    "session_by_document": "select conv_id, count(distinct (conv_id + turn) % 7) n from conversations group by conv_id having bool_or((conv_id + turn) % 7 = 3)",
    "pair_validation": f"""with {_PAIRS}, m as (select *, regexp_matches(text, '(^|[^\\\\])\\$') sd, regexp_matches(answer, '(^|[^\\\\])\\$') td from pairs)
select conv_id, turn, array_to_string(list_filter([case when trim(answer) = '' then 'empty' end, case when contains(answer, '```') then 'code_fence' end,
case when regexp_matches(answer, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') then 'control' end,
case when regexp_extract_all(text, '__PR_PH_\\d+__') <> regexp_extract_all(answer, '__PR_PH_\\d+__') then 'placeholder' end, case when td and not sd then 'dollar' end,
case when regexp_extract_all(text, '</?[A-Za-z][^>\\r\\n]*>') <> regexp_extract_all(answer, '</?[A-Za-z][^>\\r\\n]*>') then 'tag' end,
case when len(list_filter([{_LEAKS}], lambda p: contains(lower(answer), p) and not contains(lower(text), p))) > 0 then 'meta' end,
case when regexp_matches(answer, '\\\\(documentclass|begin\\{{document\\}}|usepackage)\\b') then 'document' end,
case when length(answer) > greatest(800, 5 * length(text)) then 'expansion' end], lambda x: x is not null), ',') as issues from m""",
    "pair_repair": f"""with {_PAIRS}, f as (select *, case when not regexp_matches(text, '(^|[^\\\\])\\$') then regexp_replace(regexp_replace(replace(answer, chr(65533), ''), '(^|[^\\\\])\\$', '\\1\\\\$', 'g'), '(^|[^\\\\])\\$', '\\1\\\\$', 'g') else replace(answer, chr(65533), '') end fixed from pairs)
select conv_id, turn, fixed <> answer as changed, md5(fixed) digest from f""",
    "zip_align": """with s as (select conv_id, role, text, row_number() over w - 1 as i, count(*) over (partition by conv_id, role) n from conversations where trim(text) <> '' window w as (partition by conv_id, role order by turn))
select a.conv_id, a.i as "index", round(a.i / greatest(1, a.n - 1), 9) as position, md5(a.text) as original, md5(b.text) as translated from s a join s b on a.conv_id = b.conv_id and a.i = b.i and a.n = b.n where a.role = 'user' and b.role = 'assistant'""",
    "delta_assembly": """select conv_id as session_id, md5(coalesce(max_by(text, turn) filter (role = 'assistant' and conv_id % 2 = 0), string_agg(text, '' order by turn) filter (role = 'user'), '')) as digest, bool_or(role = 'assistant' and conv_id % 2 = 0) as complete from conversations group by conv_id""",
    "array_distinct_order": "select conv_id, string_agg(role, ',' order by t) roles from (select conv_id, role, min(turn) t from conversations group by all) group by conv_id",
    "token_difference": f"with {_PAIRS}, t as (select conv_id, turn, {_TOKENS('text')} a, {_TOKENS('answer')} b from pairs) select conv_id, turn, len(list_filter(a, lambda x: not list_contains(b, x))) lost, len(list_filter(b, lambda x: not list_contains(a, x))) gained from t",
    "token_overlap": f"with {_PAIRS} select conv_id, turn, len(list_intersect({_TOKENS('text')}, {_TOKENS('answer')})) shared from pairs",
    "token_retrieval": f"with {_ASKED} select q_id, doc_id, idx, overlap from over where overlap > 0",
    "ranked_blocks": f"with {_ASKED} select q_id, doc_id, idx, round(position, 9) as position, place from ranked",
    "budgeted_sources": f"""with {_ASKED}, c as (select q_id, r.doc_id, r.idx, place, left(block, 4200) as chunk from ranked r join blocks b on r.doc_id = b.doc_id and r.idx = b.idx),
u as (select *, coalesce(sum(length(chunk)) over (partition by q_id order by doc_id, place rows between unbounded preceding and 1 preceding), 0) used, row_number() over (partition by q_id order by doc_id, place) k from c)
select q_id, 'P' || k as label, doc_id, idx, cast(least(length(chunk), 4000 - used) as bigint) as chars from u where used < 4000""",
    "budgeted_sources_all": f"""with {_ASKED_ALL} {_REACHED} {_ASKED.split("over as")[1]}, c as (select q_id, r.doc_id, r.idx, place, left(block, 4200) as chunk from ranked r join blocks b on r.doc_id = b.doc_id and r.idx = b.idx),
u as (select *, coalesce(sum(length(chunk)) over (partition by q_id order by doc_id, place rows between unbounded preceding and 1 preceding), 0) used, row_number() over (partition by q_id order by doc_id, place) k from c)
select q_id // 1000000 as conv_id, q_id % 1000000 as turn, 'P' || k as label, doc_id, idx, cast(least(length(chunk), 26000 - used) as bigint) as chars from u where used < 26000""",
    "token_retrieval_all": f"""with {_ASKED_ALL} qt as (select q_id, unnest(toks) t from q), bt as (select doc_id, idx, unnest(toks) t from tok)
select q_id // 1000000 as conv_id, q_id % 1000000 as turn, doc_id, idx, count(*) as overlap from qt join bt using (t) group by q_id, doc_id, idx""",
    "locate_exact": f"""with {LINES}, e as (select doc_id, pos as idx, pos / greatest(1, count(*) over (partition by doc_id) - 1) as position, {KEY('line')} k from lines),
s as (select doc_id * 100000 + pos as n_id, doc_id, {KEY('substr(line, 5, 60)')} needle from lines where pos % 10 = 3 and length(line) >= 20),
p as (select n_id, idx, row_number() over (partition by n_id order by abs(position - 0.5), idx) r from s join e using (doc_id) where needle <> '' and (contains(k, needle) or length(k) >= 8 and contains(needle, k) and length(k) / length(needle) * 0.25 + 0.72 >= 0.98 and exists (select 1 from e x where x.doc_id = s.doc_id and contains(x.k, needle))))
select n_id, idx, cast(1.0 as double) as confidence from p where r = 1""",
    "locate_lines": f"""with {LINES}, e as (select doc_id, pos, pos / greatest(1, count(*) over (partition by doc_id) - 1) as position, {KEY('line')} k from lines),
p as (select s.doc_id, s.pos, e.pos as idx, row_number() over (partition by s.doc_id, s.pos order by abs(e.position - 0.5), e.pos) r from e s join e on s.doc_id = e.doc_id and contains(e.k, s.k) where s.k <> '')
select doc_id, pos, idx, cast(1 as double) as confidence from p where r = 1""",
    "best_page_lines": f"""with {LINES}, k as (select doc_id, pos, {KEY('line')} k from lines), t as (select doc_id, pos, k || '0000000000' as n from k where length(k) >= 2),
m as (select t.doc_id, t.pos, k.pos as page, case when contains(k, n) then length(n) when length(n) > 120 and contains(k, left(n, 120)) then 120 when length(n) > 60 and contains(k, left(n, 60)) then 60 when length(n) > 24 and contains(k, left(n, 24)) then 24 end as match from t join k on t.doc_id = k.doc_id),
r as (select *, row_number() over (partition by doc_id, pos order by match desc, page) r from m where match is not null) select doc_id, pos, page, match from r where r = 1""",
    "locate_partial": f"""with {LINES}, k as (select doc_id, pos, {KEY('line')} k, count(*) over (partition by doc_id) n from lines), e as (select doc_id, pos as idx, pos / greatest(1, n - 1) as position, k as c from k where k <> ''),
w as (select doc_id, pos, k, coalesce(lead(k) over (partition by doc_id order by pos), '') as behind from k),
s as (select doc_id, pos, 0 as kind, left(k || behind, {A.NEEDLE}) as needle from w where length(k) >= 14 union all select doc_id, pos, 1, left(left(k, cast(floor(length(k) * 3 / 4) as int)) || repeat('0', cast(ceil(length(k) / 4) as int)), {A.NEEDLE}) from w where length(k) >= 14),
ng as (select doc_id, pos, kind, i, substr(needle, i, 8) g from (select *, unnest(range(1, length(needle) - 6)) i from s)),
cg as (select doc_id, idx, j, substr(c, j, 8) g from (select doc_id, idx, left(c, {A.CANDIDATE}) c, unnest(range(1, length(left(c, {A.CANDIDATE})) - 6)) j from e where length(c) >= 8)),
m as (select doc_id, pos, kind, idx, i - j as d, i from ng join cg using (doc_id, g)),
r as (select *, i - row_number() over (partition by doc_id, pos, kind, idx, d order by i) as island from m),
run as (select doc_id, pos, kind, idx, max(n) + 7 as run from (select doc_id, pos, kind, idx, d, island, count(*) n from r group by all) group by all),
p as (select s.doc_id, s.pos, s.kind, e.idx, position, case when contains(c, needle) then 1.0 when contains(needle, c) and length(c) >= 8 then least(0.98, 0.72 + length(c) / length(needle) * 0.25) else coalesce(run, 0) / length(needle) * 0.92 end as score from s join e using (doc_id) left join run on run.doc_id = s.doc_id and run.pos = s.pos and run.kind = s.kind and run.idx = e.idx),
b as (select *, max(score) over (partition by doc_id, pos, kind) best from p)
select doc_id, pos, kind, idx, round(best, 6) as confidence from (select *, row_number() over (partition by doc_id, pos, kind order by abs(position - 0.5), idx) t from b where best >= {A.THRESHOLD} and score >= best - 0.02) where t = 1""",
    "best_page": f"""with {LINES}, k as (select doc_id, pos as page, {KEY('line')} k from lines), t as (select doc_id * 100000 + page as t_id, doc_id, left(k, 70) || '0000000000' as needle from k where page % 7 = 2 and length(k) >= 80),
p as (select t_id, t.doc_id, page, case when contains(k, needle) then length(needle) when contains(k, left(needle, 60)) then 60 when contains(k, left(needle, 24)) then 24 else 0 end m from t join k using (doc_id))
select t_id, doc_id, page, m as match from (select *, row_number() over (partition by t_id order by m desc, page) r from p where m > 0) where r = 1""",
    "figure_pages": f"""with {LINES}, m as (select doc_id, pos as page, case when pos % 2 = 0 then 'Table ' || regexp_extract(line, '(\\d+)', 1) || ' ' || line else line || ' fig. ' || regexp_extract(line, '(\\d+)', 1) end as text from lines where regexp_matches(line, '\\d')),
l as (select doc_id, page, 0 as rank, unnest(regexp_extract_all(text, '(?im)^\\s*(?:figure|fig\\.?|table)[\\s~]*\\d+')) x from m union all select doc_id, page, 1, unnest(regexp_extract_all(text, '(?i)(?:figure|fig\\.?|table)[\\s~]*\\d+')) from m),
k as (select doc_id, case when regexp_matches(x, '(?i)^\\s*table') then 'table' else 'figure' end kind, regexp_extract(x, '(\\d+)$', 1) number, rank, page from l)
select doc_id, kind, number, min(rank) as rank, arg_min(page, rank * 1000000000 + page) as page from k group by doc_id, kind, number""",
    "neighbour_context": f"with {LINES} select doc_id, pos, least(400, coalesce(length(lag(line) over w), 0)) as before, least(400, coalesce(length(lead(line) over w), 0)) as behind from lines window w as (partition by doc_id order by pos)",
    "chunk_pack": f"""with recursive {LINES}, own as (select doc_id, pos, length(line) n, row_number() over (partition by doc_id order by pos) r from lines where trim(line) <> ''),
f as (select doc_id, r, pos, n as used, 0 as batch from own where r = 1 union all select o.doc_id, o.r, o.pos, case when f.used + 2 + o.n <= 4000 then f.used + 2 + o.n else o.n end, case when f.used + 2 + o.n <= 4000 then f.batch else f.batch + 1 end from f join own o on o.doc_id = f.doc_id and o.r = f.r + 1)
select doc_id, cast(batch as bigint) as batch, count(*) n_lines, min(pos) as first from f group by doc_id, batch""",
    "memo_hits": f"with {LINES} select doc_id, pos, {_MEMOKEY('line')} as key, md5('<' || line || '>') as digest from lines where length(line) % 2 = 0",
    "memo_misses": f"with {LINES} select distinct {_MEMOKEY('line')} as key, length(line) as chars from lines where length(line) % 2 = 1",
    "segment_progress": f"with {LINES} select doc_id, count(*) filter (length(line) % 2 = 0) as done, count(*) as total from lines group by doc_id",
}
