"""Structure, reference, log, include and edit operators on small fixtures."""

from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import align as A
from quillspark.operators import library as B
from quillspark.operators import lines as L
from quillspark.operators import progress as P
from quillspark.operators import retrieve as R
from quillspark.operators import search as S
from quillspark.operators import segmentwork as G
from quillspark.operators import structure as D
from quillspark.sources import tables as T


def one(spark, expr, schema="x string", *row):
    return spark.createDataFrame([row], schema).select(expr.alias("r")).first()["r"]


def test_scalar_functions(spark):
    f = lambda e, s: one(spark, e(F.col("x")), "x string", s)
    assert f(X.match_key, "Ab-1 图é") == "ab1图"
    assert f(X.collapse, "\u00a0a \n\t b ") == "a b"
    assert f(X.plain, r"# A **b** $x^2$ \cite{k} \textbf{c} 5\% ![i](u)") == "A b c 5%"
    assert f(X.strip_markers, "a\n[MISSING_PAGE_FAIL:1]\n\n\n\nb") == "a\n\nb"
    assert f(X.is_heading, "2.1 Results") and f(X.is_heading, "Related Work") and f(X.is_heading, "ABCD") and not f(X.is_heading, "A plain line") and not f(X.is_heading, "1234")
    assert f(X.tokens, "The the a 图图 x_1") == ["the", "图", "x_1"]
    assert tuple(f(X.caption_label, "see Fig. 3: x")) == ("figure", 3) and tuple(f(X.caption_label, "表 2")) == ("table", 2) and f(X.caption_label, "none") is None
    assert f(X.labelled_suffix, "(a) left Figure 4: all") == "Figure 4: all"
    assert f(X.file_kind, "a/b.TEX") == "tex" and f(X.file_kind, "a/b") == "other"
    assert f(X.escape_tex, r"a_b \$5 & $") == r"a\_b \$5 \& \$"
    assert one(spark, X.display_title(F.col("x"), F.lit("p.pdf")), "x string", "t\n# Name \n") == "Name" and one(spark, X.display_title(F.col("x"), F.lit("p.pdf")), "x string", "t") == "p"
    assert f(lambda x: X.json_object(x).cast("string"), '```json\n{"a":1}\n```') == '{"a":1}' and f(lambda x: X.json_object(x).cast("string"), 'ok {"a":1} end') == '{"a":1}' and f(lambda x: X.json_object(x).cast("string"), "no") is None
    text = r"\begin{figure*} a <b>x</b> $m$ \cite{q} https://e.org/x end"
    m = f(X.mask, text)
    assert "$" not in m["masked"] and len(m["spans"]) == 6
    back = spark.createDataFrame([(text,)], "x string").withColumn("m", X.mask("x")).select(X.unmask(F.col("m.masked"), F.col("m.spans")).alias("r")).first()["r"]
    assert back == text
    d = f(X.split_document, "p\\begin{document}b\\end{document}t")
    assert tuple(d) == ("p\\begin{document}", "b", "\\end{document}t") and f(X.split_document, "none") is None
    meta = F.create_map(F.lit("title"), F.lit("Deep Nets"), F.lit("authors"), F.lit("Ann Lee, B C"), F.lit("year"), F.lit("2020"), F.lit("venue"), F.lit("J"))
    assert one(spark, X.bibtex_entry(meta), "x string", "") == "@article{lee2020deep,\n  title = {Deep Nets},\n  author = {Ann Lee, B C},\n  year = {2020},\n  journal = {J}\n}"


def test_lines_and_running_headers(spark):
    d = spark.createDataFrame([(1, "Head\na\nhead \nb\n"), (2, ""), (3, None)], "doc_id long, text string")
    lines = L.lines(d)
    assert [(r.pos, r.line) for r in lines.where("doc_id = 1").orderBy("pos").collect()] == [(0, "Head"), (1, "a"), (2, "head "), (3, "b")]
    assert [r.line for r in L.without_repeated(lines).where("doc_id = 1").orderBy("pos").collect()] == ["a", "b"]


def test_references(spark):
    text = "x\nReferences\nshort\n[1] First ref\nmore\n\nA long unlabelled line here\ncont\n2. Second"
    lines = L.lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [(r["index"], r.text) for r in D.bibliography(lines).orderBy("index").collect()] == [(1, "First ref more"), (2, "A long unlabelled line here cont"), (3, "Second")]
    b = spark.createDataFrame([(1, 0, "title", "T"), (1, 1, "paragraph", "p"), (1, 2, "title", " References "), (1, 3, "paragraph", "r"), (1, 4, "title", "App"), (1, 5, "reference_list", ""), (1, 6, "paragraph", "x")], "doc_id long, pos long, kind string, text string")
    assert [r.translatable for r in D.translatable(b).orderBy("pos").collect()] == [True, True, False, False, True, False, False]


def test_layout(spark):
    b = spark.createDataFrame([(1, 0, "title", "T"), (1, 1, "paragraph", "intro"), (1, 2, "paragraph", "Ann, Some University"), (1, 3, "paragraph", "B Institute"), (2, 0, "paragraph", "X University")], "doc_id long, pos long, kind string, text string")
    assert [tuple(r) for r in D.authors(b).collect()] == [(1, 2)]
    kinds = ["A. Research Laboratory Inc.", "B, Senior Member, IEEE", "C<sup>1</sup>", "D (corresponding author)", "E, Department of F", "G Academy"]
    told = spark.createDataFrame([row for k, t in enumerate(kinds) for row in ((k, 0, "title", "T"), (k, 1, "paragraph", t))], "doc_id long, pos long, kind string, text string")
    assert sorted(r.doc_id for r in D.authors(told).collect()) == [1, 2, 3, 4]
    box = "doc_id long, pos long, kind string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>"
    p = spark.createDataFrame([(1, 0, "image", 0, (100.0, 500.0, 400.0, 700.0)), (1, 1, "image", 0, (420.0, 505.0, 800.0, 700.0)), (1, 2, "paragraph", 0, None), (1, 3, "image", 0, (810.0, 505.0, 900.0, 700.0))], box)
    g = [r.group for r in D.panels(p).orderBy("pos").collect()]
    assert g[0] == g[1] != g[2]
    c = one(spark, D.group_caption(F.col("x")), "x string", "(a) left. Figure 4: all")
    assert tuple(c) == ("(a) left.", "Figure 4: all")
    f = spark.createDataFrame([(1, 0, "table", True, "one"), (1, 1, "figure", False, None), (1, 2, "figure", True, "two")], "doc_id long, pos long, kind string, numbered boolean, caption string")
    assert [r.text for r in D.float_numbers(f).orderBy("pos").collect()] == ["Table 1: one", "Figure", "Figure 1: two"]
    t = spark.createDataFrame([(1, 10.0, 100.2, 20.0, 10.0, "a"), (1, 32.0, 99.8, 10.0, 10.0, "b"), (1, 200.0, 100.0, 5.0, 12.0, "far"), (1, 10.0, 50.0, 5.0, 9.0, "next")], "page int, x double, y double, width double, size double, text string")
    assert sorted(r.text for r in D.text_lines(t).collect()) == ["a b", "far", "next"]
    assert D.body_size(t).first()["body"] == 10.0
    cols = spark.createDataFrame([(1, "paragraph", x, x + 200.0) for x in (0.0, 0.0, 0.0, 500.0, 500.0, 500.0)] + [(2, "paragraph", 0.0, 900.0)] * 7, "doc_id long, kind string, x0 double, x1 double")
    assert {r.doc_id: r.two_column for r in D.two_column(cols).collect()} == {1: True, 2: False}


def test_outline_filter(spark):
    rows = [("1 Intro", 12.0), ("A Early letter", 12.0), ("1.2 Deep part", 12.0), ("1.2 Deep part", 12.0), ("text", 10.0), ("References", 12.0), ("2 Gone", 12.0), ("A Proofs", 12.0), ("B.1 More", 12.0), ("NeurIPS Paper Checklist", 12.0), ("C After", 12.0)]
    d = spark.createDataFrame([(1, 0, i, t, s, 10.0) for i, (t, s) in enumerate(rows)], "doc_id long, page long, pos long, text string, size double, body double")
    got = [(r.title, r.level) for r in D.outline_headings(d).orderBy("pos").collect()]
    assert got == [("1 Intro", 1), ("1.2 Deep part", 2), ("References", 1), ("A Proofs", 1), ("B.1 More", 2)]
    tree = L.outline(D.outline_headings(d).select("doc_id", "pos", "level"))
    assert {r.pos: r.parent for r in tree.collect()} == {0: None, 2: 0, 5: None, 7: None, 8: 7}


def test_logs(spark):
    rows = ["! Undefined control sequence.", "x", "l.740 bad", "./main.tex:12: Missing $", "other.tex:9: no", "main.tex:9999999: no", "Missing character: There is no ★ (U+2605) in font", "Missing character: There is no ★ (U+2605) in font", "! Undefined control sequence.", "l.740 again"]
    d = spark.createDataFrame([(1, "main.tex", i, t) for i, t in enumerate(rows)], "log_id long, compiled_name string, line_no long, line string")
    assert {(r.line, r.message) for r in D.log_errors(d).collect()} == {(740, "Undefined control sequence."), (12, "Missing $")}
    g = D.missing_glyphs(d, spark.createDataFrame([("★", r"\bigstar")], "ch string, suggest string"))
    assert [tuple(r) for r in g.collect()] == [("★", 1, "U+2605", 2, r"\bigstar")] or [(r.ch, r.n, r.suggest) for r in g.collect()] == [("★", 2, r"\bigstar")]


def test_includes(spark):
    files = [("main.tex", "", "a\n\\input{sec/one}\n% \\input{sec/two}\n\\input{none}"), ("sec/one.tex", "sec", "one\n\\include{two.tex}"), ("sec/two.tex", "sec", "two"), ("loop.tex", "", "\\input{loop}")]
    out = {r.path: r.text for r in D.include_closure(spark.createDataFrame(files, "path string, folder string, text string")).collect()}
    assert out["main.tex"] == "a\none\ntwo\n% \\input{sec/two}\n\\input{none}" and out["loop.tex"] == "\\input{loop}"


def plain_closure(files, path, depth=8, way=()):
    """A file's text with its includes in place, by plain recursion."""
    import posixpath
    import re

    text, way = files[path][1], (*way, path)

    def put(m):
        if re.search(r"(?<!\\)%", text[text.rfind("\n", 0, m.start()) + 1 : m.start()]):
            return m[0]
        name = m[1].strip()
        at = posixpath.normpath(posixpath.join(files[path][0], name if name.lower().endswith(".tex") else name + ".tex"))
        if at not in files or at in way or len(way) > depth:
            return m[0]
        return plain_closure(files, at, depth, way) or m[0]

    return re.sub(r"\\(?:input|include)\s*\{([^}]+)\}", put, text)


CLOSURES = {
    "cycle": {"main.tex": "m \\input{a} n", "a.tex": "A text.\\input{b}\n", "b.tex": "B text.\\input{a}\n", "self.tex": "\\include{self}x"},
    "comments": {"main.tex": "% \\input{draft}\n100\\% \\input{real}\n\\% % \\input{real}\nx\\input{real}y\\input{ real.TEX }", "real.tex": "Real.", "draft.tex": "Draft", "real.TEX": "other"},
    "folders": {"main.tex": "\\input{sec/one}\\include{./sec/two.tex}", "sec/one.tex": "1\\input{deep/x}\\input{../top}", "sec/deep/x.tex": "x\\input{../two}", "sec/two.tex": "", "top.tex": "T\\input{main}"},
    "deep": {f"f{i}.tex": f"{i}(\\input{{f{i + 1}}})" for i in range(12)},
    "diamond": {"main.tex": "\\input{a}|\\input{b}|\\input{a}", "a.tex": "a[\\input{c}]", "b.tex": "b[\\input{c}]", "c.tex": "c"},
}


def test_includes_equal_a_plain_recursion(spark):
    files = {f"{k}/{p}": (f"{k}/{p}".rpartition("/")[0], t) for k, group in CLOSURES.items() for p, t in group.items()}
    rows = [(p, f, t) for p, (f, t) in files.items()] + [("none.tex", "", None)]
    got = {r.path: r.text for r in D.include_closure(spark.createDataFrame(rows, "path string, folder string, text string")).collect()}
    assert got == {p: plain_closure(files, p) for p in files} | {"none.tex": None}
    assert got["cycle/main.tex"] == "m A text.B text.\\input{a}\n\n n" and got["deep/f0.tex"].count("(") == 9


def test_edits(spark):
    lines = spark.createDataFrame([(d, i + 1, t) for d in (1, 2, 3) for i, t in enumerate(["a", "b", "c", "d"])], "doc_id long, line_no long, line string")
    edits = spark.createDataFrame([(1, 1, 1, 2, "b\nc", "B\nX\nC"), (1, 2, 4, 4, "d", "D"), (2, 1, 1, 1, "a", "\\input{/etc/x}"), (3, 1, 1, 2, "a\nb", "q"), (3, 2, 2, 2, "b", "r")], "doc_id long, edit long, start_line long, end_line long, original string, replacement string")
    new, rejects = D.apply_edits(lines, edits)
    got = {}
    for r in new.orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r.line)
    assert got == {1: ["a", "B", "X", "C", "D"], 2: ["a", "b", "c", "d"], 3: ["a", "b", "c", "d"]}
    assert {(r.doc_id, r.edit): r.reason for r in rejects.collect()} == {(2, 1): "command", (3, 2): "overlap"}


def test_manifest(spark):
    m = spark.createDataFrame([(1, "a/main.tex", 10), (1, "A/MAIN.tex", 5), (1, "../x", 1), (1, "C:\\x", 1), (1, "a", 3), (2, "fig.png", 30_000_000)], "archive long, path string, size long")
    assert {(r.path, r.reason) for r in B.unsafe_paths(m).collect()} == {("../x", "parent"), ("C:\\x", "drive")}
    assert {(r.path, r.reason) for r in B.manifest_conflicts(m).collect()} == {("a/main.tex", "duplicate"), ("A/MAIN.tex", "duplicate"), ("a", "folder")}
    assert {r.archive: r.ok for r in B.manifest_budget(m).collect()} == {1: True, 2: False}
    f = spark.createDataFrame([("p", "sub/main.tex", True), ("p", "paper.tex", True), ("p", "a.tex", False)], "project string, path string, has_class boolean")
    assert [tuple(r) for r in B.main_files(f).collect()] == [("p", "sub/main.tex")]
    bib = spark.createDataFrame([("p", "a.bib", "x/main.tex"), ("p", "main.bib", "x/main.tex"), ("q", "b.bib", "m.tex"), ("q", "a.bib", "m.tex")], "project string, path string, main string")
    assert {r.project: r.path for r in D.preferred_bib(bib).collect()} == {"p": "main.bib", "q": "a.bib"}


def test_locate(spark):
    e = [(1, 0, 0.05, "The same phrase stands here twice"), (1, 1, 0.85, "The same phrase stands here twice"), (1, 2, 1.0, "Something else entirely, of other words"), (2, 0, 0.0, "abcdefghijklmnopqrstuvwxyz0123456789")]
    entries = spark.createDataFrame(e, "doc_id long, idx long, position double, original string")
    s = [(1, 1, "same phrase stands", 0.85), (2, 1, "zzzz qqqq unrelated 999", 0.5), (3, 2, "xx abcdefghijklmnopqrstuvw yy", 0.0), (4, 1, "", 0.1), (5, 1, "phrase", 0.0)]
    got = {r.n_id: (r.idx, round(r.confidence, 3)) for r in A.locate(spark.createDataFrame(s, "n_id long, doc_id long, selected string, page_ratio double"), entries).collect()}
    assert got == {1: (1, 1.0), 3: (0, round(23 / 27 * 0.92, 3)), 5: (0, 1.0)}
    src = "First sentence here. Second sentence here. Third sentence now. Fourth one."
    tgt = "Eins Satz hier. Zwei Satz hier. Drei Satz jetzt. Vier da."
    h = lambda a, b, c: one(spark, D.highlight(F.col("a"), F.col("b"), F.col("c")), "a string, b string, c string", a, b, c)
    assert h(src, src, tgt) == tgt and h("", "x", tgt) == "" and "Drei Satz jetzt." in h(src, "Third sentence now", tgt) and "Eins" not in h(src, "Third sentence now", tgt)


def test_captions(spark):
    b = spark.createDataFrame([(1, 0, "(a) Figure 1: cat", 3), (1, 2, "Table 2. dogs", 3)], "doc_id long, pos long, caption string, n_blocks long")
    c = spark.createDataFrame([(1, 0, "图 1 猫"), (1, 1, "图1 猫二"), (1, 2, "表 2 狗")], "doc_id long, pos long, caption string")
    assert [(r.original, r.translated) for r in A.caption_pairs(b, c).orderBy("index").collect()] == [("Figure 1: cat", "图1 猫二"), ("Table 2. dogs", "表 2 狗")]
    f = spark.createDataFrame([(1, "figure", 1, 9), (1, "figure", 7, 4)], "doc_id long, kind string, number long, page long")
    p = spark.createDataFrame([(1, 1, "as Figure 1 shows"), (1, 2, "x\nFigure 1. Cat"), (1, 3, "Figure 10: no")], "doc_id long, page long, text string")
    assert {r.number: r.page for r in A.caption_pages(f, p).collect()} == {1: 2, 7: 4}


def test_lead_repair(spark):
    body = "The model is trained on many pages of text and then tested on others of the same kind in a second step."
    lead = "An opening paragraph that only the other extraction has, with enough letters."
    d = spark.createDataFrame([(1, body, lead + "\n" + body), (2, body, body), (3, "", "x")], "doc_id long, primary string, fallback string")
    got = {r.doc_id: (r.text, r.recovered) for r in D.recovered_lead(d).collect()}
    assert got[1] == (lead + "\n\n" + body, True) and got[2] == (body, False) and got[3] == ("", False)
    # A lead of 50,000 words costs no stack.
    long = " ".join(f"word{k}" for k in range(50_000)) + "."
    r = D.recovered_lead(spark.createDataFrame([(1, body, "- " + long + " – " + body)], "doc_id long, primary string, fallback string")).first()
    assert r.recovered and r.text == "- " + long + " –\n\n" + body


def test_segments_and_translation(spark):
    i = lambda s, t: one(spark, G.issues(F.col("s"), F.col("t")), "s string, t string", s, t)
    assert i("a", "b") == [] and i("a", " ") == ["empty"] and i("a", "x\x01") == ["control"] and i("a __PR_PH_0000__", "a") == ["placeholder"] and i("a", "$5") == ["dollar"]
    assert i("a", "<b>a") == ["tag"] and i("a", "As an AI language model") == ["meta"] and i("a", "x" * 801) == ["expansion"] and i("a", "```") == ["code_fence"]
    assert one(spark, G.repair(F.col("s"), F.col("t")), "s string, t string", r"\$5", "$5�") == r"\$5"
    assert one(spark, G.cut_long(F.col("x"), 10), "x string", "aaaa bbbb cccc dddd") == ["aaaa bbbb", "cccc dddd"]
    seg = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, "bad")], "id long, line string")
    memo = seg.where("id = 2").select(X.memo_key("line").alias("key"), F.lit("ZWEI").alias("value"))

    def work(t):
        if "bad" in t:
            raise ValueError("chunk 3 failed")
        return t.upper()

    values, rejects = G.translate(seg, memo, work)
    assert sorted(r.value for r in values.collect()) == ["ONE", "ZWEI"]
    assert [(r.source, r.error) for r in rejects.collect()] == [("bad", "chunk 3 failed")]
    b = G.greedy_batches(spark.createDataFrame([(1, 0, 5), (1, 1, 4), (1, 2, 30), (1, 3, 1)], "k long, o long, n long"), "k", "o", F.col("n"), 11, 2)
    assert [r.batch for r in b.orderBy("o").collect()] == [0, 0, 1, 2]


def test_search_edges(spark):
    d = spark.createDataFrame([(1, "original", 2, "abc target"), (1, "translated", 1, "Target, first"), (2, "original", 2, None)], "doc_id long, side string, priority int, text string")
    q = spark.createDataFrame([(1, "TARGET"), (2, "--"), (3, "zzz")], "item_id long, text string")
    assert [(r.item_id, r.doc_id, r.side) for r in S.library_search(d, q).collect()] == [(1, 1, "translated")]
    assert S.library_search(d, q.where("item_id = 2")).count() == 0
    b = spark.createDataFrame([(1, 0, "aaaa")], "doc_id long, pos long, line string")
    assert [r.at for r in S.find_all(b, "aa").orderBy("at").collect()] == [0, 1, 2]


def test_retrieval_keeps_block_zero(spark):
    blocks = R.retrieval_blocks(spark.createDataFrame([(1, "\n\n".join(["zero block without any hits"] + [f"hit word number {i} in the block" for i in range(5)]))], "doc_id long, text string"))
    q = spark.createDataFrame([(9, "hit word")], "q_id long, question string")
    got = R.rank_blocks(q, blocks, spark.createDataFrame([(9, 1)], "q_id long, doc_id long"))
    assert sorted((r.place, r.idx) for r in got.collect()) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    a = spark.createDataFrame([(1, "as [P1] and 【W2】 say [P1]")], "answer_id long, answer string")
    s = spark.createDataFrame([(1, "P1", "doc")], "answer_id long, label string, title string")
    assert {(r.label, r.title) for r in R.citations(a, s).collect()} == {("P1", "doc"), ("W2", None)}


def test_sources(spark, tmp_path):
    d = spark.createDataFrame([(1, '[[{"type":"title"},5],[{"type":"p"}]]'), (2, '[{"type":"x"}]'), (3, "{bad"), (4, '{"a":1}')], "doc_id long, payload string")
    got = {(r.doc_id, r.page, r.pos, r.t) for r in T.block_json(d).selectExpr("doc_id", "page", "pos", "variant_get(block, '$.type', 'string') t").collect()}
    assert got == {(1, 0, 0, "title"), (1, 1, 0, "p"), (2, -1, 0, "x")}
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    T.publish(rows, str(tmp_path / "t"), "k")
    T.publish(rows.where("k = 'a'").withColumn("v", F.lit(9).cast("long")), str(tmp_path / "t"), "k")
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 9), ("b", 2)}
    T.write_texts(spark.createDataFrame([("d1", "x\ny")], "document_id string, text string"), str(tmp_path / "n"))
    assert T.manifest(spark, str(tmp_path / "n")).where("path like '%document_id=d1%'").count() == 1


def test_capped_mean_is_the_fold(spark):
    import random

    r = random.Random(4)
    xs = [r.random() for _ in range(57)]
    avg = 0.0
    for n, x in enumerate(xs, 1):
        avg += (x - avg) / min(n, 20)
    got = P.capped_mean(spark.createDataFrame([("k", i, x) for i, x in enumerate(xs)], "k string, o long, x double"), "k", "x", ["o"]).first()
    assert abs(got["avg"] - avg) < 1e-9 and got["n"] == 57


def test_fallback_and_notes(spark):
    src = spark.createDataFrame([(1, i, t) for i, t in enumerate(["first block of the text", "second block about cats", "third part on dogs", "fourth end"])], "doc_id long, idx long, text string")
    tgt = spark.createDataFrame([(1, i, t) for i, t in enumerate(["eins", "# zwei", "drei"])], "doc_id long, idx long, text string")
    sel = spark.createDataFrame([(1, 1, "BLOCK about", 0.0), (2, 1, "third part of dogz", 0.0), (3, 1, "", 1.0), (4, 1, "QQQQ", 0.5)], "n_id long, doc_id long, selected string, page_ratio double")
    got = {r.n_id: (r.source_idx, r.idx, r.target) for r in A.locate_without_alignment(sel, src, tgt).collect()}
    assert got == {1: (1, 1, "zwei"), 2: (2, 1, "zwei"), 3: (3, 2, "drei"), 4: (2, 1, "zwei")}
    e = spark.createDataFrame([(1, 0, 0.0, "a phrase to be quoted here", "ein **Satz**")], "doc_id long, idx long, position double, original string, translated string")
    a = spark.createDataFrame([(2, 1, 3, "phrase to be quoted", "mine", 0.0, "2024-01-02"), (1, 1, 1, "unknown words 77", None, 0.0, "2024-01-01")], "id long, doc_id long, page int, quote string, note string, position_ratio double, created_at string")
    assert A.notes(a, e).first()["text"] == "## 1. 第 1 页\n\n> unknown words 77\n\n## 2. 第 3 页\n\n> phrase to be quoted\n\n译文：ein Satz\n\n**笔记**：mine"


def test_names_and_failures(spark):
    n = lambda a, b: one(spark, X.display_filename(F.col("a"), F.col("b")), "a string, b string", a, b)
    assert n(" my:paper.txt ", "x.PDF") == "my_paper.pdf" and n("plain", "x.md") == "plain.pdf" and n("a/b", "x.pdf") is None and n(" . ", "x.pdf") is None and n("a.md", "b.md") == "a.md"
    f = one(spark, X.failure(F.lit("translate"), F.col("x"), F.lit(True)), "x string", "Chunk 12 failed")
    assert tuple(f) == ("translate", "Chunk 12 failed", 12, True)
    g = D.glossary_misses(spark.createDataFrame([(1, "cat", "Katze")], "doc_id long, source string, target string"), spark.createDataFrame([(1, "A cat", "Katze"), (1, "Cats", "Hund"), (1, "dog", "x")], "doc_id long, original string, translated string"))
    assert [(r.used, r.missed) for r in g.collect()] == [(2, 1)]


def test_windows_grow_and_fall_back(spark):
    rows = [(1, k, "\\begin{document}" if k == 2 else "x") for k in range(100)] + [(2, k, "y") for k in range(5)]
    blocks = spark.createDataFrame(rows, "doc_id long, pos long, line string")
    anchors = spark.createDataFrame([(1, 50)], "doc_id long, pos long")
    at = lambda **k: sorted((r.doc_id, r.pos) for r in L.context_windows(blocks, anchors, 2, **k).collect())
    assert at() == [(1, k) for k in range(48, 53)] and at(turn=3) == [(1, k) for k in range(42, 59)]
    assert at(whole=True, preamble=True) == [(1, k) for k in (0, 1, 2, *range(48, 53))] + [(2, k) for k in range(5)]


def test_pages_and_quotes_fall_back(spark):
    pages = spark.createDataFrame([(1, 0, "aaaa" * 20), (1, 1, "bcdefghijklmnopqrstuvwxyz" * 4)], "doc_id long, page long, key string")
    asked = [(1, 1, "bcdefghijklmnopqrstuvwxyz", "", 0), (2, 1, "nothere" * 3, "aaaa" * 6 + "zz", 1), (3, 1, "nothere" * 3, "norhere" * 3, 7)]
    t = spark.createDataFrame(asked, "t_id long, doc_id long, highlight string, block string, hint long")
    assert sorted(tuple(r) for r in A.page_of(t, pages).collect()) == [(1, 1, 1, 25), (2, 1, 0, 24), (3, 1, 7, 0)]
    text = "".join(chr(97 + (k * 7) % 26) + str(k) for k in range(100))
    blocks = spark.createDataFrame([(1, 0, text[:50] + " -"), (1, 1, text[50:])], "doc_id long, pos long, line string")
    quotes = [(1, 1, text[40:60]), (2, 1, text[10:170] + "lost"), (3, 1, text[5:70] + "lost"), (4, 1, text[:30] + "lost"), (5, 1, "lost" * 9), (6, 1, text[:5])]
    q = spark.createDataFrame(quotes, "q_id long, doc_id long, quote string")
    assert sorted(tuple(r) for r in S.quote_places(blocks, q).collect()) == [(1, 1, 40, 60), (2, 1, 10, 150), (3, 1, 5, 65), (4, 1, 0, 24)]


def test_times(spark):
    t = one(spark, X.iso_time(F.col("x").cast("timestamp")), "x string", "2024-02-01T10:00:00.5+02:00")
    assert t == "2024-02-01T08:00:00.500000+00:00"
    assert one(spark, F.unix_seconds(X.from_iso("x")), "x string", "1970-01-01T00:00:10") == 10 and one(spark, X.from_iso("x"), "x string", "soon") is None
    assert one(spark, F.date_diff(X.expiry(F.col("x").cast("timestamp"), 7), "x"), "x string", "2024-01-01") == 7
    assert one(spark, X.eta_text(F.col("x")), "x double", 61.0) == "1m 1s" and one(spark, X.eta_text(F.col("x")), "x double", 41.2) == "41s" and one(spark, X.eta_text(F.col("x")), "x double", None) == "—"


def test_imports_and_deletions(spark):
    a, b, c = (f"0000000{k}-0000-4000-8000-000000000000" for k in range(3))
    files = spark.createDataFrame([(f"file:/x/{a}/original.pdf", 5), (f"file:/x/{b}/original.pdf", 0), (f"file:/x/{b}/translated.pdf", 9), (f"file:/x/{c}/original.pdf", 7), ("file:/x/notes/original.pdf", 7)], "path string, size long")
    known = spark.createDataFrame([(c,)], "document_id string")
    plan = T.import_plan(files, known)
    assert sorted(tuple(r) for r in plan.collect()) == [(a, "would import"), (b, "no readable original"), (c, "already indexed")]
    rows, gone = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string"), spark.createDataFrame([(2,), (3,)], "id long")
    assert sorted(tuple(r) for r in T.deletions(rows, gone, ["id"]).collect()) == [(2, True), (3, False)] and T.deleted(rows, gone, ["id"]).count() == 1
    two = [T.block_json(spark.createDataFrame([(k, "[{\"a\": 1}]" * 1)], "doc_id long, payload string")) for k in (1, 2)]
    assert [t.first()["doc_id"] for t in two] == [1, 2]


def test_tex_rendering_titles_and_toggles(spark):
    from quillspark.functions import tex

    b = spark.createDataFrame([(1, 0, "title", 1, "A & B"), (1, 1, "item", None, "x"), (1, 2, "item", None, "y_1"), (1, 3, "paragraph", None, "end"), (2, 0, "item", None, "z")], "page_id long, pos long, kind string, level long, text string")
    heads = spark.createDataFrame([(1, "T", "Ann")], "page_id long, title string, authors string")
    got = {r.page_id: r.tex for r in L.render_tex(b, heads).collect()}
    assert got[1] == "\\title{T}\n\\author{Ann}\n\\maketitle\n\n\\section{A \\& B}\n\n\\begin{itemize}\n\\item x\n\\item y\\_1\n\\end{itemize}\n\nend"
    assert got[2] == "\\begin{itemize}\n\\item z\n\\end{itemize}"
    assert one(spark, tex.title("x"), "x string", r"\title{Deep \textbf{Nets} \\ on {Text}} rest") == "Deep Nets on Text" and one(spark, tex.title("x"), "x string", "none") is None
    assert one(spark, X.caption_text(F.split("x", ";")), "x string", "Fig 1 ;a;Fig 1; ") == "Fig 1 a"
    assert one(spark, X.toggled(F.split("x", ","), F.lit("b")), "x string", "a,b") == ["a"] and one(spark, X.toggled(F.split("x", ","), F.lit("b")), "x string", "a") == ["a", "b"]
    members = spark.createDataFrame([("z", "__MACOSX/../x"), ("z", "a/.DS_Store"), ("z", "../y")], "archive string, path string")
    assert [r.path for r in B.unsafe_paths(members).collect()] == ["../y"]
    levels = spark.createDataFrame([(4, 3.33, True), (8, 9.0, False)], "level long, rps double, is_best boolean")
    assert [tuple(r) for r in P.recommended(levels, "level").collect()] == [(4, 3.0)]
