"""TeX functions and lint on fixtures, the lint's stack rules against a plain stack."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import tex as X
from quillspark.operators import quality as Q


def run(spark, f, *texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.v for r in d.select("i", f(F.col("text")).alias("v")).orderBy("i").collect()]


def test_symbols_only_in_prose(spark):
    texts = ["let ε > 0 and $ε$ □", r"\[α\] α \begin{align}β\end{align} β", "plain", None, r"5 \$ α \$"]
    assert run(spark, X.symbols_in_prose, *texts) == [r"let $\varepsilon$ > 0 and $ε$ $\square$", r"\[α\] $\alpha$ \begin{align}β\end{align} $\beta$", "plain", None, r"5 \$ $\alpha$ \$"]


def test_repairs(spark):
    cases = {
        r"$\sqrt [ {k} / {a _ { n }} ]$": r"$\sqrt[{k}]{{a _ { n }}}$",
        r"\sqrt[{k}/{x}]{y}": r"\sqrt[{k}/{x}]{y}",
        r"{\sqrt[{k}/{x}}": r"{\sqrt[{k}]{{x}}}",
        r"$\mathbf{ \alpha }$": r"$\boldsymbol{\alpha}$",
        r"$\mathrm{\bar{ x }}$": r"$\overline{\mathrm{x}}$",
        r"a_b $a_b$ \ref{a_b} \_ x": r"a\_b $a_b$ \ref{a_b} \_ x",
        "\\\\\n[word] \\\\[2pt]": "\\\\{}\n[word] \\\\[2pt]",
        "a�b\x01": "ab",
        r"\begin{verbatim}a_b\end{verbatim} c_d": r"\begin{verbatim}a_b\end{verbatim} c\_d",
    }
    assert run(spark, X.repaired, *cases) == list(cases.values())
    long = r"\sqrt[{" + "a" * 100_000 + "}/{b}]"
    assert run(spark, X.repaired, long) == [r"\sqrt[{" + "a" * 100_000 + "}]{{b}}"]


def test_comments(spark):
    texts = ["a % c\n% only\n  % only too\nb \\% c", "x\n\\begin{verbatim}\n% kept\n\\end{verbatim}\n% gone", "%"]
    assert run(spark, X.without_comments, *texts) == ["a\nb \\% c", "x\n\\begin{verbatim}\n% kept\n\\end{verbatim}\n", ""]


def test_balanced_arguments(spark):
    f = lambda c: X.balanced_arguments(c, r"\\caption\*?")
    assert run(spark, f, r"\caption{a {b {c {d}}} \} e} x \caption*{f} \caption{open", "none") == [[r"a {b {c {d}}} \} e", "f"], []]


def test_math_runs(spark):
    shown = lambda c: F.transform(X.math_runs(c), lambda r: F.concat(F.left(r["kind"], F.lit(1)), F.lit(":"), r["text"]))
    texts = ["so $x^2$ and \\(y\\) or \\[ z \\].", "pay $10.99 for Big and $5 more", "cost \\$5 and $n$", "a $ b", "", "$$"]
    want = [["p:so ", "m:x^2", "p: and ", "m:y", "p: or ", "m:z", "p:."], ["p:pay $10.99 for Big and $5 more"], ["p:cost \\$5 and ", "m:n"], ["p:a $ b"], [], ["p:$$"]]
    assert run(spark, shown, *texts) == want
    typed = lambda c: F.transform(X.math_runs(c, True), lambda r: F.concat(F.left(r["kind"], F.lit(1)), F.lit(":"), r["text"]))
    assert run(spark, typed, "$5 \\(x\\) $6") == [["p:$5 ", "m:x", "p: $6"]]


def lint(spark, *texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {i: [] for i in range(len(texts))}
    for r in sorted(Q.delimiter_lint(d).collect()):
        out[r.doc_id].append((r.line, r.message))
    return [out[i] for i in range(len(texts))]


def test_lint(spark):
    got = lint(
        spark,
        "fine {a} $x$ \\% 5\\& % } $\n\\begin{tabular}a & b\\end{tabular}",
        "x }\n{ {\n",
        "\\begin{a}\n\\begin{b}\n\\end{a}\n\\end{c}\\end{d}",
        "a & b\n$x\ny",
        "$x \\( y$ \\] \x02",
        "\\begin{verbatim} } & $ \\end{verbatim} \\verb|}| 😀",
        "$$a$$ $b$$c$ ${$",
        None,
    )
    assert got[0] == [] and got[7] == []
    assert got[1] == [(1, "unbalanced braces: unexpected '}'"), (2, "unbalanced braces: 2 opening brace(s) remain")]
    assert got[2] == [(3, "environment mismatch: expected end{b}, got end{a}"), (4, "environment 'd' ends without a matching begin"), (4, "environment mismatch: expected end{a}, got end{c}")]
    assert got[3] == [(1, "bare '&' outside an alignment/table environment"), (2, "unbalanced '$' (opening delimiter is not closed)")]
    assert got[4] == [(1, "math delimiter '\\(' is nested or mismatched"), (1, "math delimiter '\\]' has no matching opener"), (1, "unsafe C0 control character U+0002")]
    assert got[5] == [(1, "font-unsafe character '😀' (U+1F600)")]
    assert got[6] == [(1, "unbalanced braces in math region (depth +1)"), (1, "unbalanced braces: 1 opening brace(s) remain")]


@pytest.mark.parametrize("seed", range(3))
def test_lint_equals_a_stack(spark, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(["{", "}", "\n", "a", "\\{", "\\begin{t}", "\\end{t}", "\\begin{u}", "\\end{u}", "&", "\\begin{array}", "\\end{array}"]) for _ in range(r.randrange(1, 30))) for _ in range(40)]
    import re

    want = []
    for t in texts:
        out, line, braces, envs = set(), 1, [], []
        for m in re.finditer(r"\\(begin|end)\{(\w+)\}|\\.|[{}&\n]|[^\\{}&\n]+", t):
            s = m[0]
            if s == "\n":
                line += 1
            elif m[1] == "begin":
                envs.append((m[2], line))
            elif m[1] == "end":
                if not envs:
                    out.add((line, f"environment '{m[2]}' ends without a matching begin"))
                else:
                    n, _ = envs.pop()
                    if n != m[2]:
                        out.add((line, f"environment mismatch: expected end{{{n}}}, got end{{{m[2]}}}"))
            elif s == "{":
                braces.append(line)
            elif s == "}":
                if braces:
                    braces.pop()
                else:
                    out.add((line, "unbalanced braces: unexpected '}'"))
            elif s == "&" and not any(n == "array" for n, _ in envs):
                out.add((line, "bare '&' outside an alignment/table environment"))
        if braces:
            out.add((braces[-1], f"unbalanced braces: {len(braces)} opening brace(s) remain"))
        out |= {(at, f"environment '{n}' is not closed") for n, at in envs}
        want.append(sorted(out))
    assert lint(spark, *texts) == want


def test_stray_braces(spark):
    d = spark.createDataFrame([(1, "a}b{c}}\n}d"), (2, "fine {x}"), (3, None), (4, "}")], "doc_id int, text string")
    assert {(r.doc_id, r.text, r.removed) for r in Q.stray_braces_removed(d).collect()} == {(1, "ab{c}\nd", 3), (2, "fine {x}", 0), (3, None, 0), (4, "", 1)}


def test_audit_and_coverage(spark):
    lines = spark.createDataFrame([(1, r"a_b \sqrt[{k}/{x}] �"), (1, "c_d_e"), (2, "none")], "doc_id int, line string")
    assert {tuple(r) for r in Q.rewrite_audit(lines).collect()} == {(1, "underscore", 2, 3), (1, "sqrt_index", 1, 1), (1, "replacement_sign", 1, 1)}
    docs = spark.createDataFrame([(1, "α ≤ é 中 ， 😀 ☃ ☃ \u2003"), (2, None), (3, "$α$ β")], "doc_id int, text string")
    assert {tuple(r) for r in Q.uncovered(docs).collect()} == {("😀", "U+1F600", 1), ("☃", "U+2603", 2)}
    assert {tuple(r) for r in Q.mapped_in_prose(docs).collect()} == {("α", 1), ("≤", 1), ("β", 1)}


def test_repairs_of_whole_sources(spark):
    texts = ["x_y\n\\begin{align}\na_i\n\\end{align}\n\\mathbf{\n\\beta}\nu_v_w", "\\\\\n[word] \\sqrt[{k}/{x}] \\sqrt[{a}/{b}]\n\n\ufffd\ufffd", None, "", "fine \\_ $a_b$"]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, rule string")
    got = {tuple(r) for r in Q.repairs(d, Q.rule_rows(spark)).collect()}
    assert got == {(0, "underscore", 1, 1), (0, "bold_greek", 5, 1), (0, "underscore", 6, 2), (1, "break_bracket", 1, 1), (1, "sqrt_index", 2, 2), (1, "replacement_sign", 4, 2)}
    own = spark.createDataFrame([(1, "second", "b+", "c"), (0, "first", "a", "b")], "nth int, name string, pattern string, replacement string")
    one = spark.createDataFrame([(1, "x\nab a")], "doc_id int, text string")
    assert {tuple(r) for r in Q.repairs(one, own).collect()} == {(1, "first", 2, 2), (1, "second", 2, 2)}
