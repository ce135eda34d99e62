"""Prose and mathematics apart, and arguments in braces, against plain readings."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import tex as X
from quillspark.functions import texscan


def plain_runs(text, typed=False):
    """A reading sign by sign, with each rule where it is stated."""
    out, told, i = [], 0, 0

    def slashes(k):
        n = 0
        while k - n > 0 and text[k - n - 1] == "\\":
            n += 1
        return n

    while i < len(text):
        two = text[i : i + 2]
        if text[i] == "$" and not typed and slashes(i) % 2 == 0:
            begin = end = i + 1
            while end < len(text) and text[end] != "\n" and not (text[end] == "$" and slashes(end) % 2 == 0):
                end += 1
            if end == len(text) or text[end] == "\n":
                i += 1
                continue
            inner, size = text[begin:end].strip(), 1
            bad = "\\[" in inner or "\\(" in inner or (re.match(r"\d", inner) and len(re.findall("[A-Za-z]{2,}", inner)) >= 2)
        elif two in ("\\[", "\\("):
            begin, size = i + 2, 2
            end = text.find("\\]" if two == "\\[" else "\\)", begin)
            if end < 0:
                i += 2
                continue
            inner = text[begin:end].strip()
            bad = "\\" in inner or "$" in inner
        else:
            i += 1
            continue
        if not inner:
            i = end + size
        elif bad:
            i = begin
        else:
            if text[told:i]:
                out.append({"kind": "prose", "text": text[told:i]})
            out.append({"kind": "math", "text": inner})
            told = i = end + size
    return out + ([{"kind": "prose", "text": text[told:]}] if text[told:] else [])


@pytest.mark.parametrize("seed", range(5))
def test_runs_equal_a_plain_reading(seed):
    r = random.Random(seed)
    for _ in range(6000):
        text = "".join(r.choice(["$", "$", "\\", "\\[", "\\]", "\\(", "\\)", "\n", " ", "x", "ab", "7", "cd e"]) for _ in range(r.randrange(14)))
        for typed in (False, True):
            assert texscan.runs_of(text, typed) == plain_runs(text, typed), text


def shown(text, typed=False):
    return [f"{r['kind'][0]}:{r['text']}" for r in texscan.runs_of(text, typed)]


def test_money_and_malformed_displays_stay_prose():
    assert shown(r"Prices are \$10.99 in Big & Tall and \$3.99 to $x^2$.") == [r"p:Prices are \$10.99 in Big & Tall and \$3.99 to ", "m:x^2", "p:."]
    text = "brownies for $3 a slice and cheesecakes for$4 a slice. Each is \\$ \\$3. $\\[ 3 \\times 43 = 129$ Then \\[\\[4 \\times 23 = 92 \\]"
    assert shown(text) == ["p:" + text]
    assert shown("'B09QQP3356': shirt 'Big & Tall', $10.99 to $3.99.", True) == ["p:'B09QQP3356': shirt 'Big & Tall', $10.99 to $3.99."]
    assert shown("$$x$$") == ["p:$$x$$"] and shown(r"a\\$x$") == ["p:a\\\\", "m:x"] and shown("$x\ny$") == ["p:$x\ny$"]


@pytest.mark.parametrize("text", ["$" + "x" * 1_000_000 + "$", "$1" + "a" * 500_000 + " b$", "$" * 300_000, "\\[" * 200_000 + "\\]", "\\" * 500_000 + "$", "$1 ab cd" * 100_000, "\\(" * 150_000, "\\[x" * 100_000 + "\\)" * 10])
def test_hostile_lines_take_a_pass(text):
    begin = time.time()
    runs = texscan.runs_of(text, False)
    assert time.time() - begin < 5
    assert all(r["text"] for r in runs)


def test_arguments(spark):
    form = re.compile(r"(?:\\caption\*?)\s*\{")
    assert texscan.arguments_of(r"\caption{a \caption{b} c} \caption {d\}} \caption*{} \caption{x", form) == [r"a \caption{b} c", "b", r"d\}", ""]
    assert texscan.arguments_of("\\caption{" * 20_000 + "}" * 19_000, form)[0].count("\\caption") == 18_999
    assert len(texscan.arguments_of("x } \\caption{y}" * 100_000, form)) == 100_000
    d = spark.createDataFrame([(1, r"\caption{a}"), (2, None), (3, "")], "k int, t string")
    assert {r.k: r.v for r in d.select("k", X.balanced_arguments("t", r"\\caption").alias("v")).collect()} == {1: ["a"], 2: None, 3: []}
    runs = d.select("k", X.math_runs("t").alias("v"), X.math_runs(F.lit("$a$"), F.col("k") == 1).alias("w")).collect()
    assert {r.k: r.v and len(r.v) for r in runs} == {1: 1, 2: None, 3: []} and [r.w[0].kind for r in sorted(runs)] == ["prose", "math", "math"]
