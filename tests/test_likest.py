"""The likeliest candidate behind an upper bound, against comparing all; labels of pages against a pattern for each."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillspark.operators import align as A


@pytest.mark.parametrize("seed", range(2))
def test_likest_equals_comparing_all(spark, seed, monkeypatch):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde019你" if seed else "abcdefghijklmnop") for _ in range(r.randrange(1, 40)))
    needles = [(i, word()) for i in range(12)]
    keys = [(i, r.choice([word(), r.choice(needles)[1][::-1], r.choice(needles)[1][3:] + "zz"])) for i in range(25)]
    n = spark.createDataFrame(needles, "n_id long, needle string").withColumn("counts", A._letters(F.col("needle")))
    k = spark.createDataFrame(keys, "idx long, key string").withColumn("key_counts", A._letters(F.col("key")))
    got = {tuple(x) for x in A.likest(n.crossJoin(k), 0.3).collect()}
    want = set()
    for i, a in needles:
        best = max((SequenceMatcher(None, a, b).ratio(), -j) for j, b in keys)
        if best[0] >= 0.3:
            want.add((i, -best[1]))
    assert got == want


def test_labels_equal_a_pattern_for_each(spark):
    r = random.Random(2)
    pieces = ["Figure 1", "fig.2", "FIG ~3", "Table 12", "table1", "\n", "  ", "see ", "config 2", "Figure 01", "figures 1", "Figure\n2"]
    pages = [(d, p, "".join(r.choice(pieces) for _ in range(r.randrange(0, 7)))) for d in range(4) for p in range(6)]
    figures = [(d, k, n, 99) for d in range(5) for k in ("figure", "table") for n in (1, 2, 3, 12)]
    got = {tuple(x) for x in A.caption_pages(spark.createDataFrame(figures, "doc_id long, kind string, number long, page long"), spark.createDataFrame(pages, "doc_id long, page long, text string")).collect()}
    want = set()
    for d, k, n, page in figures:
        form = (r"(?:figure|fig\.?)" if k == "figure" else "table") + rf"[\s~]*{n}(?!\d)"
        ranked = [(0 if re.search(r"(?im)^\s*" + form, t) else 1, p) for m, p, t in pages if m == d and re.search("(?i)" + form, t)]
        want.add((d, k, n, min(ranked)[1] if ranked else page))
    assert got == want
