"""Places in an order, orders of time, and quotes with their neighbours, against plain versions."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.operators import align as A
from quillspark.operators import library as B
from quillspark.operators import progress as P


@pytest.mark.parametrize(("bins", "few"), [(4, 3), (1024, 10_000)])
def test_places_in_order(spark, bins, few):
    r = random.Random(bins)
    kinds = {"ties": lambda: r.choice([1.0, 2.0, 2.0]), "wide": lambda: r.choice([1e-300, 1e300, -1e300, 5.0]), "plain": lambda: r.random(), "one": lambda: 7.0}
    rows = [(k, f()) for k, f in kinds.items() for _ in range(200)] + [("lone", 3.0), ("none", None), ("plain", None), ("plain", float("nan"))]
    n = F.col("n")
    got = P.order_statistics(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"first": F.lit(0), "mid": F.floor(n / 2), "last": n - 1}, bins, few)
    want = set()
    for k in {k for k, _ in rows}:
        v = sorted(x for m, x in rows if m == k and x is not None and x == x)
        if v:
            want |= {(k, "first", v[0]), (k, "mid", v[len(v) // 2]), (k, "last", v[-1])}
    assert {tuple(x) for x in got.collect()} == want


def test_newest_first(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, datetime(2024, 1, r.randrange(1, 9))])) for i in range(200)]
    got = B.newest_first(spark.createDataFrame(rows, "i long, at timestamp"), "at", "i").collect()
    want = sorted(rows, key=lambda x: (x[1] is None, -(x[1].day if x[1] else 0), x[0]))
    assert [x.i for x in sorted(got, key=lambda x: x.place)] == [i for i, _ in want] and sorted(x.place for x in got) == list(range(1, 201))
    assert B.newest_first(spark.createDataFrame([], "i long, at timestamp"), "at", "i").count() == 0


def test_quote_contexts(spark):
    lines = [("The first paragraph speaks of apples.", "Der erste Absatz handelt von Birnen."), ("A second one tells of **pears** and plums.", "Ein zweiter von Obst und Gemuese im Garten."), ("The third is about the weather of " + "today " * 90, None)]
    e = spark.createDataFrame([(1, i, i / 2, *t) for i, t in enumerate(lines)], "doc_id long, idx long, position double, original string, translated string")
    q = spark.createDataFrame([(1, 1, "second one tells of pears"), (2, 1, "zweiter von Obst und Gemuese im"), (3, 1, "nowhere to be found at all"), (4, 2, "second one tells of pears")], "n_id long, doc_id long, selected string")
    got = {x.n_id: x for x in A.quote_contexts(q, e).collect()}
    assert set(got) == {1, 2} and got[1].side == "original" and got[2].side == "translated" and got[1].idx == got[2].idx == 1
    assert got[1].own == got[2].other == "A second one tells of pears and plums." and got[2].own == lines[1][1]
    assert got[1].before == lines[0][0] and len(got[1].behind) == 400 and got[1].quote == "second one tells of pears"
