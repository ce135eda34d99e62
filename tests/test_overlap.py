"""Overlap joins against all pairs, with a key that holds most of the rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import library as B
from quillspark.operators import overlap as O
from quillspark.operators import search as S

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("seed", range(2))
def test_in_interval(spark, seed):
    r = random.Random(seed)
    key = lambda: r.choice([1, 1, 1, 1, 2, 3, None])
    points = [(i, key(), r.choice([None, *range(-40, 400)])) for i in range(300)]
    spans = [(i, key(), a, a + r.choice([-1, 0, 1, 2, 3, 8, 9, 64, 200])) for i in range(80) for a in [r.randrange(-50, 380)]]
    p = spark.createDataFrame(points, "p long, k long, at long")
    s = spark.createDataFrame(spans, "s long, k long, a long, b long")
    got = sorted((x.p, x.s) for x in O.in_interval(p, s, "k", F.col("at"), F.col("a"), F.col("b")).collect())
    assert got == sorted((i, j) for i, k, at in points for j, m, a, b in spans if k is not None and k == m and at is not None and a <= at < b)
    assert O.in_interval(p, s.limit(0), "k", F.col("at"), F.col("a"), F.col("b")).count() == 0


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_overlapping(spark, width):
    r = random.Random(width)
    left = [(i, r.choice([1, 1, 1, 2]), a, a + r.randrange(0, 30)) for i in range(120) for a in [r.randrange(200)]]
    right = [(i, r.choice([1, 1, 1, 2, 3]), a, a + r.randrange(0, 60)) for i in range(120) for a in [r.randrange(200)]]
    got = O.overlapping(spark.createDataFrame(left, "l long, k long, a long, b long"), spark.createDataFrame(right, "r long, k long, c long, d long"), "k", ("a", "b"), ("c", "d"), width)
    assert sorted((x.l, x.r) for x in got.collect()) == sorted((i, j) for i, k, a, b in left for j, m, c, d in right if k == m and a < b and c < d and a < d and c < b)


def test_running_ends(spark):
    r = random.Random(5)
    rows = [(k, i, r.randrange(5)) for k, n in ((1, 900), (2, 3)) for i in range(n)]
    got = {(x.k, x.i): (x.start, x.end) for x in O.running_ends(spark.createDataFrame(rows, "k long, i long, n long"), "k", "i", "n", run=16).collect()}
    total = {}
    for k, i, n in rows:
        assert got[k, i] == (total.get(k, 0), total.get(k, 0) + n)
        total[k] = total.get(k, 0) + n


def test_decisions(spark):
    r = random.Random(8)
    at = lambda: START + timedelta(seconds=r.randrange(20_000), milliseconds=r.choice([0, 0, 500]))
    asks = [(i, r.choice([1, 1, 1, 2, 3, None]), at()) for i in range(250)]
    told = [(r.choice([1, 1, 2, None]), at(), r.choice(["accept", "reject"])) for _ in range(60)]
    told += [(1, asks[3][2], "reject"), (1, asks[3][2], "accept"), (asks[0][1], asks[0][2] + timedelta(minutes=30), "edge")]
    got = B.decided(spark.createDataFrame(asks, "proposal_id long, user_id long, ts timestamp"), spark.createDataFrame(told, "user_id long, ts timestamp, decision string"), "user_id")
    want = {}
    for i, k, t in asks:
        found = [(u, d) for m, u, d in told if k is not None and m == k and t <= u <= t + timedelta(minutes=30)]
        want[i] = min(found) if found else (None, None)
    assert {x.proposal_id: (x.decided_at, x.decision) for x in got.collect()} == want


@pytest.mark.parametrize("needle", ["a", "aa", "aba", "ababab"])
def test_places_across_lines(spark, needle):
    r = random.Random(len(needle))
    docs = {d: ["".join(r.choice("ab A-") for _ in range(r.randrange(5))) for _ in range(40)] for d in range(6)}
    rows = [(d, i, t) for d, ls in docs.items() for i, t in enumerate(ls)]
    got = sorted((x.doc_id, x.begin, x.stop) for x in S.key_places(spark.createDataFrame(rows, "doc_id long, pos long, line string"), needle).collect())
    key = {d: "".join(ls).lower().replace(" ", "").replace("-", "") for d, ls in docs.items()}
    assert got == [(d, i, i + len(needle)) for d, k in key.items() for i in range(len(k)) if k.startswith(needle, i)]


def test_keys_of_typeset_text(spark):
    from quillspark.functions import text as X

    d = spark.createDataFrame([(1, "\uff21\uff42\uff43\uff11 e\ufb03cient \ufb02ow"), (2, "Plain-Text 5"), (3, None)], "k int, t string")
    assert {r.k: r.v for r in d.select("k", X.page_key("t").alias("v")).collect()} == {1: "abc1efficientflow", 2: "plaintext5", 3: ""}
    lines = spark.createDataFrame([(1, 0, "an e\ufb03"), (1, 1, "cient way")], "doc_id long, pos long, line string")
    assert [(r.begin, r.stop) for r in S.key_places(lines, "efficient").collect()] == [(2, 11)]
    q = spark.createDataFrame([(7, 1, "\uff45fficient way")], "q_id long, doc_id long, quote string")
    assert [(r.begin, r.stop) for r in S.quote_places(lines, q).collect()] == [(2, 14)]
