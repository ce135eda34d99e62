"""Candidate pairs by winnowed prints, and the longest common run, against all pairs."""

import random

import pytest

from quillspark.operators import align as A


def run(a, b):
    return max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0)


@pytest.mark.parametrize("seed", range(3))
def test_longest_run_equals_all_runs(seed):
    r = random.Random(seed)
    for _ in range(300):
        a, b = ("".join(r.choice("ab你" if seed else "abcdef") for _ in range(r.randrange(0, 25))) for _ in range(2))
        assert A.Automaton(a).longest(b) == run(a, b)


def test_a_long_needle_takes_a_pass():
    import time

    r = random.Random(0)
    a, b = ("".join(r.choice("abc") for _ in range(n)) for n in (A.NEEDLE, 400_000))
    begin = time.time()
    machine = A.Automaton(a)
    assert machine.longest(b) and machine.longest("x" * 10) == 0 and time.time() - begin < 3
    assert A.Automaton("").longest("abc") == A.Automaton("a" * 1000).longest("") == 0


@pytest.mark.parametrize("share", [0.598, 1.0])
def test_no_pair_is_missed(spark, share):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    cand = [(d, i, word(r.choice([0, 3, 7, 8, 9, 12, 20, 60, 150, 300]))) for d in range(3) for i in range(25)]
    needles = []
    for d, i, c in cand:
        cut = r.randrange(0, max(1, len(c)))
        kinds = [c, c[:cut], c[cut:], c[: int(len(c) * 0.7)] + "z" * int(len(c) * 0.3), word(5) + c + word(40), word(9), c[: int(len(c) * 0.61)] + "yx" * (len(c) // 5)]
        needles.append((len(needles), d, r.choice(kinds)))
    needles = [x for x in needles if x[2]]
    n = spark.createDataFrame(needles, "n_id long, doc_id long, needle string")
    e = spark.createDataFrame(cand, "doc_id long, idx long, candidate string")
    got = {(x.n_id, x.idx) for x in A.candidates(n, e, share).collect()}
    for i, d, t in needles:
        for m, k, c in cand:
            least = len(t) if share == 1.0 else next(k for k in range(1, len(t) + 1) if k / len(t) * 0.92 >= A.THRESHOLD)
            if d == m and c and ((len(c) >= 8 and c in t) or any(t[j : j + least] in c for j in range(len(t) - least + 1))):
                assert (i, k) in got, (t, c)
    assert len(got) < len(needles) * 25


def test_long_keys_make_few_prints(spark):
    from pyspark.sql import functions as F

    key = "".join(random.Random(1).choice("abcdefghij") for _ in range(50_000))
    n = spark.createDataFrame([(key,)], "k string").select(F.size(A._prints(F.col("k"), F.lit(8), F.lit(48))).alias("n")).first().n
    assert n < 50_000 * 3 / 49
