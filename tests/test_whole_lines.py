"""Lines of any length are looked for to their ends."""

import random
import time

import duckdb
import pytest

from quillspark.operators import align as A
from quillspark.plans import compare, registry


@pytest.fixture(scope="module")
def long_lines():
    """Lines that differ behind their first 1,600 characters, by document: an own end each, a line that goes on behind another, ends beyond 4,000."""
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefgh 1你") for _ in range(n))
    base, far = word(2500), word(6000)
    return [(1, "\n".join([base + "one end", "short", base + "two ends", base + "three ends", "x"])), (2, "\n".join([far + "here", word(30), far, word(40), far + "there", far + "there"])), (3, "\n".join([base, base]))]


def test_lines_are_looked_for_to_their_ends(spark, long_lines, tmp_path):
    spark.createDataFrame(long_lines, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["locate_lines"](spark, str(tmp_path))
    got = {(r.doc_id, r.pos): (r.idx, r.confidence) for r in found.collect()}
    # The line before the middle begins like its neighbours, which hold 1,600 characters of it and no more; far stands in all that go on behind it.
    assert got == {**{(1, k): (k, 1.0) for k in range(4)}, (1, 4): (4, 1.0), **{(2, k): (k, 1.0) for k in range(4)}, (2, 4): (4, 1.0), (2, 5): (4, 1.0), (3, 0): (0, 1.0), (3, 1): (0, 1.0)}
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", long_lines)
    assert compare.differences(found, c, registry.ORACLES["locate_lines"]) == []


def test_whole_runs_are_compared_to_their_ends(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    text = word(5000)
    s = spark.createDataFrame([(1, 1, text[:4500] + "z" * 500, 0.5)], "n_id long, doc_id long, selected string, page_ratio double")
    e = spark.createDataFrame([(1, 0, 0.0, word(4100) + text[:4400]), (1, 1, 1.0, text[:1700])], "doc_id long, idx long, position double, original string")
    one = A.locate(s, e, whole=True).collect()
    assert [(x.idx, round(x.confidence, 9)) for x in one] == [(0, round(4400 / 5000 * 0.92, 9))]
    # As surveyed, 1,600 characters are asked for, which the shorter entry holds.
    assert [(x.idx, x.confidence) for x in A.locate(s, e).collect()] == [(0, 1.0)]


def test_a_line_found_whole_is_not_compared_by_runs():
    texts = ["pad" * 20_000 + f"end {k}" for k in range(40)]
    begin = time.time()
    judge = A.tiers(True, None)
    for t in texts:
        assert judge(t, texts) == [float(t in c) for c in texts]
    assert time.time() - begin < 5
