"""Swap packing and ranked search against plain versions."""

import random
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lexical, packing, swappack, tokens


def ids(text, end):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokens.tokenizer_path())
    return np.array([*full.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


@pytest.mark.parametrize("seed", range(6))
def test_search_keeps_every_piece_in_a_sequence(seed):
    r = random.Random(seed)
    lengths = [r.choice([r.randrange(1, 100), r.randrange(1, 30), 100, 1, 51]) for _ in range(r.randrange(0, 300))]
    for effort in (0, 1, 2):
        place = swappack.search(lengths, 100, effort)
        used = Counter()
        for (s, at), n in sorted(zip(place, lengths)):
            assert used[s] == at
            used[s] += n
        assert set(used) == set(range(len(used))) and max(used.values(), default=0) <= 100
        start = len(used) if not effort else start
        assert len(used) <= start


def test_exchanges_grow_the_squared_fills_and_empty_sequences():
    r = random.Random(1)
    lengths = [r.randrange(20, 140) for _ in range(600)]
    seqs = swappack.Sequences(lengths, 200)
    begin, whole = seqs.count, sum(lengths)
    last = sum(f * f for f in seqs.fill)
    kinds = Counter()
    for victim in sorted(range(begin), key=lambda s: seqs.fill[s]):
        while 0 < seqs.fill[victim] < 200 and seqs.exchange(victim, seqs.widest(victim)):
            now = sum(f * f for f in seqs.fill)
            assert now > last and sum(seqs.fill) == whole and max(seqs.fill) <= 200
            assert all(sum(h.elements()) == f for h, f in zip(seqs.held, seqs.fill))
            last = now
            kinds["more"] += 1
    assert kinds["more"] > 20 and seqs.count < begin
    # By far fewer sequences than the start, and as few as best fit decreasing or fewer.
    best = 1 + max(s for s, _ in packing.best_fit(sorted(lengths, reverse=True), 200))
    assert 1 + max(s for s, _ in swappack.search(lengths, 200)) <= best


@pytest.mark.parametrize(
    ("victim", "other", "after"),
    [
        ([8], [92], ([], [92, 8])),  # a move
        ([50, 20], [45, 40], ([40, 20], [50, 45])),  # one for one
        ([30, 28], [52, 40], ([52], [40, 30, 28])),  # two for one
        ([60], [29, 28, 38], ([29, 28], [60, 38])),  # one for two
        ([60, 5], [97], ([60, 5], [97])),  # none
    ],
)
def test_each_kind_of_exchange(victim, other, after):
    seqs = swappack.Sequences([], 100)
    for held in (victim, other):
        seqs.held.append(Counter(held))
        seqs.fill.append(sum(held))
    seqs.count = 2
    for s in (0, 1):
        seqs._offer(s, True)
    moved = seqs.exchange(0, seqs.widest(0))
    assert tuple(sorted(h.elements(), reverse=True) for h in seqs.held) == after
    assert moved == (after != (victim, other)) and seqs.count == 2 - (not after[0])


ROWS = [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (2, None), (None, ""), (3, "word " * 5000), (4, "a"), (5, "ünïcode 你好 \n\t x")]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    return d.withColumns({c: F.lit("x") for c in ["row", "shard", "fill", "piece", "length", "sequence_id", "query", "term", "terms", "df", "score", "rank", "path", "n_docs"]})


def test_swap_packing(docs):
    got = swappack.pack(docs).toPandas()
    want = Counter()
    for doc, text in ROWS:
        x = ids(text, 0)
        want.update((doc, k // 2048, k, len(x[k : k + 2048]), zlib.crc32(x[k : k + 2048].tobytes())) for k in range(0, len(x), 2048))
    rows = got.astype({"doc_id": object}).where(got.notna(), None)
    assert Counter((None if r.doc_id is None else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples()) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 2048
    assert got["sequence_id"].nunique() == -(-got["length"].sum() // 2048)
    assert swappack.pack(docs.where("false")).count() == 0


def test_what_shards_leave_over_is_packed_again(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["the", "of", "and", "in"]) for _ in range(r.randrange(1, 60)))) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = swappack.pack(d, window=256, shard_items=60).toPandas()
    assert sorted(got["doc_id"]) == list(range(900))
    used = got.groupby("sequence_id")["length"].sum()
    assert used.max() <= 256 and len(used) <= -(-used.sum() // 256) + 2


def plain(docs, items, top):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(words(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    N, L = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        terms = {t: floor(1000 * log((2 * N + 2) / (2 * df[t] + 1))) for t in set(words(text)) if t in df}
        scored = []
        for d, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * N) // L
            score = sum(w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, w in terms.items() if t in c)
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return Counter(out)


@pytest.mark.parametrize(("seed", "segment", "block"), [(0, 3, 10**6), (1, 8192, 40), (2, 17, 60)])
def test_ranked_equals_a_full_scoring(spark, seed, segment, block):
    r = random.Random(seed)
    vocabulary = ["the", "Of", "é", "É", "x1", "naïve", "q", "zzz", *(f"w{i}" for i in range(60))]
    text = lambda n: " ".join(r.choice(vocabulary[: r.choice([5, 20, 68])]) + r.choice(["", ".", "--", "_"]) for _ in range(n))
    docs = [(r.choice([i, i, None]), r.choice([text(r.randrange(0, 80)), text(5), None, "..."])) for i in range(120)]
    docs += [docs[3], docs[3], (500, text(3000)), (7, "the " * 40), (8, "the " * 40), (9, "the " * 40)]
    items = [(i, text(r.randrange(0, 30))) for i in range(12)] + [(1, "the of"), (None, "w1 w2 w3"), (50, None), (51, "unseen words only"), (52, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(1), "rank": F.lit(1), "score": F.lit("x")})
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "query": F.lit(1), "term": F.lit("x")})
    got = lexical.ranked(d, b, segment_docs=segment, block_terms=block)
    assert Counter(map(tuple, got.collect())) == plain(docs, items, 10)


def test_ranked_of_nothing(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("k", "a c")], "item_id string, text string")
    assert lexical.ranked(d.where("false"), b).count() == lexical.ranked(d, b.where("false")).count() == 0
    assert lexical.ranked(d, b).schema["item_id"].dataType.simpleString() == "string"


@pytest.mark.parametrize("at_once", [1, 2, 64])
def test_intervals_leave_out_what_cannot_count(at_once):
    r = random.Random(at_once)
    made = lexical.Building()
    for i in range(2000):
        made.add(i, " ".join(r.choices(["common", *(f"t{k}" for k in range(200))], [100, *([1] * 200)], k=r.randrange(3, 40))))
    seg = made.done()
    terms = [(b"t3", 5000), (b"t7", 4000), (b"common", 10)]
    lists = lexical.Lists(seg, [t for t, _ in terms], 2000, made.n_words)
    seen = []
    score = lists.largest

    def watched(a, b):
        seen.append(len(a))
        return score(a, b)

    lists.largest = watched
    best = lists.search(terms, [], seg["ids"], 10, at_once)
    docs = [(d, None) for d in range(2000)]
    full = {d: 0 for d, _ in docs}
    for t, w in terms:
        k = lists.row[t]
        for p in range(lists.begin[k], lists.end[k]):
            full[seg["ids"][lists.doc[p]]] += w * int(lists.impact[p])
    assert best == sorted((-s, d) for d, s in full.items() if s > 0)[:10]
    assert sum(seen) < 1500  # of two intervals for every document with a term
