"""Queries over the whole input, without SQL, against brute force."""

import pytest
from pyspark.sql import functions as F

from quillspark.plans import registry


def key(t):
    return "".join(c for c in t.lower() if c.isascii() and c.isalnum())


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents with long, repeated and contained lines; more documents than five a conversation."""
    d = str(tmp_path_factory.mktemp("whole"))
    long = "".join(f"word {i} of a long line that goes on " for i in range(5))
    same = [long, "an alpha line with enough characters", long[:150], "", "short one", "an alpha line with enough", long[:70] + " another end"]
    docs = [(i, "\n".join([f"document number {i} about topic{i % 3}", *same[i % 3 :], *same])) for i in range(12)]
    docs.append((12, "\n".join(["theandtheand the", "and " + "pad " * 1200, "x" * 9000, *(f"row {i}" + " %%%" * (i == 40) for i in range(90))])))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    talk = [(c, t, "user" if t % 2 == 0 else "assistant", f"what about topic{c} and the alpha line {t}") for c in range(2) for t in (0, 1, 2, 100)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d, docs, talk


def lines_of(text):
    return text.split("\n")[: -1 if text.endswith("\n") else None]


def run(a, b):
    return max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0)


def tier(n, c):
    if not n or not c:
        return 0.0
    if n in c:
        return 1.0
    return min(0.98, 0.72 + len(c) / len(n) * 0.25) if c in n and len(c) >= 8 else run(n, c) / len(n) * 0.92


def test_locate_lines(spark, made):
    want = set()
    for doc, text in made[1][:12]:
        keys = [key(x) for x in lines_of(text)]
        for pos, n in enumerate(keys):
            scores = [tier(n, c) for c in keys] if n else [0.0]
            if max(scores) >= 0.55:
                idx = min((k for k, s in enumerate(scores) if s >= max(scores) - 0.02), key=lambda k: (abs(k / max(1, len(keys) - 1) - 0.5), k))
                want.add((doc, pos, idx, round(max(scores), 9)))
    got = {tuple(r) for r in registry.QUERIES["locate_lines"](spark, made[0]).where("doc_id < 12").collect()}
    assert got == want and len({r[:2] for r in got}) == len(got)


def test_locate_tiers(spark):
    from quillspark.operators import align

    lines = ["an alpha line with enough", "something else that is here", "the partial tier has a long common run of text xx"]
    asked = ["say: an alpha line with enough words", "and the partial tier has a long common run of text but another end", "zzzz yyyy wwww"]
    s = spark.createDataFrame([(i, 1, t, 0.5) for i, t in enumerate(asked)], "n_id long, doc_id long, selected string, page_ratio double")
    e = spark.createDataFrame([(1, i, i / 2, t) for i, t in enumerate(lines)], "doc_id long, idx long, position double, original string")
    got = {(r.n_id, r.idx, round(r.confidence, 9)) for r in align.locate(s, e).collect()}
    best = [max((tier(key(a), key(t)), i) for i, t in enumerate(lines)) for a in asked]
    assert got == {(n, i, round(b, 9)) for n, (b, i) in enumerate(best) if b >= 0.55} and len(got) == 2


def test_best_page_lines(spark, made):
    want, cuts = set(), set()
    for doc, text in made[1][:12]:
        keys = [key(x) for x in lines_of(text)]
        for pos, k in enumerate(keys):
            n = k + "0000000000"
            found = [next((c for c in (len(n), 120, 60, 24) if c <= len(n) and n[:c] in p), 0) for p in keys]
            if len(n) >= 12 and max(found):
                want.add((doc, pos, found.index(max(found)), max(found)))
                cuts.add(max(found))
    assert {120, 60, 24} <= cuts
    assert {tuple(r) for r in registry.QUERIES["best_page_lines"](spark, made[0]).where("doc_id < 12").collect()} == want


def test_retrieval_from_all_documents(spark, made):
    import re

    d, docs, talk = made
    tokens = lambda t: {x.lower() for x in re.findall("[A-Za-z0-9_]{2,}", t)}
    blocks = {doc: [" ".join(x.split()) for x in text.split("\n") if len(x.strip()) >= 20] for doc, text in docs}
    overlap, ranked, sources = set(), set(), set()
    for c, t, role, question in talk:
        if role != "user":
            continue
        q, used, label = tokens(question), 0, 0
        for doc in sorted(blocks):
            shared = [len(q & tokens(b)) for b in blocks[doc]]
            overlap |= {(c, t, doc, i, n) for i, n in enumerate(shared) if n}
            best = sorted(range(len(shared)), key=lambda i: (-shared[i] - shared[i] / len(q), i))[:3]
            for place, i in enumerate(best if 0 in best else [0, *best], 1 if 0 in best else 0):
                ranked.add((c, t, doc, i, place))
                chars = min(26_000 - used, 4200, len(blocks[doc][i]))
                if chars > 0:
                    label += 1
                    sources.add((c, t, f"P{label}", doc, i, chars))
                    used += chars
    ask = lambda name, *cols: {tuple(r) for r in registry.QUERIES[name](spark, d).select("conv_id", "turn", *cols).collect()}
    assert ask("token_retrieval_all", "doc_id", "idx", "overlap") == overlap
    assert ask("ranked_blocks_all", "doc_id", "idx", "place") == ranked
    assert ask("budgeted_sources_all", "label", "doc_id", "idx", "chars") == sources and {s[3] for s in sources} == set(range(13))


def test_overlay_of_every_match(spark, made):
    want = set()
    for doc, text in made[1]:
        keys = [key(x) for x in lines_of(text)]
        joined, ends = "".join(keys), [sum(map(len, keys[: i + 1])) for i in range(len(keys))]
        for b in (i for i in range(len(joined)) if joined.startswith("theand", i)):
            want |= {(doc, b, b + 6, p) for p, e in enumerate(ends) if keys[p] and e - len(keys[p]) < b + 6 and e > b}
    got = {tuple(r) for r in registry.QUERIES["span_overlay_all"](spark, made[0]).select("doc_id", "begin", "stop", "pos").collect()}
    assert got == want and len({r[1] for r in got if r[0] == 12}) == 3 and (12, 12, 18, 1) in got
    from quillspark.operators import search

    d = spark.createDataFrame([(1, 0, "A-a"), (1, 1, "aa b"), (1, 2, "aa"), (2, 0, "ba"), (3, 0, "")], "doc_id long, pos long, line string")
    assert {tuple(r) for r in search.key_places(d, "aa").collect()} == {(1, b, b + 2) for b in (0, 1, 2, 5)}


def test_windows_and_chunks(spark, made):
    text = lines_of(made[1][12][1])
    got = [r.pos for r in registry.QUERIES["context_windows_20"](spark, made[0]).where("doc_id = 12").orderBy("pos").collect()]
    assert got == list(range(3 + 40 - 20, 3 + 40 + 21))
    chunks = registry.QUERIES["chunk_pack_cut"](spark, made[0]).where("doc_id = 12").collect()
    assert max(r.chars for r in chunks) <= 4000
    letters = sum(len(x.strip()) for x in text)  # cuts fall at blanks, which are stripped
    pieces = sum(r.chars - 2 * (r.n_pieces - 1) for r in chunks)
    assert letters - 5 <= pieces <= letters and max(map(len, text)) == 9000


def test_order_of_every_owner(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet").collect()
    want = set()
    for c in {r.o_custkey for r in orders}:
        own = sorted((r for r in orders if r.o_custkey == c), key=lambda r: r.o_orderkey)
        own.sort(key=lambda r: r.o_orderdate, reverse=True)
        want |= {(c, r.o_orderkey, i) for i, r in enumerate(own, 1)}
    assert {tuple(r) for r in registry.QUERIES["history_order_all"](spark, data).collect()} == want
