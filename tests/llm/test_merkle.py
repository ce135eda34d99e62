"""The Merkle manifest against a plain one."""

import hashlib
import zlib

import pytest

from quillspark.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    def told(v):
        s = None if v is None else str(v)
        return "-" if s is None else f"{len(s.encode())}:{s}"

    return H(*[told(v) for v in row])


def tree(level, fan):
    """(root, path of each leaf as (left, right) of its siblings by level)."""
    paths = [[] for _ in level]
    at = list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(at):
            b = i - i % fan
            paths[k].append(("".join(level[b:i]), "".join(level[i + 1 : b + fan])))
            at[k] = i // fan
        level = [H(*level[i : i + fan]) for i in range(0, len(level), fan)]
    return level[0], paths


def plain(rows, fan):
    """rows: doc_id, source, lang, n_chars, text."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    tops = [tree([x[2] for x in sorted(langs[g])], fan)[0] for g in order]
    root, high = tree(tops, fan)
    out = []
    for g, up in zip(order, high, strict=True):
        leaves = sorted(langs[g])
        sub, low = tree([x[2] for x in leaves], fan)
        for (_, _, own, r), path in zip(leaves, low, strict=True):
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc = leaf((*r[:3], r[3] + 1, r[4])) if hit else own
            for left, right in path + up:
                acc = H(left, acc, right)
            out.append((r[0], own, sub, root, H(*[a + b for a, b in path + up]), acc, acc == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank int, size int, hash string, tree string, of string, run int, top string, at int, told string"


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "h", "t", "o", 3, "p", 4, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize(("n", "fan", "bucket"), [(1, 2, 2), (65, 2, 2), (41, 3, 2), (200, 2, 8)])
def test_as_plain(spark, n, fan, bucket):
    langs = ["en", "en", "en", "fr", None, "", "é"]
    rows = [(i * 3, f"s{i % 4}" if i % 5 else None, langs[i % 7], i if i % 6 else None, "ß" * (i % 9) if i % 8 else None) for i in range(n)]
    got = sorted(map(tuple, merkle.manifest(made(spark, rows), fan, bucket).collect()), key=repr)
    assert got == plain(rows, fan)


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(7, "a", "en", 1, "x")] * 3 + [(7, "a", "en", 1, "y"), (None, None, None, None, None), (None, "a", "en", 2, ""), (5, "b", "en", 3, "-")]
    got = sorted(map(tuple, merkle.manifest(made(spark, rows), 2, 2).collect()), key=repr)
    assert got == plain(rows, 2)
    assert merkle.manifest(made(spark, rows[:0])).count() == 0


def test_only_tampered_leaves_fail(spark):
    rows = [(i, "a", "en" if i % 3 else "de", i, "t" * 3000) for i in range(100)]
    got = merkle.manifest(made(spark, rows)).collect()
    assert {r.doc_id for r in got if not r.verified} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert all((r.folded_root == r.root) == r.verified for r in got)
