"""Merkle manifest of a table of documents by nested-interval labels (operator 13).

Every row is a leaf; the leaves of a language, in the order of their ids, make one tree, and the trees' roots, in the order of
the languages, make the tree above.  A node is labelled with its level and the interval [lo, hi) of leaf ranks that it covers; nodes of
a tree nest, so an ancestor is a node whose interval contains the leaf's, a parent's interval is rounded to the next level's
size, and what is left of it without the own interval are the siblings.

Levels come in buckets of ``BUCKET``: a row of the manifest holds the nodes of a bucket's levels above a run of ``fan ** BUCKET``
nodes, and covers these nodes' intervals.  A containment join, which is an equi-join on (tree, bucket's run), attaches to a leaf its row of the
first bucket, to that row its row of the second bucket, and so on up to the root.  So a leaf takes part in one join,
whatever the depth, and each further join is ``fan ** BUCKET`` times smaller.  Hashes are Spark's own functions; nothing runs in Python.

Ranks come from a sort by range of (lang, doc_id) and the parts' sizes, so that a language with most of the rows is spread over tasks.

Defined results: a null field counts as ``-`` and is told from any value; a null lang is a tree of its own, before the others; a null
doc_id comes first in its tree and is never tampered with; leaves of the same doc_id are in the order of their digests, repeated rows
give a row each; an empty text counts as ``0:``, a very long one is hashed like any other; an empty table has no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FAN = 2
#: Levels in a row of the manifest: a row holds at most 2 * FAN ** BUCKET digests.
BUCKET = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Documents whose checksum this divides are tampered with.
TAMPER = 7


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(values: dict[str, Column]) -> Column:
    """Digest of a row: each field with its length in bytes before it, ``-`` for null."""

    def told(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return digest(*[told(values[n]) for n in FIELDS])


def ranked(df: DataFrame, tree: str, *order: str) -> DataFrame:
    """``df`` with ``rank``, from 0 within each tree in the given order, and ``size``, the tree's rows; one sort by range."""
    spread = df.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("at", F.monotonically_increasing_id())
    held = materialise(spread, "merkle-order").withColumn("part", F.shiftright("at", 33))
    parts = held.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy(tree).orderBy("part")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col(tree).alias("of"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy(tree)).alias("size"))
    joined = held.join(parts, F.col(tree).eqNullSafe(F.col("of")) & (F.col("part") == F.col("p")))
    return joined.withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "of", "p", "shift")


def _levels(base: Column, todo: Column, fan: int, bucket: int) -> Column:
    """The arrays of digests of a bucket's levels, lowest first; ``todo`` says how many levels the tree still has."""

    def above(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.ceil(F.size(level) / fan).cast("int") - 1)
        return F.transform(runs, lambda j: F.sha2(F.array_join(F.slice(level, j * fan + 1, fan), ""), 256))

    start = F.array(base)
    return F.reduce(
        F.sequence(F.lit(1), F.lit(bucket)),
        start,
        lambda acc, h: F.when(h <= todo, F.concat(acc, F.array(above(F.element_at(acc, -1))))).otherwise(acc),
    )


def buckets(leaves: DataFrame, fan: int = FAN, bucket: int = BUCKET) -> list[DataFrame]:
    """The manifest by buckets of levels.  Each: tree, run, lo, hi, levels (arrays of digests), top (the run's node on the last level).

    leaves: tree, rank, size, hash.
    """
    width, out = fan**bucket, []
    most = leaves.agg(F.max("size")).first()[0] or 0
    nodes = leaves.select("tree", F.col("rank").alias("idx"), "size", "hash")
    covers = 1  # leaves that a full node of the bucket's lowest level covers
    while True:
        # Levels of the tree above this one: the least h whose fan ** h covers the nodes that are left.
        left = F.ceil(F.col("size") / F.lit(covers)).cast("long")
        todo = F.lit(0)
        for h in range(bucket, 0, -1):
            todo = F.when((todo == 0) & (left > fan ** (h - 1)), F.lit(h)).otherwise(todo)
        runs = nodes.groupBy("tree", "size", F.expr(f"idx div {width}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("held"))
        levels = runs.select(
            "tree",
            "size",
            "run",
            (F.col("run") * width * covers).alias("lo"),
            F.least((F.col("run") + 1) * width * covers, F.col("size")).alias("hi"),
            _levels(F.col("held.hash"), todo, fan, bucket).alias("levels"),
        ).withColumn("top", F.element_at(F.element_at("levels", -1), 1))
        out.append(materialise(levels, f"merkle-{len(out)}"))
        covers *= width
        if covers >= most:
            return out
        nodes = out[-1].where(F.col("size") > covers // width).select("tree", F.col("run").alias("idx"), "size", F.col("top").alias("hash"))


def _siblings(levels: Column, lo: Column, fan: int) -> Column:
    """Siblings of the node at ``lo`` (from 0 in its run) on each level: (left, right), the digests of what remains of the parent's interval."""

    def at(h: Column) -> Column:
        level = F.element_at(levels, h)
        own = F.floor(lo / F.pow(F.lit(float(fan)), h - 1)).cast("int")
        begin = own - own % fan  # the parent's interval in nodes of this level: [begin, end)
        end = F.least(begin + fan, F.size(level))
        return F.struct(F.array_join(F.slice(level, begin + 1, own - begin), "").alias("left"), F.array_join(F.slice(level, own + 2, end - own - 1), "").alias("right"))

    # On the last level that a bucket holds there is only the run's top, whose siblings are in the next bucket.
    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(1), F.size(levels) - 1), at)).otherwise(F.array().cast("array<struct<left:string,right:string>>"))


def paths(made: list[DataFrame], fan: int = FAN, bucket: int = BUCKET) -> DataFrame:
    """Each run of the first bucket with its levels and the siblings above them up to its tree's root: tree, run, levels, above, top."""
    width = fan**bucket
    upper = None
    for level in reversed(made):
        here = level.select("tree", "run", "levels", "top")
        if upper is None:
            upper = here.withColumn("above", F.array().cast("array<struct<left:string,right:string>>"))
            continue
        # Containment: the run [lo, hi) lies in the run of the next bucket whose number is its own, rounded.
        above = upper.select(F.col("tree").alias("of"), F.col("run").alias("in_run"), F.col("levels").alias("over"), F.col("above").alias("further"), F.col("top").alias("peak"))
        joined = here.join(above, F.col("tree").eqNullSafe(F.col("of")) & (F.expr(f"run div {width}") == F.col("in_run")), "left")
        chain = F.concat(_siblings(F.col("over"), F.col("run") % width, fan), F.col("further"))
        empty = F.array().cast("array<struct<left:string,right:string>>")
        upper = joined.select("tree", "run", "levels", F.coalesce("peak", "top").alias("top"), F.coalesce(chain, empty).alias("above"))
    return upper


def proofs(leaves: DataFrame, fan: int = FAN, bucket: int = BUCKET) -> DataFrame:
    """Every leaf with ``path``, the siblings of each level from its own up to its tree's root, and ``top``, that root.

    leaves: tree, rank, size, hash, and further columns, which stay.
    """
    width = fan**bucket
    runs = paths(buckets(leaves, fan, bucket), fan, bucket).select(F.col("tree").alias("of"), F.col("run").alias("in_run"), "levels", "above", "top")
    joined = leaves.join(runs, F.col("tree").eqNullSafe(F.col("of")) & (F.expr(f"rank div {width}") == F.col("in_run")))
    path = F.concat(_siblings(F.col("levels"), F.col("rank") % width, fan), F.col("above"))
    return joined.select(*leaves.columns, path.alias("path"), "top")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.reduce(path, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def manifest(docs: DataFrame, fan: int = FAN, bucket: int = BUCKET, tamper: int = TAMPER) -> DataFrame:
    """One row per document: its leaf, its tree's root, the root of all, the digest of its proof, and what a tampered table would lead to.

    Siblings in ``path`` (left and right of the way up) prove a leaf by ``fold``.
    """
    values = {n: F.col(n) for n in FIELDS}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % tamper == 0, F.lit(False))
    changed = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = docs.select("doc_id", F.col("lang").alias("tree"), leaf(values).alias("hash"), leaf(values | {"n_chars": changed}).alias("told"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "merkle-leaves")
    low = proofs(ranked(rows, "tree", "doc_id", "hash", "row"), fan, bucket)
    low = materialise(low, "merkle-low")
    # The tree above: one leaf for each language.
    subroots = low.groupBy("tree").agg(F.first("top").alias("hash")).select(F.lit("").alias("all"), F.col("tree").alias("lang"), "hash")
    high = proofs(ranked(subroots, "all", "lang").withColumnRenamed("all", "tree"), fan, bucket)
    high = high.select(F.col("lang").alias("of"), F.col("path").alias("further"), F.col("top").alias("root"))
    joined = low.join(high, F.col("tree").eqNullSafe(F.col("of")))
    whole = joined.withColumn("path", F.concat("path", "further"))
    both = F.transform("path", lambda s: F.concat(s["left"], s["right"]))
    out = whole.select("doc_id", F.col("hash").alias("leaf"), F.col("top").alias("subroot"), "root", F.sha2(F.array_join(both, ""), 256).alias("proof_sha256"), fold(F.col("told"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
