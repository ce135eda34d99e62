"""Near-duplicate groups by fast similarity sketching (operator 8).

A text's set is its distinct shingles of five words.  The sketch has ``COORDINATES`` bins;
in round i every shingle is hashed anew to a bin and a value, and values of earlier rounds
win, so each bin is filled after a few rounds; from round ``COORDINATES`` on, a round fills
one given bin, so that even a single shingle fills all of them.  ``BANDS`` bands of
``ROWS`` coordinates give the buckets: two texts of similarity 0.75 miss each other in all
of them with a chance of (1 - 0.75 ** 5) ** 40, about 2 in 100,000.

Texts with equal sets are one class from the start.  Where a join's key may be hot (a bucket of
many classes, a class of many texts, a popular least class), the key's rows are dealt over salts;
which keys are hot is broadcast, at most ``HOT_KEYS`` small rows (see ``hot_of``).  Of the classes in a bucket, each is
first held against the bucket's least one; the links that full sets confirm give
components.  Only buckets that then still hold two components or more need a closer look:
there, classes of different components are compared within blocks of ``BLOCK``, sketches
first and then full sets.  All block pairs are compared, and a pair that is skipped lies
in one component already, so no link that joins two components is lost.  Blocks are bounded by
members and by the bytes of their sets, ``BLOCK_BYTES``.  What a block
pair returns are the links of a forest, never all pairs.

Defined results: null or empty text has the empty set and is linked with nothing, so its
component is its own id and it is kept; repeated rows fall in one class; a component's id
is the least id that is not null, and a row is kept if its id is equal to it (both may be
null); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, materialise, mix64
from .tokens import slices

SHINGLE = 5
COORDINATES = 200
ROWS = 5
BANDS = COORDINATES // ROWS
#: Least similarity in hundredths.
PERCENT = 75
#: Sketches that agree in fewer coordinates are of less than that similarity but for 1 pair in 100,000.
LEAST_AGREE = int(COORDINATES * 0.62)
BLOCK = 512
#: Bytes of full sets in a block, about.
BLOCK_BYTES = 64 << 20
#: Most keys that are told as hot; what is told of them is broadcast.
HOT_KEYS = 50_000
#: Edges of a star in one salt.
STAR = 64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_RANDOM = np.random.default_rng(20240817)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = _RANDOM.integers(0, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SEED = mix64(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SKETCH = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("h", T.LongType()),
        T.StructField("n_shingles", T.LongType(), False),
        T.StructField("fp", T.BinaryType()),
        T.StructField("sketch", T.BinaryType()),
    ]
)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _POWERS or next(iter(_POWERS)) < n:
        size = max(n, 1 << 21)
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS.clear()
        _POWERS[size] = tuple(out)
    return next(iter(_POWERS.values()))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every text."""
    docs = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    buf = np.frombuffer(b"\n" + b"\n".join(docs) + b"\n", dtype=np.uint8)
    begin = np.cumsum([1] + [len(d) + 1 for d in docs])[:-1]
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, last = edge[::2], edge[1::2]
    power, inverse = _powers(len(buf))
    with np.errstate(over="ignore"):
        total = np.cumsum(_BYTE[buf] * power[: len(buf)], dtype=np.uint64)
        word = mix64((total[last - 1] - total[first - 1]) * inverse[first] + (last - first).astype(np.uint64))
        doc = np.searchsorted(begin, first, side="right") - 1
        m = max(0, len(word) - SHINGLE + 1)
        gram = np.zeros(m, dtype=np.uint64)
        for j in range(SHINGLE):
            gram += word[j : j + m] * _PLACE[j]
        gram = mix64(gram)
    whole = doc[:m] == doc[SHINGLE - 1 :] if m else np.zeros(0, dtype=bool)
    gram, owner = gram[whole], doc[:m][whole]
    cut = np.searchsorted(owner, np.arange(len(docs) + 1))
    at = np.searchsorted(doc, np.arange(len(docs) + 1))
    out = []
    for k in range(len(docs)):
        n = int(at[k + 1] - at[k])
        if n >= SHINGLE:
            out.append(np.unique(gram[cut[k] : cut[k + 1]]))
        elif n:
            with np.errstate(over="ignore"):
                out.append(mix64((word[at[k] : at[k + 1]] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES 16-bit values for every set; rows of empty sets mean nothing."""
    t = COORDINATES
    element = np.concatenate([*sets, np.empty(0, dtype=np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    none = np.iinfo(np.uint64).max
    best = np.full(len(sets) * t, none, dtype=np.uint64)
    for i in range(2 * t):
        if not len(element):
            break
        h = mix64(element ^ _SEED[i])
        place = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(best, owner * t + place, np.uint64(i << 32) | (h & np.uint64(0xFFFFFFFF)))
        open_ = (best.reshape(-1, t) == none).any(axis=1)
        left = open_[owner]
        if not left.all():
            element, owner = element[left], owner[left]
    return (mix64(best) & np.uint64(0xFFFF)).astype("<u2").reshape(-1, t)


def _sketch_frames(frames):
    import xxhash

    for f in frames:
        texts = [as_text(t) for t in f["text"]]
        for a, b in slices(texts, 1_500_000):
            sets = shingle_sets(texts[a:b])
            rows = sketches(sets)
            yield pd.DataFrame(
                {
                    "doc_id": f["doc_id"].iloc[a:b].astype("Int64").array,
                    "h": f["h"].iloc[a:b].array,
                    "n_shingles": [len(s) for s in sets],
                    "fp": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "sketch": [r.tobytes() if len(s) else None for r, s in zip(rows, sets, strict=True)],
                }
            )


def _set_frames(frames):
    for f in frames:
        texts = [as_text(t) for t in f["text"]]
        for a, b in slices(texts, 1_500_000):
            yield pd.DataFrame({"node": f["node"].iloc[a:b].array, "sketch": f["sketch"].iloc[a:b].array, "full": [s.tobytes() for s in shingle_sets(texts[a:b])]})


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < PERCENT * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


@F.pandas_udf(T.BooleanType())
def linked(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two full sets are alike enough."""
    return pd.Series([_linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(a, b, strict=True)], dtype=bool)


def forest(component: np.ndarray, side: np.ndarray, sketch: np.ndarray, full: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between members of different components that join what nothing joined before.

    side: 0 or 1; with both sides present only pairs across them are tried.
    """
    root = {c: c for c in np.unique(component).tolist()}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    two = side.any() and not side.all()
    rows = np.flatnonzero(side == 0) if two else np.arange(len(component))
    order = np.argsort(component[rows], kind="stable")
    rows = rows[order]
    # The members of the commonest component are only met from the other side.
    values, counts = np.unique(component, return_counts=True)
    main = values[counts.argmax()]
    others = np.flatnonzero(side == 1) if two else np.arange(len(component))
    pairs = []
    for left, right in ((rows[component[rows] != main], others), *(((others[component[others] != main], rows[component[rows] == main]),) if two else ())):
        for i in left.tolist():
            to = right[component[right] != component[i]]
            if not two:
                to = to[(component[to] == main) | (to > i)]
            n = (sketch[to] == sketch[i]).sum(axis=1)
            near = n >= LEAST_AGREE
            pairs += [(-int(k), i, int(j)) for k, j in zip(n[near], to[near], strict=True)]
    for _, i, j in sorted(pairs):
        a, b = find(component[i]), find(component[j])
        if a != b and _linked(full[i], full[j]):
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _forest_frames(frames):
    """Groups come one behind another; the last group of a batch may go on in the next."""
    rest = None

    def links(g: pd.DataFrame):
        code = pd.factorize(g["component"])[0]
        sketch = np.frombuffer(b"".join(g["sketch"]), dtype="<u2").reshape(len(g), COORDINATES)
        full = [np.frombuffer(x, dtype=np.uint64) for x in g["full"]]
        names = g["component"].tolist()
        return [(names[i], names[j]) for i, j in forest(code, g["side"].to_numpy(), sketch, full)]

    for f in frames:
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        new = np.flatnonzero((f[["key", "i", "j"]].to_numpy()[1:] != f[["key", "i", "j"]].to_numpy()[:-1]).any(axis=1)) + 1
        cuts = [0, *new.tolist()]
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            out += links(f.iloc[a:b])
        rest = f.iloc[cuts[-1] :]
        yield pd.DataFrame(out, columns=["a", "b"])
    if rest is not None and len(rest):
        yield pd.DataFrame(links(rest), columns=["a", "b"])


def hot_of(counts: DataFrame, key: str, total: int, each: int | None = None) -> DataFrame:
    """(key, salts) of the keys that more than ``each`` (``BLOCK``) and a ``HOT_KEYS``-th of all ``total`` rows have.

    counts: key and n, the number of its rows, ``total`` of all together.  There can be no more than
    ``HOT_KEYS`` such keys, so that many small rows are broadcast at most.
    """
    each = each or BLOCK
    return F.broadcast(counts.where(F.col("n") > max(each, total // HOT_KEYS)).select(key, F.ceil(F.col("n") / each).cast("int").alias("salts")))


def spread_join(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame, spread) -> DataFrame:
    """Inner join by key; rows of a hot key are dealt by ``spread`` over its salts, for each of which ``side``'s row is repeated."""
    salts = F.coalesce("salts", F.lit(1))
    rows = rows.join(hot, key, "left").withColumn("salt", F.pmod(spread, salts).cast("int")).drop("salts")
    side = side.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return rows.join(side, [key, "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the connected components of (a, b); the component is the least node.

    Large-star and small-star steps in turn, each round written to the shared folder; there
    are as many rounds as the logarithm of the longest chain.  The edges of a star's centre are
    dealt over salts, ``STAR`` to each.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    last, total = None, 2 * edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        large = spread_join(both.where("v > u"), least.select("u", F.least("u", "m").alias("m")), "u", hot_of(least, "u", total, STAR), F.xxhash64("v"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        pairs = large.join(least, F.col("u") == F.col("c")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(pairs.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).where("u != v").distinct(), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last, total = now, 2 * now[0]


_SIGN = -(1 << 63)


def _node(doc_id, fp):
    """A name of 25 bytes that sorts by id, null last, and then by fingerprint."""
    return F.unhex(F.concat(F.when(doc_id.isNull(), "01").otherwise("00"), F.lpad(F.hex(F.coalesce(doc_id, F.lit(0)).bitwiseXOR(F.lit(_SIGN))), 16, "0"), F.hex(fp)))


def _id_of(node):
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN)))


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (and h, the hash of its text, and component, its name)."""
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    marks = materialise(texts.mapInPandas(_sketch_frames, SKETCH), "sketches")
    # A class is what texts of equal sets are; its name begins with their least id, so a component's least name tells its id.
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "sketch", "n_shingles")
    classes = marks.where("fp is not null").groupBy("fp").agg(F.min(least).alias("r"), F.count("*").alias("n"))
    classes = classes.select("fp", "n", _node(F.col("r.doc_id"), F.col("fp")).alias("node"), F.col("r.doc_id").alias("d"), F.col("r.h").alias("h1"), F.col("r.sketch").alias("sketch"), F.col("r.n_shingles").alias("size"))
    classes = materialise(classes, "classes")
    n_classes = classes.count()

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sketch", k * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    member = classes.select("node", "size", F.explode(bands).alias("key"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")
    bucket = member.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n"), F.sum("size").alias("shingles"))
    bucket = materialise(bucket.where("least != most").select("key", "least", "n", blocks), "buckets")
    member = spread_join(member.select("key", "node"), bucket.drop("n"), "key", hot_of(bucket, "key", n_classes * BANDS), F.xxhash64("node"))
    member = materialise(member, "members")

    # Full sets, only of classes that share a bucket with another one; each from one of its texts.
    one = classes.join(member.select("node").distinct(), "node", "left_semi").select("node", "d", "h1", "sketch")
    full = texts.join(one, texts.doc_id.eqNullSafe(one.d) & (texts.h == one.h1)).select("node", "sketch", "text")
    if marks.groupBy("doc_id", "h").count().where("count > 1").limit(1).count():  # only repeated rows give a class several texts
        full = full.dropDuplicates(["node"])
    full = materialise(full.mapInPandas(_set_frames, "node binary, sketch binary, full binary"), "sets")

    # First links: each class against the least class of all its buckets.
    pair = materialise(member.where("node != least").groupBy("node").agg(F.min("least").alias("least")), "pairs")
    sets = full.select("node", "full")
    popular = hot_of(pair.groupBy("least").agg(F.count("*").alias("n")), "least", n_classes)
    pair = spread_join(pair.join(sets, "node"), sets.select(F.col("node").alias("least"), F.col("full").alias("other")), "least", popular, F.xxhash64("node"))
    links = materialise(pair.where(linked("full", "other")).select(F.col("node").alias("a"), F.col("least").alias("b")), "links")
    label = components(links)

    # Buckets that still hold several components, in pairs of blocks.
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = member.join(label, "node", "left").select("key", "node", "blocks", F.coalesce("component", "node").alias("component"), own.alias("own"))
    split = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("blocks").alias("b")).where("x != y")
    split = split.select("key", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("own"))
    open_ = placed.join(split, ["key", "own"])
    open_ = open_.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.select("key", "node", "component", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).cast("int").alias("side"))
    dealt = open_.join(full, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    more = materialise(dealt.select("key", "i", "j", "side", "component", "sketch", "full").mapInPandas(_forest_frames, "a binary, b binary"), "more-links")
    label = components(links.unionByName(more))

    cls = classes.select("fp", "node", "n").join(label, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component"))
    alike = marks.where("fp is not null").select("doc_id", "h", "n_shingles", "fp")
    alike = spread_join(alike, cls.drop("n"), "fp", hot_of(classes.select("fp", "n"), "fp", marks.count()), F.monotonically_increasing_id())
    empty = marks.where("fp is null").select("doc_id", "h", "n_shingles", F.lit(None).cast("binary").alias("component"))
    node = alike.select(*empty.columns).unionByName(empty)
    cid = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(_id_of(F.col("component")))
    return node.select("doc_id", "n_shingles", cid.alias("component_id"), F.col("doc_id").eqNullSafe(cid).alias("kept"), "h", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document with its component and whether it stays."""
    return groups(docs).drop("h", "component")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns.

    Of several texts of the least id in a component that of the least hash stays, and of rows that
    repeat both id and text, one.
    """
    d, h = (_unused(n, docs.columns) for n in ("kept_id", "kept_hash"))
    kept = materialise(groups(docs).where("kept").select(F.col("doc_id").alias(d), F.col("h").alias(h), "component"), "kept")
    repeated = kept.groupBy(d, h).count().where("count > 1").limit(1).count()
    first = kept.where("component is not null").groupBy("component").agg(F.min(F.struct(d, h)).alias("r")).select("r.*")
    keep = first.unionByName(kept.where("component is null").select(d, h))
    out = docs.join(keep.distinct(), docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h)), "left_semi")
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out


def _unused(name: str, columns: list[str]) -> str:
    """A column name that a table doesn't have, in whatever case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name
