"""Approximate nearest neighbours by one small-world graph per shard (operator 9).

Equal vectors are one node, so that copies cannot crowd out a node's links; of their ids
the ``TOP`` + 1 least are remembered, and no query can ever need more.  Nodes are parted by
their norm into bands, each of norms within a factor of two, and a band's nodes are dealt by
hash into shards of about ``SHARD_ROWS``.  A shard's graph is hierarchical: nodes are numbered by
falling level, so every layer is a prefix, and a layer is one flat array of neighbour numbers
(-1: none).  For largest inner products, vectors are divided by the band's largest norm and given
one more component that brings all of them to norm one; a query has 0 there, which leaves the order
of products as it is.  Within a band that component never outweighs the others, and no vector
of another scale has a say in it.

Nodes are inserted and queries are searched many at a time: one step expands the best open
candidates of all of them with array operations.  Graphs and blocks of query vectors are files in
the shared folder; a task is a block against a graph, so that only their names are shuffled, and
the shards' results are merged.

The number of shards follows from the number of nodes and ``SHARD_ROWS`` alone, so results are the
same on any cluster.  The index takes in every row; nothing is sampled.

Defined results: vectors that are null, zero, or hold null or non-finite components, and
rows without an id, take no part; vectors meet only vectors of their own length; a repeated
(id, vector) row counts once; fewer candidates than asked for give fewer rows.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, open_fs, scratch

TOP = 20
QUERY_STEP = 20
#: Links of a node in the upper layers; twice as many in the lowest.
LINKS = 20
EF_BUILD = 64
EF_SEARCH = 192
#: Nodes of a shard, about.
SHARD_ROWS = 16_384
#: Query vectors of a block.
QUERY_ROWS = 2_048
BATCH = 256
STEP = 4


def select(near: np.ndarray, sims: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first, those that are closer to the row than to any chosen
    before; then the best of the rest up to ``most``.  -1 marks no candidate."""
    n, width = near.shape
    chosen = np.full((n, most), -1, dtype=np.int32)
    count = np.zeros(n, dtype=np.int64)
    taken = np.zeros((n, width), dtype=bool)
    rows = np.arange(n)
    vectors = x[near]  # -1 reads some vector, which is masked below
    held = np.zeros((n, most, x.shape[1]), dtype=x.dtype)
    for k in range(width):
        open_ = (near[:, k] >= 0) & (count < most)
        if not open_.any():
            continue
        closest = np.einsum("nmd,nd->nm", held, vectors[:, k])
        closest[np.arange(most)[None, :] >= count[:, None]] = -np.inf
        ok = open_ & (closest.max(axis=1) < sims[:, k])
        r = rows[ok]
        chosen[r, count[r]] = near[r, k]
        held[r, count[r]] = vectors[r, k]
        taken[r, k] = True
        count[r] += 1
    for k in range(width):
        ok = (near[:, k] >= 0) & ~taken[:, k] & (count < most)
        r = rows[ok]
        chosen[r, count[r]] = near[r, k]
        count[r] += 1
    return chosen


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` best nodes below ``limit`` for every query, best first, from each query's entry nodes."""
    n = len(q)
    rows = np.arange(n)[:, None]
    ids = np.full((n, ef), -1, dtype=np.int32)
    sims = np.full((n, ef), -np.inf, dtype=np.float32)
    done = np.zeros((n, ef), dtype=bool)
    seen = np.zeros((n, limit + 1), dtype=bool)  # the last one stands for none
    k = min(entry.shape[1], ef)
    first = entry[:, :k]
    ids[:, :k] = first
    sims[:, :k] = np.where(first >= 0, np.einsum("nkd,nd->nk", x[first], q), -np.inf)
    seen[rows, first] = True
    seen[:, limit] = True
    live = np.arange(n)
    while len(live):
        open_ = np.where(done[live] | (ids[live] < 0), -np.inf, sims[live])
        step = min(STEP, ef)
        best = np.argpartition(-open_, step - 1, axis=1)[:, :step]
        at = np.arange(len(live))[:, None]
        usable = np.isfinite(open_[at, best])
        keep = usable.any(axis=1)
        live, best, usable = live[keep], best[keep], usable[keep]
        if not len(live):
            break
        at = live[:, None]
        done[at, best] |= usable
        near = links[ids[at, best]].astype(np.int64)
        near[~usable] = -1
        near = near.reshape(len(live), -1)
        near[(near < 0) | (near >= limit)] = limit
        new = ~seen[at, near]
        seen[at, near] = True
        order = np.sort(np.where(new, near, limit), axis=1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = limit
        width = max(1, int((order < limit).sum(axis=1).max()))
        order = np.sort(order, axis=1)[:, :width]
        valid = order < limit
        s = np.einsum("nkd,nd->nk", x[np.where(valid, order, 0)], q[live])
        s[~valid] = -np.inf
        all_s = np.concatenate([sims[live], s.astype(np.float32)], axis=1)
        all_i = np.concatenate([ids[live], np.where(valid, order, -1).astype(np.int32)], axis=1)
        all_d = np.concatenate([done[live], np.zeros_like(valid)], axis=1)
        top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        r = np.arange(len(live))[:, None]
        sims[live], ids[live], done[live] = all_s[r, top], all_i[r, top], all_d[r, top]
    order = np.argsort(-sims, axis=1, kind="stable")
    return ids[rows, order], sims[rows, order]


class Graph:
    """A hierarchical small-world graph over the rows of ``vectors``."""

    def __init__(self, vectors: np.ndarray, seed: int = 7) -> None:
        level = np.floor(-np.log(np.random.default_rng(seed).random(len(vectors))) / np.log(LINKS)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        level = level[self.order]
        self.vectors = vectors[self.order]
        self.x = self._padded(self.vectors)
        self.sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        self.layers: list[np.ndarray] = [np.empty((0, LINKS), dtype=np.int32)] * len(self.sizes)
        for k in reversed(range(len(self.sizes))):
            self._build(k)

    @staticmethod
    def _padded(v: np.ndarray) -> np.ndarray:
        v = v / np.abs(v).max(initial=1e-320)  # first by the largest component: its square is finite
        v = v / np.sqrt((v**2).sum(axis=1).max(initial=0))
        return np.column_stack([v, np.sqrt(np.maximum(0.0, 1.0 - (v**2).sum(axis=1)))]).astype(np.float32)

    def _entries(self, q: np.ndarray, above: int, limit: int) -> np.ndarray:
        """The best nodes of the layers above for every query."""
        entry = np.zeros((len(q), 1), dtype=np.int64)
        for k in reversed(range(above, len(self.sizes))):
            ids, _ = beam(self.x, self.layers[k], q, entry, 8, min(limit, self.sizes[k]))
            entry = np.where(ids < 0, 0, ids)[:, :4].astype(np.int64)
            entry[:, 1:][entry[:, 1:] == entry[:, :1]] = -1
        return entry

    def _build(self, k: int) -> None:
        n, most = self.sizes[k], LINKS * (2 if k == 0 else 1)
        links = self.layers[k] = np.full((n, most), -1, dtype=np.int32)
        begin = 0
        while begin < n:
            end = min(n, begin + min(BATCH, max(32, begin)))
            q = self.x[begin:end]
            among = q @ q.T  # the batch itself
            np.fill_diagonal(among, -np.inf)
            own = np.argsort(-among, axis=1)[:, : min(LINKS, end - begin)]
            near, sims = own + begin, np.take_along_axis(among, own, axis=1)
            near = np.where(np.isfinite(sims), near, -1)
            if begin:
                ids, s = beam(self.x, links, q, self._entries(q, k + 1, begin), EF_BUILD, begin)
                near, sims = np.concatenate([ids, near], axis=1), np.concatenate([s, sims], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, : EF_BUILD]
            near, sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)
            links[begin:end, :LINKS] = select(near, sims, self.x, LINKS)
            self._link_back(links, begin, end, most)
            begin = end

    def _link_back(self, links: np.ndarray, begin: int, end: int, most: int) -> None:
        """Every new link also the other way; a full node chooses anew among all it is offered."""
        to = links[begin:end, :LINKS].ravel()
        of = np.repeat(np.arange(begin, end, dtype=np.int32), LINKS)
        of, to = of[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        of, to = of[order], to[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        for a in range(0, len(nodes), 1024):
            v, f, c = nodes[a : a + 1024], first[a : a + 1024], count[a : a + 1024]
            offer = np.full((len(v), int(c.max())), -1, dtype=np.int32)
            col = np.arange(offer.shape[1])[None, :] < c[:, None]
            offer[col] = of[np.repeat(f, c) + np.concatenate([np.arange(i) for i in c])]
            near = np.concatenate([links[v], offer], axis=1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            sims = np.where(near >= 0, np.einsum("nkd,nd->nk", self.x[near], self.x[v]), -np.inf)
            order = np.argsort(-sims, axis=1, kind="stable")
            near, sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)
            full = (near >= 0).sum(axis=1) > most
            links[v[~full], : min(most, near.shape[1])] = near[~full][:, :most]
            if full.any():
                links[v[full]] = select(near[full], sims[full], self.x, most)

    def search(self, q: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(node, exact product) of the ``top`` nearest found for every query; -1: none."""
        x = np.column_stack([q / np.abs(q).max(axis=1, keepdims=True), np.zeros(len(q))]).astype(np.float32)
        ids, _ = beam(self.x, self.layers[0], x, self._entries(x, 1, len(self.x)), max(EF_SEARCH, top), len(self.x))
        ids = ids[:, : 2 * top]
        with np.errstate(over="ignore", invalid="ignore"):
            exact = np.where(ids >= 0, np.einsum("nkd,nd->nk", self.vectors[ids], q), -np.inf)
        order = np.argsort(-exact, axis=1, kind="stable")[:, :top]
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(exact, order, axis=1)

    def save(self, out) -> None:
        np.savez(out, order=self.order, vectors=self.vectors, x=self.x, sizes=np.array(self.sizes), **{f"layer{k}": a for k, a in enumerate(self.layers)})

    @classmethod
    def load(cls, raw) -> Graph:
        z, self = np.load(raw), cls.__new__(cls)
        self.order, self.vectors, self.x, self.sizes = z["order"], z["vectors"], z["x"], z["sizes"].tolist()
        self.layers = [z[f"layer{k}"] for k in range(len(self.sizes))]
        return self


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double), dim, and the two halves of the vector's key."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.where(fine).select("vec_id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))


def _save(folder: str, name: str, raw: io.BytesIO) -> str:
    import uuid

    path = f"{folder}/{name}-{uuid.uuid4().hex}.npz"
    fs, at = open_fs(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at) as out:
        out.write(raw.getbuffer())
    return path


def _load(path: str) -> io.BytesIO:
    fs, at = open_fs(path)
    with fs.open_input_file(at) as file:
        return io.BytesIO(file.read())


def _build_with(folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rep"], ignore_index=True)
        g = Graph(np.stack(pdf["v"].to_numpy()).astype(np.float64))
        g.order = pdf["rep"].to_numpy()[g.order]  # from here on: the id of every node
        raw = io.BytesIO()
        g.save(raw)
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "path": [_save(folder, "graph", raw)], "nodes": [len(pdf)]})

    return run


def _blocks_with(folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = io.BytesIO()
        np.savez(raw, q=pdf["q"].to_numpy(), v=np.stack(pdf["v"].to_numpy()).astype(np.float64))
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "asked": [_save(folder, "queries", raw)]})

    return run


def _search_with(top: int):
    def run(frames):
        path, graph = None, None
        for f in frames:
            for p, asked in f.sort_values("path")[["path", "asked"]].itertuples(index=False):
                if p != path:
                    path, graph = p, Graph.load(_load(p))
                z = np.load(_load(asked))
                q, v = z["q"], z["v"]
                for a in range(0, len(q), BATCH):
                    ids, exact = graph.search(v[a : a + BATCH], top)
                    ok = ids >= 0
                    yield pd.DataFrame({"q": np.repeat(q[a : a + BATCH], ok.sum(axis=1)), "rep": graph.order[ids[ok]], "score": exact[ok]})

    return run


def nearest(vectors: DataFrame, top: int = TOP, query_step: int = QUERY_STEP, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest of every row whose id is divisible by ``query_step``."""
    spark = vectors.sparkSession
    rows = materialise(usable(vectors).dropDuplicates(["vec_id", "k1", "k2"]), "vectors")
    nodes = rows.groupBy("dim", "k1", "k2").agg(F.min(F.struct("vec_id", "v")).alias("r")).select("dim", "k1", "k2", F.col("r.vec_id").alias("rep"), F.col("r.v").alias("v"))
    # Bands reach from a power of two over the square root of two to it times that; squares of scaled components stay finite.
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scaled = F.aggregate(F.transform("v", lambda x: x / most), F.lit(0.0), lambda s, x: s + x * x)
    nodes = materialise(nodes.withColumn("band", F.round(F.log2(most) + F.log2(scaled) / 2).cast("int")), "nodes")
    counts = nodes.groupBy("dim", "band").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))  # a row for each length and band
    dealt = nodes.join(counts, ["dim", "band"]).withColumn("shard", F.pmod(F.col("k1"), F.col("shards")))
    n_shards = counts.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    dealt = dealt.repartitionByRange(max(1, n_shards), "dim", "band", "shard")  # about one shard a task; the groups below need no other exchange
    built = materialise(dealt.groupBy("dim", "band", "shard").applyInPandas(_build_with(scratch(spark, "graphs")), "dim int, path string, nodes long"), "graphs")

    # Distinct query vectors in blocks, each block against every graph of its length.
    asked = rows.where(F.col("vec_id") % query_step == 0).select(F.col("vec_id").alias("query_id"), "dim", "k1", "k2")
    q = asked.select("dim", "k1", "k2").distinct().join(nodes.select("dim", "k1", "k2", F.col("rep").alias("q"), "v"), ["dim", "k1", "k2"])
    n_blocks = max(1, -(-asked.count() // QUERY_ROWS))
    q = q.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "q"), F.lit(n_blocks)))
    blocks = materialise(q.groupBy("dim", "block").applyInPandas(_blocks_with(scratch(spark, "queries")), "dim int, asked string"), "queries")
    tasks = built.join(blocks, "dim").select("path", "asked")
    tasks = tasks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", F.pmod(F.xxhash64("asked"), F.lit(4)))
    found = materialise(tasks.mapInPandas(_search_with(top + 1), "q long, rep long, score double"), "found")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top + 1).drop("n")

    # Nodes to ids: of equal vectors the least ids, as many as one answer can hold.
    ids = Window.partitionBy("dim", "k1", "k2").orderBy("vec_id")
    copies = rows.withColumn("n", F.row_number().over(ids)).where(F.col("n") <= top + 1).join(nodes.select("dim", "k1", "k2", "rep"), ["dim", "k1", "k2"]).select("rep", "vec_id")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.join(copies, "rep").withColumn("n", F.row_number().over(best)).where(F.col("n") <= top + 1).drop("n", "rep")

    own = asked.join(nodes.select("dim", "k1", "k2", F.col("rep").alias("q")), ["dim", "k1", "k2"]).select("query_id", "q")
    out = own.join(found, "q").where("vec_id != query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
