"""Packing of documents into fixed-size sequences by best fit decreasing (operator 1).

A document's ids (with an end id) are cut into full windows; each is a sequence of its
own.  What is left over of every document is one item of fewer than ``window`` tokens.
Items are dealt by hash into shards of about ``SHARD_ITEMS``; within a shard, in falling
length, a segment tree over remaining capacities finds the tightest open sequence that
still has room, and a new sequence is opened where there is none.  Every shard wastes
about half a sequence beyond what best fit decreasing wastes anyway.

Only lengths and checksums are shuffled, never the ids.

Defined results: null or empty text is a document of the end id alone; every row is
packed, repeated ids too (their pieces are told apart by sequence and offset); a null
doc_id stays null; a very long text is encoded whole and gives many full windows; an empty table has
no rows; other columns are ignored.  A sequence whose used length is a power of
two is left as it is, any other is padded to the window (``padded_length``).
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import as_text, materialise

WINDOW = 4096
END_ID = 2
#: Left-over pieces in a shard, on average.
SHARD_ITEMS = 4096

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("ids_crc32", T.LongType(), False),
        T.StructField("doc_tokens", T.LongType(), False),
        T.StructField("row", T.LongType(), False),
    ]
)
PACKED = T.StructType(
    [f for f in PIECES if f.name != "row"]
    + [T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False), T.StructField("padded_length", T.LongType(), False)]
)


class Capacities:
    """Open sequences by remaining capacity: a segment tree of how many there are in each range."""

    def __init__(self, most: int) -> None:
        self.size = 1
        while self.size <= most:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, n: int) -> None:
        i = self.size + capacity
        while i:
            self.count[i] += n
            i //= 2

    def put(self, capacity: int, sequence: int) -> None:
        if capacity:
            self.open[capacity].append(sequence)
            self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, sequence) of the tightest open sequence with room for ``need``."""
        i, count = self.size + need, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up until a right-hand range has some
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i *= 2
                if not count[i]:
                    i += 1
        capacity = i - self.size
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(sequence, offset) for every length; the lengths come in falling order."""
    tree, out, n = Capacities(window), [], 0
    for size in lengths:
        found = tree.take(size)
        if found is None:
            found, n = (window, n), n + 1
        capacity, sequence = found
        out.append((sequence, window - capacity))
        tree.put(capacity - size, sequence)
    return out


def _pieces_with(path: str, window: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(frames):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        encode = tokens.encoder(path).encode
        for f in frames:
            texts = [as_text(t) for t in f["text"]]
            ids = f["doc_id"].tolist()
            for a, b in tokens.slices(texts):
                out = []
                for doc, raw in zip(ids[a:b], encode(texts[a:b]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for at in range(0, n, window):
                        part = raw[4 * at : 4 * (at + window)]
                        out.append((doc, at, len(part) // 4, zlib.crc32(part), n, row))
                        row += 1
                yield pd.DataFrame(out, columns=PIECES.names).astype({"doc_id": "Int64"})

    return run


def _shard_with(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "row"], ascending=[False, True, True], kind="stable", ignore_index=True)
        place = best_fit(pdf["length"].tolist(), window)
        pdf["sequence_id"] = [s for s, _ in place]
        pdf["offset"] = [o for _, o in place]
        used = pdf.groupby("sequence_id")["length"].transform("sum")
        pdf["padded_length"] = used.where((used & (used - 1)) == 0, window)
        pdf["sequence_id"] += (pdf["shard"] + 1) * (1 << 32)
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf[PACKED.names]

    return run


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of a document, with its sequence and its place there."""
    path = tokenizer or tokens.tokenizer_path()
    pieces = materialise(docs.select("doc_id", "text").mapInPandas(_pieces_with(path, window, end_id), PIECES), "pieces")
    full = F.col("length") == window
    # A full window is a sequence by itself; the pieces' own numbers, negated, tell these apart.
    own = pieces.where(full).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(window).cast("long").alias("padded_length"),
    )
    rest = pieces.where(~full)
    shards = max(1, rest.count() // SHARD_ITEMS)
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return own.unionByName(rest.groupBy("shard").applyInPandas(_shard_with(window), PACKED))
