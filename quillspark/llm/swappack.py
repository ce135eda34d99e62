"""Packing of documents into as few sequences as possible by swap-based local search (operator 11).

A document's ids (with an end id) stay together up to ``window``; longer ones are cut into full windows,
each a sequence of its own, and a last piece.  The pieces below ``window`` are dealt by hash into shards of about
``SHARD_ITEMS`` and put one after another into the tightest sequence that has room, in no order of size.
The search then takes underfull sequences, least filled first, and shifts tokens from each into others: it moves a
piece, or exchanges one for one, two for one or one for two, whenever the sum of squared fills grows.  Of the exchanges
that a piece or a pair offers it takes the one that leaves the smallest gap, and of these the one with the largest growth.
A sequence that becomes empty goes.  The search ends when a shard has as few sequences as its tokens fill, when no
exchange helps, or after ``EFFORT`` trials for each piece.

What a shard couldn't fill goes on: the pieces of its underfull sequences are dealt anew, until one shard has
them all or a round leaves more than half of them open.  So no shard's remainder is wasted, and no task holds more than about one shard.

Only lengths and checksums are shuffled, never the ids.

Defined results: null or empty text is a document of the end id alone; every row is packed, repeated ids too; a
null doc_id stays null; a very long text is many full windows; an empty table gives no rows; pieces of the same
length are alike and stay in the order of their rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packing, tokens
from .common import materialise

WINDOW = 2048
END_ID = 0
#: Pieces in a shard, on average.
SHARD_ITEMS = 4096
#: Most trials of an exchange for each piece of a shard: a bound of time, after which the packing stands as it is.
EFFORT = 2

PACKED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("ids_crc32", T.LongType(), False),
        T.StructField("sequence_id", T.LongType(), False),
        T.StructField("offset", T.LongType(), False),
    ]
)
SEARCHED = T.StructType([f for f in packing.PIECES if f.name != "doc_tokens"] + [T.StructField(n, T.LongType(), False) for n in ("sequence_id", "offset", "fill")])


class Sequences:
    """Pieces in sequences, and what each underfull sequence offers for an exchange.

    An offer is what a sequence may give back: nothing, one piece or two.  It stands under the amount that would then
    fill the sequence to the brim, so the tightest exchange for an incoming amount is the first valid offer at it or above.
    """

    def __init__(self, lengths: list[int], window: int) -> None:
        self.window = window
        self.held: list[Counter[int]] = []  # lengths in each sequence
        self.fill: list[int] = []
        self.ones: list[dict[int, int]] = [{} for _ in range(window + 1)]  # amount -> sequence -> what it gives
        self.twos: list[dict[int, int]] = [{} for _ in range(window + 1)]
        free = packing.Capacities(window)
        for size in lengths:
            found = free.take(size)
            if found is None:
                found = (window, len(self.held))
                self.held.append(Counter())
                self.fill.append(0)
            capacity, s = found
            self.held[s][size] += 1
            self.fill[s] += size
            free.put(capacity - size, s)
        self.count = len(self.held)
        for s in range(self.count):
            self._offer(s, True)

    def _offer(self, s: int, there: bool) -> None:
        """Write down or strike out what a sequence offers."""
        gap = self.window - self.fill[s]
        if not gap or not self.fill[s]:
            return
        sizes = sorted(self.held[s])
        ones = [0, *sizes]
        twos = [a + b for i, a in enumerate(sizes) for b in sizes[i:] if a != b or self.held[s][a] > 1]
        for table, amounts in ((self.ones, ones), (self.twos, twos)):
            for y in amounts:
                if there:
                    table[y + gap][s] = y
                else:
                    table[y + gap].pop(s, None)

    def _tightest(self, table: list[dict[int, int]], victim: int, amount: int, least: int, reach: int) -> tuple[int, int] | None:
        """(sequence, what it gives back) of the valid offer that leaves the smallest gap."""
        own = self.fill[victim]
        for brim in range(amount, min(self.window + 1, amount + reach)):  # what comes back is smaller than what goes
            for s, y in table[brim].items():
                shift = amount - y
                if s != victim and y >= least and shift > 0 and self.fill[s] + shift > own:
                    return s, y
        return None

    def widest(self, victim: int) -> int:
        """The widest gap of the other sequences; the exchanges out of ``victim`` only narrow it."""
        return self.window - min((f for s, f in enumerate(self.fill) if f and s != victim), default=self.window)

    def exchange(self, victim: int, reach: int) -> bool:
        """The best exchange out of a sequence; False if none lets the squared fills grow."""
        sizes = sorted(self.held[victim], reverse=True)
        best = None
        for i, a in enumerate(sizes):
            trials = [((a,), self.ones, 0), ((a,), self.twos, 0)]
            trials += [((a, b), self.ones, 1) for b in sizes[i:] if a + b <= self.window and (a != b or self.held[victim][a] > 1)]
            for given, table, least in trials:
                found = self._tightest(table, victim, sum(given), least, reach)
                if found:
                    s, y = found
                    shift = sum(given) - y
                    growth = shift * (self.fill[s] - self.fill[victim] + shift)
                    if best is None or growth > best[0]:
                        best = growth, given, s, y, table is self.twos
        if best is None:
            return False
        _, given, s, y, two = best
        back = self._two(s, y) if two else (y,) if y else ()
        for side in (victim, s):
            self._offer(side, False)
        self.held[victim] = self.held[victim] - Counter(given) + Counter(back)
        self.held[s] = self.held[s] - Counter(back) + Counter(given)
        shift = sum(given) - y
        self.fill[victim] -= shift
        self.fill[s] += shift
        for side in (victim, s):
            self._offer(side, True)
        self.count -= not self.fill[victim]
        return True

    def _two(self, s: int, y: int) -> tuple[int, int]:
        held = self.held[s]
        return next((a, y - a) for a in sorted(held) if held[y - a] > (2 * a == y))


def search(lengths: list[int], window: int = WINDOW, effort: int = EFFORT) -> list[tuple[int, int]]:
    """(sequence, offset) for every length, each from 1 to ``window``."""
    seqs = Sequences(lengths, window)
    total = sum(lengths)
    least = -(-total // window)
    left = effort * len(lengths)
    emptied = True
    while emptied and seqs.count > least and left > 0:
        emptied = False
        order = [(f, s) for s, f in enumerate(seqs.fill) if 0 < f < window]
        heapq.heapify(order)
        stuck = 0  # gaps of the sequences that couldn't be emptied: no use to the later, fuller ones
        while order and seqs.count > least and left > 0:
            f, victim = heapq.heappop(order)
            if f != seqs.fill[victim]:  # changed since: it stands at its new fill
                if 0 < seqs.fill[victim] < window:
                    heapq.heappush(order, (seqs.fill[victim], victim))
                continue
            if f > seqs.count * window - total - (window - f) - stuck:
                break  # the other gaps can't take its pieces, nor those of a fuller one
            reach, left = seqs.widest(victim), left - 1
            while seqs.fill[victim] and left > 0 and seqs.exchange(victim, reach):
                left -= 1
            emptied |= not seqs.fill[victim]
            stuck += (window - seqs.fill[victim]) if seqs.fill[victim] else 0
    # Hand the places to the pieces: those of one length are alike.
    waiting: dict[int, list[int]] = {}
    for i in reversed(range(len(lengths))):
        waiting.setdefault(lengths[i], []).append(i)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    n = 0
    for held in seqs.held:
        at = 0
        for size in sorted(held.elements(), reverse=True):
            out[waiting[size].pop()] = (n, at)
            at += size
        n += bool(held)
    return out


def _search_with(window: int, turn: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable", ignore_index=True)
        place = search(pdf["length"].tolist(), window)
        pdf["sequence_id"] = [s for s, _ in place]
        pdf["offset"] = [o for _, o in place]
        pdf["fill"] = pdf.groupby("sequence_id")["length"].transform("sum")
        pdf["sequence_id"] += (pdf["shard"] + 1) * (1 << 30) + (turn << 56)
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf[SEARCHED.names]

    return run


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per piece of a document, with its sequence and its place there."""
    path = tokenizer or tokens.tokenizer_path()
    pieces = materialise(docs.select("doc_id", "text").mapInPandas(packing._pieces_with(path, window, end_id), packing.PIECES), "swap-pieces").drop("doc_tokens")
    full = F.col("length") == window
    own = pieces.where(full).withColumns({"sequence_id": -F.col("row") - 1, "offset": F.lit(0).cast("long"), "fill": F.lit(window).cast("long")})
    rest, parts, turn = pieces.where(~full), [own], 0
    left = rest.count()
    while left:
        shards = max(1, left // shard_items)
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(shards)))
        done = materialise(dealt.groupBy("shard").applyInPandas(_search_with(window, turn), SEARCHED), f"swap-{turn}")
        open_ = F.col("fill") * 64 < 63 * window
        before, left = left, done.where(open_).count() if shards > 1 else 0
        if 2 * left > before:
            left = 0
        parts.append(done.where(~open_) if left else done)
        rest, turn = done.where(open_).select(pieces.columns), turn + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", (F.col("start") / window).cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
