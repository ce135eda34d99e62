"""Alignment of source and translated segments, and locating passages in it."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.scratch import written

#: Characters of a needle and of a candidate that are compared for a partial match, as surveyed; ``locate`` also compares whole ones.
NEEDLE, CANDIDATE = 1600, 4000
THRESHOLD = 0.55
#: Entries that are so much worse than the best one can still win by their place.
SLACK = 0.02
GRAM = 8
#: Neighbouring grams of which the least hash is a print, at each grain.
WINDOWS = (1, 4, 16, 48)
#: Characters of a document's entries that a task holds together, and pairs that it judges together.
BLOCK, PAIRS = 1_000_000, 1_000_000
#: The least share of a needle that a common run holds which can still win.
SHARE = (THRESHOLD - SLACK) / 0.92 - 1e-9
#: The scores of a needle's candidates.
Judge = Callable[[str, list[str]], list[float]]


def zip_pairs(sources: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """i-th source with i-th target of a key, only where both counts agree; sources and targets: key, ord, text."""

    def numbered(rows, name):
        kept = rows.where(F.coalesce(X.strip("text"), F.lit("")) != "")
        w = Window.partitionBy(key)
        return kept.select(key, (F.row_number().over(w.orderBy("ord")) - 1).alias("index"), F.count("*").over(w).alias(f"n_{name}"), F.col("text").alias(name))

    both = numbered(sources, "original").join(numbered(targets, "translated"), [key, "index"]).where("n_original = n_translated")
    return both.select(key, F.col("index").cast("long").alias("index"), (F.col("index") / F.greatest(F.lit(1), F.col("n_original") - 1)).alias("position"), "original", "translated")


def neighbours(entries: DataFrame, most: int = 400) -> DataFrame:
    """Every entry (doc_id, pos, line) with the text before and behind it."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    cut = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(most))
    return entries.withColumns({"before": cut(F.lag("line").over(w)), "behind": cut(F.lead("line").over(w))})


class Automaton:
    """The suffix automaton of a text: it reads the longest run that the text shares with another one in a step for each character."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for c in text:
            new = self._state({}, self.size[last] + 1)
            at = last
            while at >= 0 and c not in self.next[at]:
                self.next[at][c] = new
                at = self.link[at]
            if at >= 0:
                to = self.next[at][c]
                if self.size[to] != self.size[at] + 1:  # longer ones end here too: a state of its own for the shorter
                    own = self._state(dict(self.next[to]), self.size[at] + 1)
                    self.link[own], self.link[to] = self.link[to], own
                    while at >= 0 and self.next[at].get(c) == to:
                        self.next[at][c] = own
                        at = self.link[at]
                    to = own
                self.link[new] = to
            else:
                self.link[new] = 0
            last = new

    def _state(self, onward: dict[str, int], size: int) -> int:
        self.next.append(onward)
        self.link.append(-1)
        self.size.append(size)
        return len(self.size) - 1

    def longest(self, text: str) -> int:
        """Length of the longest common run."""
        step, link, size = self.next, self.link, self.size
        at = run = best = 0
        for c in text:
            while at and c not in step[at]:
                at = link[at]
                run = size[at]
            if c in step[at]:
                at = step[at][c]
                run += 1
                if run > best:
                    best = run
        return best


def _same(a: str, b: str) -> int:
    """How many characters two texts have in common from their beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        at = (low + high) // 2
        if a[low:at] == b[low:at]:
            low = at
        else:
            high = at
    return low


def common_run(needle: str, text: str, least: int, most: int = 64) -> int:
    """Length of the longest common run of characters, if it has ``least`` or more; else 0.

    Of the needle's pieces of half that length such a run holds one whole; it is read from wherever the text has one.
    Where it has them at more than ``most`` places, an automaton reads it.
    """
    size, best, places = (max(1, least) + 1) // 2, 0, 0
    for i in range(0, len(needle) - size + 1, size):
        piece, at = needle[i : i + size], -1
        while (at := text.find(piece, at + 1)) >= 0:
            places += 1
            if places > most:
                best = Automaton(needle).longest(text)
                return best if best >= least else 0
            back = _same(needle[:i][::-1], text[max(0, at - i) : at][::-1])
            best = max(best, back + size + _same(needle[i + size :], text[at + size : at + len(needle) - i]))
    return best if best >= least else 0


def tiers(partial: bool, most: int | None = CANDIDATE) -> Judge:
    """1 for a containing candidate, up to 0.98 for a contained one, else by the longest common run in its first ``most`` characters (None: in all).

    0 below what can still win: beside a containing one nothing else can, as what is contained and shorter has less than 0.97.
    """

    def score(needle: str, candidate: str) -> float:
        if len(candidate) >= 8 and candidate in needle:
            return min(0.98, 0.72 + len(candidate) / len(needle) * 0.25)
        if not partial:
            return 0.0
        return common_run(needle, candidate[:most], int(len(needle) * SHARE)) / len(needle) * 0.92

    def scores(needle: str, candidates: list[str]) -> list[float]:
        held = [needle in c for c in candidates]
        return [float(h) for h in held] if any(held) else [score(needle, c) for c in candidates]

    return scores


def _level(run: np.ndarray, gram: np.ndarray | int = GRAM) -> np.ndarray:
    """The widest window of grams that runs of so many characters fill."""
    return np.select([run - gram + 1 >= w for w in sorted(WINDOWS, reverse=True)], sorted(WINDOWS, reverse=True), 1)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _grams(codes: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the gram that begins at each place."""
    h = np.zeros(len(codes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(gram, len(codes))):
            h *= np.uint64(0x100000001B3)
            h[: len(codes) - k] += codes[k:]
            h += np.uint64(1)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def _minima(grams: np.ndarray, lengths: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Prints and their texts: of texts side by side, the least hashes of windows of ``grams``, each once in a row of equal ones."""
    h, size = grams.copy(), 1
    while size < window:  # minima of twice as many places, at last of the window
        step = min(size, window - size)
        h[: max(0, len(h) - step)] = np.minimum(h[: max(0, len(h) - step)], h[step:])
        size += step
    count = np.maximum(0, lengths - (gram + window - 2))  # windows that end within their text
    row = np.repeat(np.arange(len(lengths)), count)
    begins = np.cumsum(lengths) - lengths
    h = h[np.arange(len(row)) + (begins - (np.cumsum(count) - count))[row]]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    # 32 bits, other ones at each grain: a chance meeting is one more candidate pair, no more.
    return ((h[fresh] >> np.uint64(32)) ^ np.uint64(0x9E3779B1 * (gram * 1000 + window) % 2**32)).astype(np.uint32), row[fresh]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _prints(keys: pd.Series, grams: pd.Series, windows: pd.Series) -> pd.Series:
    """The least hash of every window of grams; of a key too short for a window none.  Hashes roll over all keys of a batch at once."""
    out = np.empty(len(keys), dtype=object)
    texts = [k if isinstance(k, str) else "" for k in keys]
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, grain in enumerate(zip(grams, windows, strict=True)):
        kinds.setdefault(grain, []).append(i)
    for (gram, window), rows in kinds.items():
        begin = 0
        while begin < len(rows):  # some millions of characters at a time
            end, total = begin, 0
            while end < len(rows) and (end == begin or total + len(texts[rows[end]]) < 2_000_000):
                total += len(texts[rows[end]])
                end += 1
            part = [texts[i] for i in rows[begin:end]]
            found, row = _minima(_grams(_codes(part), int(gram)), np.array([len(t) for t in part]), int(gram), int(window))
            for i, own in zip(rows[begin:end], np.split(found.view(np.int32), np.searchsorted(row, np.arange(1, len(part)))), strict=True):
                out[i] = own
            begin = end
    return pd.Series(out)


class _Texts:
    """Texts of groups side by side, and their prints as (group and print, text)."""

    def __init__(self, texts: list[str], groups: list[int]) -> None:
        self.texts, self.groups = texts, np.array(groups, dtype=np.int64)
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.grams: np.ndarray | None = None

    def prints(self, gram: int, window: int, wanted: np.ndarray, first: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The prints of the wanted texts; ``first``: of their first windows alone."""
        if gram == GRAM and not first and 2 * wanted.sum() > len(wanted):  # made once for all windows
            if self.grams is None:
                self.grams = _grams(_codes(self.texts), GRAM)
            found, row = _minima(self.grams, self.sizes, gram, window)
            kept = wanted[row]
            found, row = found[kept], row[kept]
        else:
            rows = np.flatnonzero(wanted & (self.sizes >= gram + window - 1))
            part = [self.texts[i][: gram + window - 1] if first else self.texts[i] for i in rows]
            found, row = _minima(_grams(_codes(part), gram), np.array([len(t) for t in part], dtype=np.int64), gram, window)
            row = rows[row]
        return self.groups[row] << 32 | found.astype(np.int64), row


def _pairs(needles: _Texts, entries: _Texts, share: float, inner: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Needles and entries of one group that share a print, each pair once, all pairs of a needle together, some pairs at a time."""
    groups = 1 + max(needles.groups.max(initial=-1), entries.groups.max(initial=-1))
    met, told, beyond = [], [], 0

    def among(wanted: np.ndarray, one: _Texts, other: _Texts) -> np.ndarray:
        have = np.zeros(groups, dtype=bool)
        have[one.groups[wanted]] = True
        return have[other.groups]

    def meet(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> None:
        nonlocal beyond
        order = np.argsort(right[0])
        keys = right[0][order]
        begin, end = np.searchsorted(keys, left[0], "left"), np.searchsorted(keys, left[0], "right")
        hit = end > begin
        met.append((left[1][hit], begin[hit] + beyond, end[hit] + beyond))
        told.append(right[1][order])
        beyond += len(order)

    run = needles.sizes if share >= 1 else np.maximum(1, np.ceil(needles.sizes * share).astype(np.int64))
    gram = np.minimum(GRAM, run)
    window = _level(run, gram)
    for g, w in sorted(set(zip(gram.tolist(), window.tolist(), strict=True))):
        own = (gram == g) & (window == w) & (run > 0)
        if own.any():
            meet(needles.prints(g, w, own, share >= 1), entries.prints(g, w, among(own, needles, entries)))
    if inner:
        level = _level(entries.sizes)
        for w in WINDOWS:
            own = (level == w) & (entries.sizes >= GRAM)
            if own.any():
                meet(needles.prints(GRAM, w, among(own, entries, needles)), entries.prints(GRAM, w, own, True))
    if not met:
        return
    rows, begin, end = (np.concatenate(x) for x in zip(*met, strict=True))
    told = np.concatenate(told)
    order = np.argsort(rows, kind="stable")
    rows, begin, size = rows[order], begin[order], (end - begin)[order]
    ends = np.cumsum(size)
    at = 0
    while at < len(rows):  # whole needles, of some pairs together
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right"))
        stop = int(np.searchsorted(rows, rows[min(max(stop, at + 1), len(rows)) - 1], "left" if stop < len(rows) else "right"))
        if stop <= at:  # a needle of many pairs
            stop = int(np.searchsorted(rows, rows[at], "right"))
        n = size[at:stop]
        place = np.arange(n.sum()) + np.repeat(begin[at:stop] - (np.cumsum(n) - n), n)
        pair = np.unique(np.repeat(rows[at:stop], n) * len(entries.texts) + told[place])
        yield pair // len(entries.texts), pair % len(entries.texts)
        at = stop


class _Places:
    """Rows of one text by place: the one nearest to a place, ties to the lesser idx; without a place the least idx."""

    def __init__(self, rows: list[tuple[float | None, int, int]]) -> None:
        self.open = [r for r in rows if r[0] is None]
        self.rows = sorted(r for r in rows if r[0] is not None)
        self.least = min(self.open or rows, key=lambda r: r[1])[2]

    def nearest(self, at: float | None) -> int:
        if at is None or self.open:
            return self.least
        k = bisect_left(self.rows, (at,))
        near = [self.rows[k]] if k < len(self.rows) else []
        if k:  # of equal places the first one
            near.append(self.rows[bisect_left(self.rows, (self.rows[k - 1][0],))])
        return min(near, key=lambda r: (abs(r[0] - at), r[1]))[2]


def _judged(judge: Judge | None, share: float, slack: float, inner: bool, begin: int | None):
    """Reads rows by group, entries before needles, and gives the pairs that ``judge`` finds good enough; a group's entries are held, its needles pass by."""

    def read(table: pa.Table) -> tuple[pa.Table, tuple[int, int]]:
        """Pairs, and which rows are the last group's entries."""
        doc, block, side, text = (table[c].to_pylist() for c in ("doc_id", "block", "side", "text"))
        at, idx, position = (table[c].to_pylist() for c in ("at", "idx", "position"))
        number, open_, group, last = -1, 0, [], None
        for i, key in enumerate(zip(doc, block, strict=True)):
            if key != last:
                number, open_, last = number + 1, i, key
            group.append(number)
        known: tuple[dict, dict] = {}, {}
        for i, (g, s, t) in enumerate(zip(group, side, text, strict=True)):
            known[s].setdefault((g, t), []).append(i)
        entries, needles = (_Texts([t for _, t in k], [g for g, _ in k]) for k in known)
        asks = needles if begin is None else _Texts([t[:begin] for t in needles.texts], needles.groups.tolist())
        told, asked = list(known[0].values()), list(known[1].values())
        places: dict[int, _Places] = {}
        out: list[tuple[int, int, float]] = []
        for ns, cs in _pairs(asks, entries, share, inner):
            first = np.flatnonzero(np.diff(ns, prepend=-1)).tolist()
            ns, cs = ns.tolist(), cs.tolist()
            if judge is None:
                out += [(a, b, 0.0) for n, c in zip(ns, cs, strict=True) for a in asked[n] for b in told[c]]
                continue
            for start, end in zip(first, [*first[1:], len(ns)]):
                n, own = ns[start], cs[start:end]
                scores = judge(needles.texts[n], [entries.texts[c] for c in own])
                best = max(scores)
                for c, x in zip(own, scores, strict=True):
                    if x > 0 and x >= best - slack:
                        if c not in places:
                            places[c] = _Places([(position[i], idx[i], i) for i in told[c]])
                        out += [(a, places[c].nearest(at[a]), x) for a in asked[n]]
        a, b, x = zip(*out, strict=True) if out else ((), (), ())
        a, b = pa.array(a, pa.int64()), pa.array(b, pa.int64())
        one = [table[c].take(a) for c in ("n_id", "doc_id", "at")] + [table[c].take(b) for c in ("idx", "position")] + [pa.chunked_array([pa.array(x, pa.float64())])]
        names = ["n_id", "doc_id", "at", "idx", "position", "score"]
        # What is read next may go on with the last group: its entries stay.
        held = next((i for i in range(open_, len(side)) if side[i]), len(side))
        return pa.table(dict(zip(names, one, strict=True))), (open_, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, size, most = None, [], 0, BLOCK
        for batch in batches:
            fresh.append(batch)
            size += batch.nbytes
            if size >= most:
                table = pa.Table.from_batches(([] if held is None else held.to_batches()) + fresh)
                found, (begin_, end) = read(table)
                yield from found.to_batches()
                held = table.slice(begin_, end - begin_)
                fresh, size, most = [], 0, max(BLOCK, held.nbytes)
        if fresh:
            yield from read(pa.Table.from_batches(([] if held is None else held.to_batches()) + fresh))[0].to_batches()

    return run


def _met(needles: DataFrame, entries: DataFrame, judge: Judge | None, share: float, slack: float = 0.0, inner: bool = True, begin: int | None = None) -> DataFrame:
    """n_id, doc_id, at, idx, position, score of needles with entries of their document that ``judge`` finds within ``slack`` of the best one; of entries of one text the nearest.

    needles: n_id, doc_id, at, needle; entries: doc_id, idx, position, candidate, size (about its characters).  Entries of a document of more than ``BLOCK``
    characters are dealt into blocks, and its needles go to each of them (a best one is then one of its block).  Needles and entries are moved once, side by side.
    Prints are made and met within a task: winnowed, so that two texts with a common run of ``share`` of the needle, or (``inner``) a candidate of
    ``GRAM`` characters or more inside the needle, share one.  ``begin``: so many characters of a needle are asked for.  Without ``judge`` all pairs that share a print are given.
    """
    long = entries.groupBy("doc_id").agg(F.sum(F.col("size") + 32).alias("n")).where(F.col("n") > BLOCK)
    long = F.broadcast(long.select("doc_id", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))  # one row for a million characters at most
    kind = needles.schema["n_id"].dataType
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    own = F.coalesce(F.pmod(F.xxhash64("idx"), F.col("blocks")).cast("int"), F.lit(0))
    every = F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)
    one = entries.join(long, "doc_id", "left").select("doc_id", own.alias("block"), F.lit(0).alias("side"), none(kind, "n_id"), none("double", "at"), F.col("idx").cast("long").alias("idx"), F.col("position").cast("double").alias("position"), F.col("candidate").alias("text"))
    two = needles.join(long, "doc_id", "left").select("doc_id", F.explode(every).alias("block"), F.lit(1).alias("side"), "n_id", F.col("at").cast("double").alias("at"), none("long", "idx"), none("double", "position"), F.col("needle").alias("text"))
    rows = one.unionByName(two).repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "side")
    f = lambda name, t: T.StructField(name, t)
    schema = T.StructType([f("n_id", kind), f("doc_id", rows.schema["doc_id"].dataType), f("at", T.DoubleType()), f("idx", T.LongType()), f("position", T.DoubleType()), f("score", T.DoubleType())])
    return rows.mapInArrow(_judged(judge, share, slack, inner, begin), schema)


def candidates(needles: DataFrame, entries: DataFrame, share: float = SHARE) -> DataFrame:
    """n_id, doc_id, idx of pairs of one document where a run of ``share`` of the needle is common, or the needle contains a candidate of 8 characters or more.

    Winnowed fingerprints: a key's prints are the least hashes of its windows of neighbouring grams, so two keys with a common run that
    fills a window share a print.  A needle asks at the widest grain that such a run of it fills; a candidate inside a needle, and a needle that must
    be found whole, is asked for by one print alone.  Runs too short for a gram of 8 ask by grams of their own length.
    The pairs are a superset; a score decides.
    """
    asked = needles.select("n_id", "doc_id", F.lit(None).cast("double").alias("at"), "needle")
    told = entries.where("candidate != ''").select("doc_id", "idx", F.lit(None).cast("double").alias("position"), "candidate", F.length("candidate").alias("size"))
    return _met(asked, told, None, share).select("n_id", "doc_id", "idx")


def locate(selections: DataFrame, entries: DataFrame, partial: bool = True, whole: bool = False) -> DataFrame:
    """The best entry of a selection's document, if good enough.

    selections: n_id, doc_id, selected, page_ratio; entries: doc_id, idx, position, original.
    ``whole``: selections and entries of any length are compared to their ends, not by their first characters.
    Of the entries within 0.02 of the best score, the one nearest to the page ratio wins,
    then the earlier one.
    """
    key = X.match_key("selected")
    needles = selections.select("n_id", "doc_id", F.col("page_ratio").alias("at"), (key if whole else F.left(key, F.lit(NEEDLE))).alias("needle")).where("needle != ''")
    keyed = entries.select("doc_id", "idx", "position", X.match_key("original").alias("candidate"), F.coalesce(F.length("original"), F.lit(0)).alias("size")).where("candidate != ''")
    pairs = _met(needles, keyed, tiers(partial, None if whole else CANDIDATE), SHARE if partial else 1.0, SLACK)
    best = F.max("score").over(Window.partitionBy("n_id"))
    pairs = pairs.withColumn("best", best).where((F.col("best") >= THRESHOLD) & (F.col("score") >= F.col("best") - SLACK))
    w = Window.partitionBy("n_id").orderBy(F.abs(F.col("position") - F.col("at")), "idx")
    won = pairs.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return won.select("n_id", "doc_id", "idx", "position", X.clamp(F.col("best")).alias("confidence"))


def cuts_of(cuts: tuple[int, ...]) -> Judge:
    """How many characters of a needle's beginning a page holds: all, or the first of the cuts that it does."""

    def match(needle: str, page: str) -> float:
        if needle in page:
            return float(len(needle))
        return float(next((c for c in cuts if len(needle) > c and needle[:c] in page), 0))

    return lambda needle, pages: [match(needle, p) for p in pages]


def best_page(targets: DataFrame, pages: DataFrame, cuts: tuple[int, ...] = (120, 60, 24), least: int = 12) -> DataFrame:
    """The page of a document that holds the longest beginning of the target: whole, then 120, 60, 24 characters.

    targets: t_id, doc_id, needle (key), hint; pages: doc_id, page, key.  Ties to the page nearest to the hint.
    Whatever is cut, the shortest beginning is in it: a target asks by one print of that for the pages that can hold it.
    """
    asked = targets.where(F.length("needle") >= max(1, least)).select(F.col("t_id").alias("n_id"), "doc_id", F.col("hint").alias("at"), "needle")
    told = pages.where("key != ''").select("doc_id", F.col("page").alias("idx"), F.col("page").alias("position"), F.col("key").alias("candidate"), F.length("key").alias("size"))
    pairs = _met(asked, told, cuts_of(cuts), 1.0, inner=False, begin=min(cuts))
    w = Window.partitionBy("n_id").orderBy(F.desc("score"), F.abs(F.col("position") - F.col("at")), "idx")
    won = pairs.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return won.select(F.col("n_id").alias("t_id"), "doc_id", F.col("idx").cast(pages.schema["page"].dataType).alias("page"), F.col("score").cast("long").alias("match"))


def quote_contexts(quotes: DataFrame, entries: DataFrame, most: int = 400, longest: int = 600) -> DataFrame:
    """n_id, doc_id, idx, side, quote, own, other, before, behind of every quote (n_id, doc_id, selected) that its document's entries hold.

    entries: doc_id, idx (from 0, without gaps), position, original, translated.  A quote is located among the originals, else among the translations; ``own`` is the
    entry's text on that side, ``other`` the one on the other side, and the originals next to it are cut to ``most`` characters.  Texts are plain.
    """
    asked = quotes.withColumn("page_ratio", F.lit(0.0))
    one = locate(asked, entries)
    rest = asked.join(one.select("n_id"), "n_id", "left_anti")
    two = locate(rest, entries.withColumn("original", F.col("translated")))
    found = one.select("n_id", "doc_id", "idx", F.lit("original").alias("side")).unionByName(two.select("n_id", "doc_id", "idx", F.lit("translated").alias("side")))
    w = Window.partitionBy("doc_id").orderBy("idx")
    near = lambda c: F.left(F.coalesce(X.plain(c), F.lit("")), F.lit(most))
    told = entries.select("doc_id", "idx", X.plain("original").alias("source"), X.plain("translated").alias("target"), near(F.lag("original").over(w)).alias("before"), near(F.lead("original").over(w)).alias("behind"))
    first = F.col("side") == "original"
    joined = found.join(told, ["doc_id", "idx"]).join(quotes.select("n_id", F.left("selected", F.lit(longest)).alias("quote")), "n_id")
    return joined.select("n_id", "doc_id", "idx", "side", "quote", F.when(first, F.col("source")).otherwise(F.col("target")).alias("own"), F.when(first, F.col("target")).otherwise(F.col("source")).alias("other"), "before", "behind")


def page_of(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """t_id, doc_id, page, match: the best page of the highlight, else of the block, else the hinted page (match 0).

    targets: t_id, doc_id, highlight and block (keys), hint.
    """
    first = best_page(targets.withColumn("needle", F.col("highlight")), pages)
    rest = targets.join(first.select("t_id"), "t_id", "left_anti")
    second = best_page(rest.withColumn("needle", F.col("block")), pages)
    last = rest.join(second.select("t_id"), "t_id", "left_anti").select("t_id", "doc_id", F.col("hint").alias("page"), F.lit(0).cast("long").alias("match"))
    return first.unionByName(second).unionByName(last)


def caption_pairs(blocks: DataFrame, captions: DataFrame) -> DataFrame:
    """Source captions with the translated caption of the same label; of repeated labels the last counts.

    blocks: doc_id, pos, caption, n_blocks; captions: doc_id, pos, caption.
    """
    label = X.caption_label("caption")
    told = captions.select("doc_id", label.alias("label"), "pos", "caption").where("label is not null").groupBy("doc_id", "label").agg(F.max_by("caption", "pos").alias("translated"))
    own = blocks.select("doc_id", label.alias("label"), "pos", "n_blocks", X.labelled_suffix("caption").alias("original")).where("label is not null")
    w = Window.partitionBy("doc_id").orderBy("pos")
    return own.join(told, ["doc_id", "label"]).select("doc_id", (F.row_number().over(w) - 1).alias("index"), (F.col("pos") / F.greatest(F.lit(1), F.col("n_blocks") - 1)).alias("position"), "original", "translated")


def page_labels(pages: DataFrame) -> DataFrame:
    """doc_id, kind (figure or table), number (its digits), rank, page: every label of a page once; rank 0 at a line's start, 1 elsewhere.  pages: doc_id, page, text."""
    label = r"(?:figure|fig\.?|table)[\s~]*\d++"
    told = lambda pattern, rank: F.transform(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda m: F.lower(F.trim(m)))), lambda m: F.struct(m.alias("label"), F.lit(rank).alias("rank")))
    each = pages.select("doc_id", "page", F.inline(F.concat(told(rf"(?im)^\s*{label}", 0), told(rf"(?i){label}", 1))))
    kind = F.when(F.col("label").rlike(r"^\s*table"), "table").otherwise("figure")
    return each.select("doc_id", kind.alias("kind"), F.regexp_extract("label", r"(\d+)$", 1).alias("number"), "rank", "page")


def caption_pages(figures: DataFrame, pages: DataFrame) -> DataFrame:
    """First page with the figure's label at a line start, else anywhere; else the page that was given.

    figures: doc_id, kind, number, page.  Pages are read once, for whatever labels they hold; the rest is an equi-join.
    """
    first = page_labels(pages).groupBy("doc_id", "kind", "number").agg(F.min(F.struct("rank", "page"))["page"].alias("found"))
    first = first.select("doc_id", F.col("kind").alias("_kind"), F.col("number").alias("_number"), "found")
    asked = figures.withColumns({"_kind": F.when(F.col("kind") == "figure", "figure").otherwise("table"), "_number": F.col("number").cast("string")})
    return asked.join(first, ["doc_id", "_kind", "_number"], "left").select("doc_id", "kind", "number", F.coalesce("found", "page").alias("page"))


@F.pandas_udf(T.DoubleType())
def likeness(needle, candidate):
    """Share of both texts in matching runs, for pairs that no containment decides."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(needle, candidate, strict=True)], dtype="float64")


_COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789"


def _letters(key: Column) -> Column:
    """How often each letter and digit is in a key, and how many other characters there are."""
    counts = [F.length(key) - F.length(F.replace(key, F.lit(c))) for c in _COUNTED]
    return F.array(*counts, F.length(F.regexp_replace(key, "[a-z0-9]+", "")))


def likest(pairs: DataFrame, least: float) -> DataFrame:
    """n_id, idx of the likeliest candidate of every needle, from ``least`` on; ties to the lesser idx.

    pairs: n_id, idx, needle, key, counts and key_counts of both (``_letters``).  What matching runs can hold at most, the common letters, bounds the likeness.
    The candidate of the largest bound is compared first; then only those whose bound reaches what it got.
    """
    common = F.aggregate(F.zip_with("counts", "key_counts", lambda a, b: F.least(a, b)), F.lit(0), lambda s, x: s + x)
    bound = 2 * common / F.greatest(F.lit(1), F.length("needle") + F.length("key"))
    pairs = pairs.withColumn("bound", bound).where(F.col("bound") >= least)
    slim = written(pairs.select("n_id", "idx", "needle", "key", "bound"), "likest")
    w = Window.partitionBy("n_id").orderBy(F.desc("bound"), "idx")
    first = slim.withColumn("nth", F.row_number().over(w)).where("nth = 1").withColumn("like", likeness("needle", "key")).select("n_id", F.col("idx").alias("first_idx"), F.col("like").alias("first_like"))
    first = written(first, "likest-first")
    # Bound and likeness are quotients of whole numbers that are made alike, so equal ones are equal.
    rest = slim.join(first, "n_id").where((F.col("idx") != F.col("first_idx")) & (F.col("bound") >= F.col("first_like") - 1e-12))
    rest = rest.withColumn("like", likeness("needle", "key")).select("n_id", "idx", "like")
    every = first.select("n_id", F.col("first_idx").alias("idx"), F.col("first_like").alias("like")).unionByName(rest)
    return every.groupBy("n_id").agg(F.max(F.struct("like", (-F.col("idx")).alias("i"))).alias("b")).where(F.col("b.like") >= least).select("n_id", (-F.col("b.i")).alias("idx"))


def locate_without_alignment(selections: DataFrame, sources: DataFrame, targets: DataFrame, least: float = 0.18) -> DataFrame:
    """The target block at the place of a selection's best source block, for documents without alignment.

    The first source block that contains the selection, or is contained in it with more than
    20 characters; else the likeliest one from ``least`` on; else the one at the page ratio.
    selections: n_id, doc_id, selected, page_ratio; sources, targets: doc_id, idx, text.
    """
    sizes = sources.groupBy("doc_id").agg(F.count("*").alias("n")).join(targets.groupBy("doc_id").agg(F.count("*").alias("m")), "doc_id")
    asked = selections.withColumn("needle", F.left(X.match_key("selected"), F.lit(1200)))
    keyed = sources.select("doc_id", "idx", X.match_key("text").alias("key"))
    pairs = asked.where("needle != ''").join(keyed, "doc_id")
    inside = F.contains(F.col("key"), F.col("needle")) | ((F.length("key") > 20) & F.contains(F.col("needle"), F.col("key")))
    first = pairs.where(inside).groupBy("n_id").agg(F.min("idx").alias("idx"))
    cut = lambda name, size: F.left(name, F.lit(size))
    open_ = asked.where("needle != ''").join(first, "n_id", "left_anti").select("n_id", "doc_id", cut("needle", 400).alias("needle"), _letters(cut("needle", 400)).alias("counts"))
    short = keyed.select("doc_id", "idx", cut("key", 1200).alias("key"), _letters(cut("key", 1200)).alias("key_counts"))
    near = likest(open_.join(short, "doc_id"), least)
    found = asked.join(sizes, "doc_id").join(first.unionByName(near), "n_id", "left")
    idx = F.coalesce("idx", F.bround(X.clamp(F.col("page_ratio")) * (F.col("n") - 1), 0).cast("long"))
    ratio = F.col("at") / F.greatest(F.lit(1), F.col("n") - 1)
    placed = found.withColumn("at", idx).select("n_id", "doc_id", "at", ratio.alias("position"), F.bround(ratio * (F.col("m") - 1), 0).cast("long").alias("idx"))
    return placed.join(targets.select("doc_id", "idx", F.left(X.plain("text"), F.lit(1200)).alias("target")), ["doc_id", "idx"]).select("n_id", "doc_id", F.col("at").alias("source_idx"), "idx", "position", "target")


def notes(annotations: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, text: the notes of a document in order of creation, each with its translated counterpart if one is found.

    annotations: id, doc_id, page, quote, note, position_ratio, created_at; entries: doc_id, idx, position, original, translated.
    """
    asked = annotations.select(F.col("id").alias("n_id"), "doc_id", F.col("quote").alias("selected"), F.col("position_ratio").alias("page_ratio"))
    told = locate(asked, entries).join(entries.select("doc_id", "idx", X.plain("translated").alias("told")), ["doc_id", "idx"]).select(F.col("n_id").alias("id"), F.left("told", F.lit(1600)).alias("told"))
    w = Window.partitionBy("doc_id").orderBy("created_at", "id")
    rows = annotations.join(told, "id", "left").withColumn("nth", F.row_number().over(w))
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("\n\n" + head), c)).otherwise("")
    text = F.concat(F.format_string("## %d. 第 %d 页\n\n> ", "nth", "page"), F.col("quote"), part("译文：", F.col("told")), part("**笔记**：", F.col("note")))
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", text.alias("t")))).alias("l"))
    return listed.select("doc_id", F.array_join(F.transform("l", lambda s: s["t"]), "\n\n").alias("text"))
