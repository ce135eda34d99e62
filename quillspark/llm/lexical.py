"""Ranked lexical search by best-first document intervals over posting lists (operator 12).

An index is a table of segments: about ``SEGMENT_DOCS`` documents each, with their terms in posting lists of (document, occurrences).
Frequencies of all documents are summed over the segments; with them every posting has an impact, and every posting list a
sparse table of range maxima.  A query's candidates in a segment are intervals of documents.  The sum over its terms of
the largest impact within an interval bounds every score there.  Intervals are taken in falling order of their bounds, some at a time; each is
split at the document of its largest impact, which is scored exactly, and the two parts are bounded anew.  An
interval whose bound is below the least score that still counts is left; so nothing that could be among the best is missed.
A task carries that least score from segment to segment, and hands on its best rows for each query only.

Within a segment, documents stand by their most frequent terms, so that those of one language or kind are side by side and intervals are told apart early.

Queries are a stated set: a Spark job writes their terms to the shared folder in blocks, and a task holds one block at a time beside one segment.

Defined results: a null text has no terms, such a document counts nowhere; a query without terms or without a document in common
has no rows; repeated document rows are documents of their own (one place each); repeated query rows each get their ranks; a null doc_id
comes first among equal scores, a null item_id is an item; other columns are ignored, whatever their names; a very
long text is a long posting among others; empty tables give no rows.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, materialise, open_fs, scratch
from .decontaminate import _FOLD, words_of

TOP = 10
#: Most documents in a segment, and most words, about; a longer document is a segment of its own.
SEGMENT_DOCS = 8192
SEGMENT_WORDS = 3_000_000
#: Terms of queries in a block, about.
BLOCK_TERMS = 400_000
#: Intervals that are split at a time.
AT_ONCE = 64

SEGMENTS = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("n_docs", T.LongType(), False),
        T.StructField("n_words", T.LongType(), False),
        T.StructField("terms", T.ArrayType(T.BinaryType(), False), False),
        T.StructField("df", T.ArrayType(T.LongType(), False), False),
    ]
)
FOUND = T.StructType([T.StructField("query", T.LongType(), False), T.StructField("item_id", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType(), False)])


class Building:
    """A segment that takes documents."""

    def __init__(self) -> None:
        self.code: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        self.n_words = 0

    def add(self, doc_id: int | None, text: str, step: int = 4_000_000) -> None:
        """A document; one without a term is left out.  A long text's words are taken step by step."""
        raw = text.encode("utf-8", "surrogatepass").translate(_FOLD)
        code, parts, begin = self.code, [], 0
        while begin < len(raw):
            end = raw.find(b" ", begin + step)
            end = len(raw) if end < 0 else end
            parts.append(np.array([code.setdefault(w, len(code)) for w in raw[begin:end].split()], dtype=np.int32))
            begin = end
        found = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        if len(found):
            self.ids.append(doc_id)
            self.words.append(found)
            self.n_words += len(found)

    def done(self) -> dict:
        """The posting lists."""
        docs, terms = len(self.ids), len(self.code)
        n = np.array([len(w) for w in self.words], dtype=np.int64)
        flat = np.concatenate(self.words)
        # Terms by frequency; documents by their most frequent term, then by length: like ones side by side.
        place = np.empty(terms, dtype=np.int64)
        place[np.argsort(-np.bincount(flat, minlength=terms), kind="stable")] = np.arange(terms)
        key, tf = np.unique(np.repeat(np.arange(docs), n) * terms + place[flat], return_counts=True)
        of = key // terms
        best = np.lexsort([key, -tf, of])
        first = best[np.searchsorted(of[best], np.arange(docs))]
        order = np.lexsort([n, key[first] % terms])
        rank = np.empty(docs, dtype=np.int64)
        rank[order] = np.arange(docs)
        # Posting lists: by term, then by the documents' new places.
        words = sorted(self.code)
        by_name = np.empty(terms, dtype=np.int64)
        by_name[place[[self.code[w] for w in words]]] = np.arange(terms)
        term, at = by_name[key % terms], rank[of]
        posted = np.argsort(term * docs + at, kind="stable")
        return {"ids": [self.ids[k] for k in order], "n": n[order], "words": words, "df": np.bincount(term, minlength=terms), "doc": at[posted].astype(np.int32), "tf": tf[posted].astype(np.int32)}


class Lists:
    """A segment's posting lists of some terms, with impacts and range maxima."""

    def __init__(self, seg: dict, wanted: list[bytes], n_docs: int, n_words: int) -> None:
        m = 100 - 90 + (90 * seg["n"] * n_docs) // n_words
        ends = np.cumsum(seg["df"])
        where = {w: k for k, w in enumerate(seg["words"])}
        chosen = [where[w] for w in wanted if w in where]
        self.row = {w: k for k, w in enumerate(w for w in wanted if w in where)}
        size = seg["df"][chosen]
        self.end = np.cumsum(size)
        self.begin = self.end - size
        flat = np.repeat(ends[chosen] - size, size) + np.arange(int(size.sum())) - np.repeat(self.begin, size)
        self.n = len(seg["ids"])
        self.doc = seg["doc"][flat].astype(np.int64)
        tf = seg["tf"][flat].astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc])
        self.key = np.repeat(np.arange(len(chosen)), size) * self.n + self.doc
        # most[h][i]: the place of the largest impact among i .. i + 2**h - 1.
        longest = int(size.max()) if len(chosen) else 0
        self.most = [np.arange(len(flat), dtype=np.int32)]
        while 2 ** len(self.most) <= longest:
            low, half = self.most[-1], 2 ** (len(self.most) - 1)
            high = np.concatenate([low[half:], np.full(half, len(flat) - 1, dtype=np.int32)])
            self.most.append(np.where(self.impact[low] >= self.impact[high], low, high))
        self.most = np.stack(self.most)
        self.log = np.zeros(longest + 2, dtype=np.int64)
        self.log[1:] = np.floor(np.log2(np.arange(1, longest + 2)))

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the largest impact in each list's range [a, b); for empty ranges any place."""
        size = b - a
        h = self.log[size]
        left = self.most[h, np.minimum(a, len(self.doc) - 1)]
        right = self.most[h, np.clip(b - (1 << h), 0, len(self.doc) - 1)]
        return np.where(self.impact[left] >= self.impact[right], left, right)

    def search(self, terms: list[tuple[bytes, int]], best: list[tuple[int, int | None]], ids: list, top: int, at_once: int = AT_ONCE) -> list:
        """``best``, rows of (-score, doc_id) in order, with this segment's documents among them."""
        held = [(self.row[t], w) for t, w in terms if t in self.row]
        if not held:
            return best
        row = np.array([r for r, _ in held])
        weight = np.array([w for _, w in held], dtype=np.int64)
        a, b = self.begin[row][None, :], self.end[row][None, :]

        def bound(a, b):
            place = self.largest(a, b)
            value = np.where(a < b, self.impact[place] * weight, 0)
            return value.sum(1), place[np.arange(len(a)), value.argmax(1)]

        total, peak = bound(a, b)
        while True:
            least = -best[-1][0] if len(best) >= top else 1
            live = np.flatnonzero(total >= max(least, 1))
            if not len(live):
                return best
            if len(live) > at_once:
                live = live[np.argpartition(-total[live], at_once)]
            now, later = live[:at_once], live[at_once:]
            a0, b0 = a[now], b[now]
            doc = self.doc[peak[now]]
            at = np.clip(np.searchsorted(self.key, row[None, :] * self.n + doc[:, None]), a0, b0)
            hit = (at < b0) & (self.doc[np.minimum(at, len(self.doc) - 1)] == doc[:, None])
            score = np.where(hit, self.impact[np.minimum(at, len(self.doc) - 1)] * weight, 0).sum(1)
            fresh = [(-s, ids[d]) for s, d in zip(score.tolist(), doc.tolist(), strict=True) if s >= max(least, 1)]
            if fresh:
                best = sorted(best + fresh, key=lambda x: (x[0], x[1] is not None, x[1] or 0))[:top]
            a1, b1 = np.concatenate([a0, at + hit]), np.concatenate([at, b0])
            t1, p1 = bound(a1, b1)
            a, b = np.concatenate([a[later], a1]), np.concatenate([b[later], b1])
            total, peak = np.concatenate([total[later], t1]), np.concatenate([peak[later], p1])


def _save(folder: str, what) -> str:
    import uuid

    path = f"{folder}/part-{uuid.uuid4().hex}"
    fs, at = open_fs(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at) as out:
        out.write(pickle.dumps(what, protocol=5))
    return path


def _load(path: str):
    fs, at = open_fs(path)
    with fs.open_input_file(at) as file:
        return pickle.loads(file.read())


@lru_cache(maxsize=1)
def _block(path: str):
    return _load(path)


def _segments_with(folder: str, most_docs: int, most_words: int):
    def run(frames):
        def row(b: Building) -> pd.DataFrame:
            made = b.done()
            return pd.DataFrame({"path": [_save(folder, made)], "n_docs": [len(b.ids)], "n_words": [b.n_words], "terms": [made["words"]], "df": [made["df"]]})

        now = Building()
        for f in frames:
            for doc_id, text in zip(f["doc_id"].astype("Int64").tolist(), f["text"], strict=True):
                now.add(None if doc_id is pd.NA else doc_id, as_text(text))
                if len(now.ids) >= most_docs or now.n_words >= most_words:
                    yield row(now)
                    now = Building()
        if now.ids:
            yield row(now)

    return run


def index(docs: DataFrame, segment_docs: int = SEGMENT_DOCS, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index: one row for each segment, whose posting lists are in a file of the shared folder."""
    folder = scratch(docs.sparkSession, "lexical-segments")
    return materialise(docs.select("doc_id", "text").mapInPandas(_segments_with(folder, segment_docs, segment_words), SEGMENTS), "lexical-index")


def _terms(frames):
    for f in frames:
        yield pd.DataFrame({"query": f["query"], "item_id": f["item_id"], "terms": [sorted(set(words_of(as_text(t)))) for t in f["text"]]})


def _blocks_with(folder: str, block_terms: int, n_docs: int):
    def run(frames):
        import math

        rows, size = [], 0
        for f in frames:
            for query, item, terms in f[["query", "item_id", "terms"]].itertuples(index=False):
                if rows and size + len(terms) > block_terms:
                    yield pd.DataFrame({"path": [_save(folder, rows)]})
                    rows, size = [], 0
                weighed = [(bytes(t["term"]), math.floor(1000 * math.log((2 * n_docs + 2) / (2 * t["df"] + 1)))) for t in terms]
                rows.append((query, item if isinstance(item, str) else None, weighed))
                size += len(terms)
        if rows:
            yield pd.DataFrame({"path": [_save(folder, rows)]})

    return run


def _search_with(block: str, n_docs: int, n_words: int, top: int):
    def run(frames):
        queries = _block(block)
        wanted = sorted({t for _, _, terms in queries for t, _ in terms})
        best: list[list] = [[] for _ in queries]
        for f in frames:
            for path in f["path"]:
                seg = _load(path)
                lists = Lists(seg, wanted, n_docs, n_words)
                for k, (_, _, terms) in enumerate(queries):
                    best[k] = lists.search(terms, best[k], seg["ids"], top)
        rows = [(q, item, d, -s) for (q, item, _), found in zip(queries, best, strict=True) for s, d in found]
        for k in range(0, len(rows), 50_000):
            yield pd.DataFrame(rows[k : k + 50_000], columns=FOUND.names).astype({"doc_id": "Int64"})

    return run


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, segment_docs: int = SEGMENT_DOCS, segment_words: int = SEGMENT_WORDS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``top`` highest-scoring documents for each row of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    segments = index(docs, segment_docs, segment_words)
    n_segments, n_docs, n_words = segments.agg(F.count("*"), F.sum("n_docs"), F.sum("n_words")).first()
    asked = items.select(F.monotonically_increasing_id().alias("query"), F.col("item_id").cast("string").alias("item_id"), "text")
    asked = materialise(asked.mapInPandas(_terms, "query long, item_id string, terms array<binary>"), "lexical-queries")
    known = asked.select("query", "item_id", F.explode("terms").alias("term"))
    held = segments.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select("t.terms", "t.df").toDF("term", "df")
    freq = held.join(known.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    told = known.join(freq, "term").groupBy("query", "item_id").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
    size = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    written = told.repartition(1 + size // block_terms).mapInPandas(_blocks_with(scratch(spark, "lexical-blocks"), block_terms, n_docs or 0), "path string")
    blocks = [r["path"] for r in materialise(written, "lexical-block-names").collect()]
    # Several segments for each task, so that what one finds bounds the next.
    tasks = max(1, min(n_segments, max(2 * spark.sparkContext.defaultParallelism, n_segments // 8)))
    found = spark.createDataFrame([], FOUND)
    for block in blocks:
        found = found.unionByName(segments.select("path").repartition(tasks).mapInPandas(_search_with(block, n_docs, n_words, top), FOUND))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= top)
    return best.select(F.col("item_id").cast(items.schema["item_id"].dataType).alias("item_id"), "rank", "doc_id", "score")
