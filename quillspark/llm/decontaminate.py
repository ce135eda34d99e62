"""Benchmark decontamination with suffix arrays over the training text (operator 5).

Each run of documents of a few million characters is one shard.  Its words become integer
codes (0: a word that no benchmark item has), and a suffix array is built over the
stretches of known words that are long enough to hold a window; every other suffix could
never hold one.  Prefix doubling goes on until the suffixes are in true order.  Every suffix of the
test items that begins a window is binary-searched in it; the ranges give all occurrences of each
window.  Windows that go on both in the text and in the item make up the verbatim matches, of which
the longest and its place are told; a match shorter than its item's window counts as none.

A Spark job writes the benchmark to the shared folder in blocks of about ``BLOCK_WORDS`` words; the
driver sees only their names, one for each block.  A task holds one block at a time, whose size doesn't
grow with the benchmark; more blocks mean more passes over the documents.

Defined results: null text has no words; an item without words is ignored; a null
item_id is written as "null"; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, materialise, open_fs, scratch
from .tokens import slices

WINDOW = 13
#: Words of benchmark items in one block, about (some 50 MB).
BLOCK_WORDS = 1_000_000
#: Characters of the documents in one shard, about; a longer document is a shard of its own.
SHARD_CHARS = 3_000_000
#: Most words in a suffix array.
SHARD_WORDS = 2_000_000

# Bytes of words: digits, a-z, everything beyond ASCII; A-Z are lowered, others separate.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("longest_match", T.LongType()),
        T.StructField("longest_start", T.LongType()),
    ]
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.names: list[str] = []
        texts = []
        for name, text in rows:
            w = words_of(text)
            if w:
                self.names.append(name)
                texts.append(w)
        self.code: dict[bytes, int] = {}
        flat, item, windows = [], [], []
        for k, w in enumerate(texts):
            begin = len(flat)
            flat += [self.code.setdefault(x, len(self.code) + 1) for x in w]
            item += [k] * len(w)
            size = min(WINDOW, len(w))
            windows += [(begin + i, size) for i in range(len(w) - size + 1)]
            flat.append(0)  # ends the item
            item.append(k)
        self.flat = np.array(flat, dtype=np.int32)
        self.item = np.array(item, dtype=np.int32)
        windows = np.array(windows, dtype=np.int64).reshape(-1, 2)
        self.starts, self.sizes = windows[:, 0], windows[:, 1]
        self.least = int(self.sizes.min()) if len(windows) else 0


def suffix_array(codes: np.ndarray, places: np.ndarray, longest: int) -> np.ndarray:
    """``places`` in the order of the suffixes of ``codes`` that begin there (0 sorts first).

    No two places are followed by the same words for more than ``longest``.
    """
    n = len(codes)
    rank = codes.astype(np.int64)
    step = 1
    while step < min(longest + 1, n):
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:]
        key = rank * (rank.max() + 1) + after
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        if rank.max() == n - 1:
            break
        step *= 2
    return places[np.argsort(rank[places], kind="stable")]


def ranges(codes: np.ndarray, order: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 place in the suffix array of the suffixes that begin with each window."""
    padded = np.concatenate([codes, np.zeros(WINDOW, dtype=codes.dtype)])
    out = []
    for upper in (False, True):
        low = np.zeros(len(items.starts), dtype=np.int64)
        high = np.full(len(items.starts), len(order), dtype=np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            at, want = order[mid], items.starts[open_]
            below = np.zeros(len(open_), dtype=bool)
            same = np.ones(len(open_), dtype=bool)
            for j in range(WINDOW):  # compare word by word, as far as each window goes
                same &= j < items.sizes[open_]
                if not same.any():
                    break
                have, need = padded[at + j], items.flat[np.minimum(want + j, len(items.flat) - 1)]
                below |= same & (have < need)
                same &= have == need
            whole = np.ones(len(open_), dtype=bool)
            for j in range(WINDOW):
                use = j < items.sizes[open_]
                whole &= ~use | (padded[at + j] == items.flat[np.minimum(want + j, len(items.flat) - 1)])
            right = below | (whole if upper else False)
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        out.append(low)
    return out[0], out[1]


def find(texts: list[str], items: Items) -> tuple[np.ndarray, list]:
    """Word counts, and (document, first word, size, item, test place) of every occurrence of a window."""
    split = [words_of(t) for t in texts]
    counts = np.array([len(w) for w in split], dtype=np.int64)
    hits: list[np.ndarray] = []
    if not items.least:
        return counts, hits
    code = items.code.get
    begin = 0
    while begin < len(split):  # a shard: whole documents up to SHARD_WORDS
        end, size = begin, 0
        while end < len(split) and (end == begin or size + len(split[end]) < SHARD_WORDS):
            size += len(split[end]) + 1
            end += 1
        flat: list[int] = []
        first = np.zeros(end - begin, dtype=np.int64)
        for k, w in enumerate(split[begin:end]):
            first[k] = len(flat)
            flat += [code(x, 0) for x in w]
            flat.append(0)
        codes = np.array(flat, dtype=np.int32)
        known = np.flatnonzero(np.diff(np.concatenate([[0], (codes != 0).astype(np.int8), [0]])))
        lengths = known[1::2] - known[::2]
        keep = lengths >= items.least
        runs, lengths = known[::2][keep], lengths[keep]
        if len(runs):
            # The stretches side by side, each ended by 0, and the place each word came from.
            total = int((lengths + 1).sum())
            offset = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
            origin = np.arange(total) - np.repeat(offset, lengths + 1) + np.repeat(runs, lengths + 1)
            short = codes[origin]  # the word behind a stretch has code 0
            left = np.repeat(lengths, lengths + 1) - (np.arange(total) - np.repeat(offset, lengths + 1))
            order = suffix_array(short, np.flatnonzero(left >= items.least), int(lengths.max()))
            low, high = ranges(short, order, items)
            n = high - low
            if n.any():
                which = np.repeat(np.arange(len(n)), n)
                at = order[np.repeat(low, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
                at = origin[at]
                doc = np.searchsorted(first, at, side="right") - 1
                hits.append(np.column_stack([doc + begin, at - first[doc], items.sizes[which], items.item[items.starts[which]], items.starts[which]]))
        begin = end
    return counts, hits


def _longest(hit: np.ndarray) -> tuple[int, int]:
    """(words, first word) of the longest verbatim match, of equal ones the earliest: windows that go on both in the text and in the item."""
    diagonal = hit[:, 1] - hit[:, 4]
    order = np.lexsort([hit[:, 1], diagonal, hit[:, 3]])
    best, start, where = 0, 0, 0
    prev = None
    for item, diag, at, size in zip(hit[order, 3].tolist(), diagonal[order].tolist(), hit[order, 1].tolist(), hit[order, 2].tolist(), strict=True):
        if prev != (item, diag, at - 1):
            start = at
        prev = (item, diag, at)
        if at + size - start > best or (at + size - start == best and start < where):
            best, where = at + size - start, start
    return best, where


def _row(n_words: int, hit: np.ndarray | None, names) -> tuple:
    if hit is None or not len(hit):
        return 0, 0, hashlib.sha256(b"").hexdigest(), False, 0, None
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, hit[:, 1], 1)
    np.add.at(edge, hit[:, 1] + hit[:, 2], -1)
    n_hit = int((np.cumsum(edge)[:n_words] > 0).sum())
    found = sorted({names[k] for k in np.unique(hit[:, 3])})
    longest, start = _longest(hit)
    return n_hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), 20 * n_hit >= n_words, longest, start


@lru_cache(maxsize=1)
def _block(path: str) -> Items:
    fs, at = open_fs(path)
    with fs.open_input_file(at) as file:
        return pickle.loads(file.read())


def _frames_with(blocks: list[str], load=_block):
    """The per-batch function; ``blocks`` are the blocks' files, loaded and searched one after another."""

    def part_of(doc_ids, texts: list[str]) -> pd.DataFrame:
        per: dict[int, list] = {}
        counts, names, shift = None, [], 0
        for b in blocks:
            items = load(b)
            counts, hits = find(texts, items)
            for h in hits:
                h[:, 3] += len(names)
                h[:, 4] += shift
                h = h[np.argsort(h[:, 0], kind="stable")]
                cut = np.flatnonzero(np.diff(h[:, 0])) + 1
                for part in np.split(h, cut):
                    per.setdefault(int(part[0, 0]), []).append(part)
            names += items.names
            shift += len(items.flat)
        if counts is None:
            counts = np.array([len(words_of(t)) for t in texts], dtype=np.int64)
        rows = [_row(int(n), np.concatenate(per[k]) if k in per else None, names) for k, n in enumerate(counts)]
        return pd.DataFrame(
            {
                "doc_id": doc_ids,
                "n_words": counts,
                "n_hit": [r[0] for r in rows],
                "n_items": [r[1] for r in rows],
                "items_sha256": [r[2] for r in rows],
                "contaminated": [r[3] for r in rows],
                "longest_match": [r[4] for r in rows],
                "longest_start": pd.array([r[5] for r in rows], dtype="Int64"),
            }
        )

    def run(frames):
        for f in frames:
            texts = [as_text(t) for t in f["text"]]
            for a, b in slices(texts, SHARD_CHARS):
                yield part_of(f["doc_id"].iloc[a:b].astype("Int64").array, texts[a:b])

    return run


def _blocks_with(folder: str, block_words: int):
    def run(frames):
        import uuid

        def save(rows) -> pd.DataFrame:
            path = f"{folder}/block-{uuid.uuid4().hex}"
            fs, at = open_fs(path)
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(at) as out:
                out.write(pickle.dumps(Items(rows), protocol=5))
            return pd.DataFrame({"path": [path]})

        rows, size = [], 0
        for f in frames:
            for item, text in f[["item", "text"]].itertuples(index=False):
                n = len(text) // 2 + 1
                if rows and size + n > block_words:
                    yield save(rows)
                    rows, size = [], 0
                rows.append((item, text))
                size += n
        if rows:
            yield save(rows)

    return run


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list[str]:
    """Write the items as blocks of bounded size; their files' names."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").where("text is not null")
    words = items.agg(F.sum(F.length("text").cast("long") / 2 + 1)).first()[0]
    if words is None:
        return []
    written = items.repartition(1 + int(words) // block_words).mapInPandas(_blocks_with(scratch(benchmark.sparkSession, "benchmark"), block_words), "path string")
    return sorted(r["path"] for r in materialise(written, "blocks").collect())


def contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: words, words hit, items, and the longest verbatim match."""
    return docs.select("doc_id", "text").mapInPandas(_frames_with(blocks_of(benchmark, block_words)), SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    blocks = blocks_of(benchmark)

    @F.pandas_udf("boolean")
    def bad(texts: pd.Series) -> pd.Series:
        frame = pd.DataFrame({"doc_id": pd.array([0] * len(texts), dtype="Int64"), "text": texts.to_numpy()})
        return pd.concat([f["contaminated"] for f in _frames_with(blocks)([frame])], ignore_index=True)

    return docs.where(~bad(docs["text"]))
