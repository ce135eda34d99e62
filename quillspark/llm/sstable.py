"""Token ids in sorted-string-table shards (operator 4).

One file per range of document ids:

    data blocks   entries in key order; each key is written as (shared with the previous
                  key, rest); the value is the ids as unsigned 16- or 32-bit integers;
                  a block is closed behind about BLOCK_BYTES and compressed with zstd
    index         for each block: its last key, place, stored and plain size, entries, ids before it
    filter        Bloom filter over the keys, BLOOM_BITS bits a key
    footer        places and sizes of index and filter, entries, ids, item size, magic

A key is the document id (null before all others) and a number that tells repeated ids
apart, so that bytes sort as ids do.  A lookup tests the filter, bisects the index and
searches one block.

Files are written under a name of their attempt and listed in a manifest; only files in
the manifest count, so repeated or lost attempts do no harm.

Defined results: null or empty text has the end id alone; repeated ids are ordered by the
hash of their text; a very long text is one entry with all its ids; other columns are ignored; an empty
table has no files and no rows.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import as_text, materialise, open_fs, scratch

END_ID = 1
BLOCK_BYTES = 64 * 1024
BLOOM_BITS = 10
BLOOM_HASHES = 7
MAGIC = b"QSST0001"
_ENTRY = struct.Struct("<HHI")
_INDEX = struct.Struct("<HQIIIQ")
_FOOTER = struct.Struct("<QQQQQQI8s")

MANIFEST = T.StructType(
    [
        T.StructField("shard", T.LongType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("first_id", T.LongType()),
        T.StructField("last_id", T.LongType()),
        T.StructField("n_docs", T.LongType(), False),
        T.StructField("n_ids", T.LongType(), False),
    ]
)
ROWS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType(), False),
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids_crc32", T.LongType(), False),
    ]
)


def key_of(doc_id: int | None, nth: int = 0) -> bytes:
    head = b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))
    return head + struct.pack(">I", nth)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one file; entries come in key order."""

    def __init__(self, out, wide: bool) -> None:
        import pyarrow as pa

        self.out, self.codec = out, pa.Codec("zstd", 1)
        self.kind = "<u4" if wide else "<u2"
        self.block, self.keys, self.index = bytearray(), [], []
        self.last, self.entries, self.at, self.ids = b"", 0, 0, 0
        self.before = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.entries:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype(self.kind).tobytes()
        self.block += _ENTRY.pack(shared, len(key) - shared, len(ids)) + key[shared:] + value
        self.last = key
        self.entries += 1
        self.ids += len(ids)
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if self.entries:
            stored = self.codec.compress(bytes(self.block), asbytes=True)
            self.out.write(stored)
            self.index.append(_INDEX.pack(len(self.last), self.at, len(stored), len(self.block), self.entries, self.before) + self.last)
            self.at += len(stored)
            self.block, self.entries, self.before, self.last = bytearray(), 0, self.ids, b""

    def close(self) -> None:
        self._close_block()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, dtype=np.uint8)
        for k in self.keys:
            bloom[_bloom_places(k, bits)] = 1
        packed = np.packbits(bloom).tobytes()
        self.out.write(index)
        self.out.write(packed)
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), bits, len(self.keys), self.ids, int(self.kind[2]), MAGIC))


class Reader:
    """Reads one file: in order, or by key."""

    def __init__(self, path: str) -> None:
        import pyarrow as pa

        fs, at = open_fs(path)
        self.file, self.codec = fs.open_input_file(at), pa.Codec("zstd")
        size = self.file.size()
        index_at, index_size, bloom_at, self.bits, self.n_docs, self.n_ids, width, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a token table")
        self.kind = f"<u{width}"
        raw, i = self._read(index_at, index_size), 0
        self.last, self.blocks = [], []
        while i < len(raw):
            n, *block = _INDEX.unpack_from(raw, i)
            i += _INDEX.size
            self.last.append(raw[i : i + n])
            self.blocks.append(block)
            i += n
        self.bloom = np.unpackbits(np.frombuffer(self._read(bloom_at, size - _FOOTER.size - bloom_at), dtype=np.uint8))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, k: int):
        """(key, ids) of a block's entries."""
        at, stored, plain, entries, _ = self.blocks[k]
        raw = self.codec.decompress(self._read(at, stored), plain, asbytes=True)
        i, key, width = 0, b"", int(self.kind[2])
        for _ in range(entries):
            shared, rest, n = _ENTRY.unpack_from(raw, i)
            i += _ENTRY.size
            key = key[:shared] + raw[i : i + rest]
            i += rest
            yield key, np.frombuffer(raw, dtype=self.kind, count=n, offset=i).astype("<u4")
            i += n * width

    def __iter__(self):
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        key = key_of(doc_id, nth)
        if not self.bloom[_bloom_places(key, self.bits)].all():
            return None
        k = bisect.bisect_left(self.last, key)
        if k == len(self.last):
            return None
        return next((ids for have, ids in self.block(k) if have == key), None)

    def close(self) -> None:
        self.file.close()


def _write_with(folder: str, path: str, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(frames):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = tokens.encoder(path)
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.qsst"
        fs, at = open_fs(name)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        out = writer = first = last = None
        nth = 0
        for f in frames:
            texts, ids = [as_text(t) for t in f["text"]], f["doc_id"].tolist()
            for a, b in tokens.slices(texts):
                for doc, raw in zip(ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    doc = None if pd.isna(doc) else int(doc)
                    if writer is None:
                        out = fs.open_output_stream(at)
                        writer = Writer(out, len(encoder.closes) > 1 << 16)
                    elif doc == last:
                        nth += 1
                    if doc != last:
                        nth = 0
                    writer.add(key_of(doc, nth), np.frombuffer(raw + end, dtype="<u4"))
                    last = doc
                    first = doc if first is None else first  # null isn't in the file's range of ids
        if writer is not None:
            writer.close()
            out.close()
            row = (shard, name, first, last, len(writer.keys), writer.ids)
            yield pd.DataFrame([row], columns=MANIFEST.names).astype({"first_id": "Int64", "last_id": "Int64"})

    return run


def write(docs: DataFrame, folder: str | None = None, end_id: int = END_ID, tokenizer: str | None = None, shards: int | None = None) -> DataFrame:
    """Write the tables; returns the manifest, one row per file, which is itself stored."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long"), "text").withColumn("_h", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(shards, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return materialise(dealt.mapInPandas(_write_with(folder or scratch(spark, "tokens"), tokenizer or tokens.tokenizer_path(), end_id), MANIFEST), "manifest")


def _read_back(frames):
    for f in frames:
        for path, before in zip(f["path"], f["before"], strict=True):
            reader, rows, start = Reader(path), [], int(before)
            for key, ids in reader:
                rows.append((id_of(key), start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=ROWS.names).astype({"doc_id": "Int64"})
                    rows = []
            reader.close()
            yield pd.DataFrame(rows, columns=ROWS.names).astype({"doc_id": "Int64"})


def read(manifest: DataFrame) -> DataFrame:
    """One row per stored document, in the order of the files; the window has a row for each file."""
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("shard", "path", F.coalesce(before, F.lit(0)).alias("before"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "shard").mapInPandas(_read_back, ROWS)


def _look_up(frames):
    for f in frames:
        for (shard, path), group in f.groupby(["shard", "path"]):
            reader = Reader(path)
            rows = [(int(d), shard, None if (ids := reader.get(int(d))) is None else ids.tolist()) for d in group["doc_id"]]
            reader.close()
            yield pd.DataFrame(rows, columns=["doc_id", "shard", "ids"])


def lookup(spark: SparkSession, manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids of the wanted documents (doc_id, ids); for a repeated id the first one's.

    A wanted id is sent to the file whose range holds it; ids that no file has give no row.
    """
    files = manifest.select("shard", "path", "first_id", "last_id")
    near = wanted.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    to = near.join(files, (near.doc_id >= files.first_id) & (near.doc_id <= files.last_id)).select("doc_id", "shard", "path")
    found = to.repartition("path").mapInPandas(_look_up, "doc_id long, shard long, ids array<int>").where("ids is not null")
    # Each file numbers a repeated id anew, so the first file that has it holds the first one.
    return found.groupBy("doc_id").agg(F.min_by("ids", "shard").alias("ids"))
