"""Structured Streaming forms of the time-driven operators.

Each takes a streaming DataFrame of events (ts as timestamp) and returns one, or a started
query where the work is done batch by batch.  Rows later than the watermark are dropped and
counted in the query's progress (numRowsDroppedByWatermark).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.progress import debounced

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def reading_positions(moves: DataFrame, key: str, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """Debounce: one row for each stretch of moves, once the watermark has passed its end."""
    return debounced(moves.withWatermark("ts", late), key, gap)


def reviews(proposals: DataFrame, decisions: DataFrame, key: str, within: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Proposals with their decisions inside the time; a null decision is a timeout."""
    p = proposals.withWatermark("ts", late)
    d = decisions.select(F.col(key).alias("_k"), F.col("ts").alias("decided_at"), "decision").withWatermark("decided_at", late)
    inside = (F.col(key) == F.col("_k")) & (F.col("decided_at") >= F.col("ts")) & (F.col("decided_at") <= F.col("ts") + F.expr(f"interval {within}"))
    return p.join(d, inside, "leftOuter").drop("_k")


def arrivals(docs: DataFrame, at: str = "ts", text: str = "text", late: str = "1 hour") -> DataFrame:
    """New documents; the same content again within the watermark is dropped."""
    return docs.withColumn("sha", F.sha2(text, 256)).withWatermark(at, late).dropDuplicatesWithinWatermark(["sha"])


def new_content(stream: DataFrame, path: str, checkpoint: str, at: str = "ts", text: str = "text", buckets: int = 16):
    """Documents whose content was never seen before, whenever that was: appended below ``path``, read by ``seen_rows``.

    ``path`` keeps the digest of every content in ``buckets`` parts.  A batch's own digests, which are as many as its rows, are looked for in the parts that they fall
    into, so the state is scanned and never shuffled; of a batch's rows of one content the earliest stays.  A batch writes to a folder named by it and replaces what a failed
    attempt left there, so one that is done again, after a restart too, adds nothing twice.  Rows without a text are no documents and are passed over.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"{uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex}-{number}"
        keyed = batch.where(F.col(text).isNotNull()).withColumn("_sha", F.sha2(text, 256))
        keyed = keyed.withColumn("_bucket", F.pmod(F.xxhash64("_sha"), F.lit(buckets)).cast("int"))
        row = F.struct(F.col(at).isNull().alias("_late"), F.col(at).alias("_at"), F.struct(*batch.columns).alias("_row"))
        first = keyed.groupBy("_sha", "_bucket").agg(F.min_by(F.struct(*batch.columns), F.struct(row["_late"], row["_at"], F.xxhash64(*batch.columns))).alias("_row"))
        if _exists(spark, f"{path}/seen"):
            touched = [r[0] for r in keyed.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
            seen = spark.read.schema("_sha string, batch string, _bucket int").parquet(f"{path}/seen")
            seen = seen.where(F.col("_bucket").isin(touched) & (F.col("batch") != name)).select("_sha")
            again = seen.join(keyed.select("_sha").distinct(), "_sha", "left_semi")
            first = first.join(again, "_sha", "left_anti")
        first.select("_row.*", "_sha", "_bucket").write.mode("overwrite").parquet(f"{path}/rows/batch={name}")
        made = spark.read.parquet(f"{path}/rows/batch={name}")
        made.select("_sha", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/seen/batch={name}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def seen_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """The documents that ``new_content`` let pass."""
    if not _exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/rows").select([f.name for f in schema.fields])


def _versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("seq long, batch string, bucket int, folder string").parquet(f"{path}/manifest")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def current_state(spark: SparkSession, path: str, schema, buckets: list[int] | None = None) -> DataFrame:
    """The table that ``upsert_batches`` keeps, or some buckets of it: of each bucket the last version."""
    folders = []
    if _exists(spark, f"{path}/manifest"):
        last = _versions(spark, path).groupBy("bucket").agg(F.max_by("folder", "seq").alias("folder"))
        folders = [r["folder"] for r in last.collect() if buckets is None or r["bucket"] in buckets]  # one for each bucket
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame], key: str, buckets: int = 16):
    """Merge every micro-batch into a table in ``buckets`` parts by a hash of ``key``.

    Only buckets that the batch touches are read and written anew; a manifest names each bucket's last
    version, so a new checkpoint goes on with what the path holds, and a batch that was merged
    before (the same number of the same checkpoint) isn't merged again.  Read it by ``current_state``.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"{checkpoint}#{number}"
        known = _versions(spark, path) if _exists(spark, f"{path}/manifest") else None
        if known is not None and known.where(F.col("batch") == name).limit(1).count():
            return
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        seq = 1 + ((known.agg(F.max("seq")).first()[0] or 0) if known is not None else 0)
        folder = f"{path}/v={seq}-{uuid.uuid4().hex}"
        merge(current_state(spark, path, batch.schema, touched), batch).withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(folder)
        # What a failed attempt wrote isn't in the manifest and counts for nothing.
        rows = [(seq, name, b, f"{folder}/_bucket={b}") for b in touched]
        spark.createDataFrame(rows, "seq long, batch string, bucket int, folder string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Throttle(StatefulProcessor):
    """Passes a row if the last passed one is ``millis`` or more away."""

    def __init__(self, millis: int) -> None:
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for t, event in zip(all_rows["ts"], all_rows["event_id"], strict=True):
            t = int(pd.Timestamp(t).value // 1_000_000)
            if last is None or t - last >= self.millis:
                last = t
                out.append((key[0], event))
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["key", "event_id"])

    def close(self) -> None:
        pass


def throttle(moves: DataFrame, key: str, millis: int = 120) -> DataFrame:
    """key, event_id of the rows that pass; needs the RocksDB state store."""
    rows = moves.select(F.col(key).alias("key"), "ts", "event_id")
    return rows.groupBy("key").transformWithStateInPandas(_Throttle(millis), "key long, event_id long", outputMode="append", timeMode="none")


class _CappedMean(StatefulProcessor):
    """avg += (x - avg) / min(n, cap), rows of a batch in order of time."""

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("mean", "avg double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        avg, n = self.state.get() if self.state.exists() else (0.0, 0)
        for x in pd.concat(list(rows)).sort_values(["ts", "event_id"])["value"]:
            n += 1
            avg += (x - avg) / min(n, self.cap)
        self.state.update((float(avg), int(n)))
        yield pd.DataFrame({"key": [key[0]], "avg": [float(avg)], "n": [int(n)]})

    def close(self) -> None:
        pass


def capped_means(rows: DataFrame, key: str, cap: int = 20) -> DataFrame:
    """key, avg, n after every batch, in update mode; needs the RocksDB state store."""
    return rows.select(F.col(key).alias("key"), "ts", "event_id", "value").groupBy("key").transformWithStateInPandas(_CappedMean(cap), "key string, avg double, n long", outputMode="update", timeMode="none")


class _Stall(StatefulProcessor):
    """Reports a start that no end follows within ``seconds`` of event time."""

    def __init__(self, start: str, end: str, seconds: int) -> None:
        self.start, self.end, self.millis = start, end, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for kind, t in pd.concat(list(rows)).sort_values(["ts", "event_id"])[["event_type", "ts"]].itertuples(index=False):
            ms = int(pd.Timestamp(t).value // 1_000_000)
            if kind == self.start:
                self.open.update((ms,))
                self.handle.registerTimer(ms + self.millis)
            elif kind == self.end and self.open.exists():
                self.open.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="int64"), "started_ms": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists() and self.open.get()[0] + self.millis <= expiredTimerInfo.getExpiryTimeInMs():
            out = [(key[0], self.open.get()[0])]
            self.open.clear()
        yield pd.DataFrame(out, columns=["key", "started_ms"]).astype("int64")

    def close(self) -> None:
        pass


def stalls(events: DataFrame, key: str, start: str, end: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """key, started_ms of runs that were started and not ended in time, by event-time timers."""
    rows = events.withWatermark("ts", late).select(F.col(key).alias("key"), "ts", "event_id", "event_type")
    return rows.groupBy("key").transformWithStateInPandas(_Stall(start, end, seconds), "key long, started_ms long", outputMode="append", timeMode="EventTime")


class _Answer(StatefulProcessor):
    """Keeps a session's deltas until its end or until nothing has come for ``millis``."""

    def __init__(self, millis: int) -> None:
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "seq long, text string")
        self.due = handle.getValueState("due", "t long")

    def _row(self, key, answer: str, complete: bool) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]], "answer": [answer], "complete": [complete]})

    def _clear(self) -> str:
        text = "".join(t for _, t in sorted(self.parts.get())) if self.parts.exists() else ""
        self.parts.clear()
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        return text

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values("seq")
        for seq, text in f.loc[f["event"] == "delta", ["seq", "text"]].itertuples(index=False):
            self.parts.appendValue((int(seq), text or ""))
        done = f.loc[f["event"] == "done", "text"].tolist()
        if done:
            whole = self._clear()
            yield self._row(key, done[-1] or whole, True)
            return
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        due = max(int(pd.Timestamp(f["ts"].max()).value // 1_000_000), timerValues.getCurrentWatermarkInMs()) + self.millis
        self.due.update((due,))
        self.handle.registerTimer(due)
        yield self._row(key, "", False).iloc[:0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, self._clear(), False)

    def close(self) -> None:
        pass


def answers(frames: DataFrame, late: str = "10 minutes", idle: int = 600) -> DataFrame:
    """session_id, answer, complete, once for each session: at its end, or what it has after ``idle`` seconds without a frame.

    frames: session_id, seq, event, text, ts.  A text at the end wins over the deltas; state goes with the answer.
    """
    rows = frames.withWatermark("ts", late).select("session_id", "seq", "event", "text", "ts")
    return rows.groupBy("session_id").transformWithStateInPandas(_Answer(idle * 1000), "session_id long, answer string, complete boolean", outputMode="append", timeMode="EventTime")


__all__ = ["ROCKSDB", "answers", "arrivals", "capped_means", "current_state", "file_stream", "reading_positions", "reviews", "stalls", "throttle", "upsert_batches"]
