"""Readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many parts as there are cores, where its files give fewer: the work on a small file's texts is then no single task's."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """events with ts as a timestamp, which watermarks need."""
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def new_only(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Incremental ingest: rows whose key isn't known yet; the plan of an import and, written, the import."""
    return rows.join(known.select(key), key, "left_anti")


def import_plan(files: DataFrame, known: DataFrame, original: str = "original.pdf") -> DataFrame:
    """document_id, status of the folders named by a UUID that hold files (path, size): 'already indexed' for known ids
    (document_id), 'no readable original' without a file of that name that isn't empty, else 'would import'.

    Nothing is read but names and sizes; the import takes the rows that would be, by ``new_only``.
    """
    uuid = "[0-9a-fA-F]{8}(?:-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}"
    found = files.select(F.regexp_extract("path", rf"(?:^|/)({uuid})/(.+)$", 1).alias("document_id"), F.regexp_extract("path", rf"(?:^|/)({uuid})/(.+)$", 2).alias("name"), "size").where("document_id != ''")
    folders = found.groupBy("document_id").agg(F.bool_or((F.col("name") == original) & (F.col("size") > 0)).alias("readable"))
    told = folders.join(known.select("document_id", F.lit(True).alias("known")).distinct(), "document_id", "left")
    return told.select("document_id", F.when(F.col("known"), "already indexed").when(F.col("readable"), "would import").otherwise("no readable original").alias("status"))


def evolved(rows: DataFrame, schema_defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """rows with the columns of name -> (type, default) added where missing and filled where null."""
    for name, (kind, default) in schema_defaults.items():
        have = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        rows = rows.withColumn(name, F.coalesce(have, F.lit(default).cast(kind)))
    return rows


def upserted(old: DataFrame, new: DataFrame, key: str, order: str, kept: str) -> DataFrame:
    """Merge of versions: all columns of the latest by ``order``, but ``kept`` of the first."""
    both = old.unionByName(new)
    others = [c for c in both.columns if c not in (key, kept)]
    packed = F.struct(order, *[c for c in others if c != order])
    out = both.groupBy(key).agg(F.min_by(kept, order).alias(kept), F.max(packed).alias("_last"))
    return out.select(key, kept, *[F.col(f"_last.{c}").alias(c) for c in others])


def deleted(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows without those whose composite key is listed."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def deletions(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Each listed key with whether a row went with it."""
    have = rows.select(*keys, F.lit(True).alias("went")).distinct()
    return gone.select(*keys).distinct().join(have, keys, "left").withColumn("went", F.coalesce("went", F.lit(False)))


def publish(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Write a derived table as one committed overwrite; with a partition column only its values are replaced."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_texts(rows: DataFrame, path: str, key: str = "document_id", text: str = "text") -> None:
    """One text file folder for each document: notes, bibliographies, source lists."""
    rows.select(key, text).write.mode("overwrite").partitionBy(key).text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size and kind of the files below a folder, by path, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), X.file_kind("path").alias("kind")).orderBy("path")


def block_json(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """doc_id, page (-1 if flat), pos, block (VARIANT) of JSON lists of pages or flat lists; others are dropped."""
    parsed = docs.select("doc_id", F.try_parse_json(payload).alias("v")).where("v is not null and schema_of_variant(v) like 'ARRAY%'")
    item = "lateral variant_explode(v)"
    # The query names its source by a parameter, so calls can't meet each other's.
    return docs.sparkSession.sql(
        f"""
        with top as (select doc_id, pos p, value x from {{source}}, {item}),
             paged as (select doc_id, p page, y.pos pos, y.value block from top, lateral variant_explode(x) y where schema_of_variant(x) like 'ARRAY%'),
             flat as (select doc_id, -1 page, p pos, x block from top where schema_of_variant(x) like 'OBJECT%')
        select * from (select * from paged union all select * from flat) where schema_of_variant(block) like 'OBJECT%'
    """,
        source=parsed,
    )
