"""Library operators: owned documents, their states, order and membership."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import written
from .overlap import in_interval, next_within


def owned(rows: DataFrame, owner_column: str, owner: int) -> DataFrame:
    """Only the owner's rows; every library call goes through it."""
    return rows.where(F.col(owner_column) == owner)


def visible(rows: DataFrame, deleted_column: str = "deleted_at") -> DataFrame:
    return rows.where(F.col(deleted_column).isNull())


def in_status(rows: DataFrame, column: str, *status: str) -> DataFrame:
    return rows.where(F.col(column).isin(*status))


def valid_sessions(uses: DataFrame, sessions: DataFrame, key: str, at: str) -> DataFrame:
    """Uses (key, at) joined with the sessions that are valid then: created <= at < expires, all timestamps."""
    return in_interval(uses, sessions, key, F.unix_micros(at), F.unix_micros("created"), F.unix_micros("expires"))


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of every key, by one aggregation."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def newest_first(rows: DataFrame, at: str, *ties: str) -> DataFrame:
    """rows with ``place`` (from 1), the latest first, rows without a time last, ties by the given columns; sorted by range, so no task holds all of them."""
    order = [F.desc_nulls_last(at), *ties]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = written(spread, "newest")
    parts = held.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # a row for each part
    parts = parts.select("_part", (before - F.col("_first") + 1).alias("_shift"))
    return held.withColumn("_part", F.shiftright("_at", 33)).join(parts, "_part").withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def priority_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of ``first``, and those of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def stalled(events: DataFrame, key: str, kind: str, start: str, end: str, at: str = "ts") -> DataFrame:
    """Keys with a start that no later end follows."""
    first = events.where(F.col(kind) == start).groupBy(key).agg(F.max(at).alias("started"))
    last = events.where(F.col(kind) == end).groupBy(key).agg(F.max(at).alias("ended"))
    return first.join(last, key, "left").where("ended is null or ended < started").select(key, "started")


def decided(proposals: DataFrame, decisions: DataFrame, key: str, within: timedelta = timedelta(minutes=30)) -> DataFrame:
    """Every proposal with the first decision inside the time; null if none came."""
    told = next_within(proposals.select("proposal_id", key, "ts"), decisions.select(key, "ts", "decision"), key, "ts", "decision", int(within / timedelta(microseconds=1)))
    return told.select("proposal_id", F.col("found").alias("decision"), F.col("found_at").alias("decided_at"))


def main_files(files: DataFrame) -> DataFrame:
    """The best main file of every project: has a document class, preferred name, depth, path.

    files: project, path, has_class.
    """
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    place = F.when(name == "main.tex", 0).when(name == "paper.tex", 1).when(name == "article.tex", 2).otherwise(3)
    keys = [F.desc("has_class"), place, F.length(F.regexp_replace("path", "[^/]", "")), F.lower("path")]
    w = Window.partitionBy("project").orderBy(*keys)
    return files.where(X.file_kind("path") == "tex").withColumn("nth", F.row_number().over(w)).where("nth = 1").select("project", "path")


def unsafe_paths(members: DataFrame) -> DataFrame:
    """archive, path, reason of members that may not be unpacked; a system's own metadata files are passed over."""
    p = F.col("path")
    part = F.split(F.translate(p, "\\", "/"), "/")
    members = members.where(~(F.array_contains(part, "__MACOSX") | (F.element_at(part, -1) == ".DS_Store")))
    reason = (
        F.when(p == "", "empty").when(F.contains(p, F.lit("\0")), "nul").when(p.rlike(r"^[/\\]"), "absolute").when(p.rlike(r"^[A-Za-z]:"), "drive")
        .when(F.exists(part, lambda s: s == ".."), "parent").when(p.rlike(r'[<>:"|?*\x01-\x1f]'), "character").when(F.exists(part, lambda s: s.rlike(r"[ .]$") & ~s.isin(".", "..")), "trailing")
    )
    return members.withColumn("reason", reason).where("reason is not null")


def manifest_conflicts(members: DataFrame) -> DataFrame:
    """archive, path, reason: names that differ only by case, and files that are also a folder of another."""
    low = members.withColumn("low", F.lower("path"))
    twice = low.groupBy("archive", "low").agg(F.count("*").alias("n")).where("n > 1").select("archive", "low")
    same = low.join(twice, ["archive", "low"], "left_semi").select("archive", "path", F.lit("duplicate").alias("reason"))
    parts = F.split("low", "/")
    parents = low.select("archive", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("low"), F.size(parts).alias("deep")).where("deep > 1").select("archive", "low").distinct()
    folder = low.join(parents, ["archive", "low"], "left_semi").select("archive", "path", F.lit("folder").alias("reason"))
    return same.unionByName(folder)


def manifest_budget(members: DataFrame, files: int = 2_000, each: int = 20_000_000, total: int = 200_000_000) -> DataFrame:
    """archive, ok and sizes: members, largest, all, and whether any is a TeX source."""
    a = members.groupBy("archive").agg(F.count("*").alias("n"), F.max("size").alias("largest"), F.sum("size").alias("total"), F.bool_or(X.file_kind("path") == "tex").alias("has_tex"))
    return a.withColumn("ok", (F.col("n") <= files) & (F.col("largest") <= each) & (F.col("total") <= total) & F.col("has_tex"))
