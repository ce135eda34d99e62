"""Joins of places with intervals and of intervals with each other, spread over bins of the line they lie on.

An equi-join by document or user alone would bring all pairs of a key together before its range condition
drops most of them, in one task for a key that many rows share.  Here the key is joined by the bin too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key whose running sums are taken together.
RUN = 4096


def in_interval(points: DataFrame, intervals: DataFrame, key: str, at: Column, begin: Column, end: Column) -> DataFrame:
    """points joined with the intervals of their key that hold them: begin <= at < end, all given as whole numbers.

    An interval lies in bins of the least power of two that is no shorter, so in two of them at most; a point asks the bin
    it lies in at each power that occurs (at most 63, from an aggregate).  The intervals' columns but the key are added; empty intervals and null ends hold nothing.
    """
    size = F.greatest(F.lit(0), F.ceil(F.log2((end - begin).cast("double"))).cast("int"))
    binned = intervals.where(end > begin).withColumns({"_key": F.col(key), "_begin": begin, "_end": end, "_power": size}).drop(key)
    powers = sorted(r[0] for r in binned.select("_power").distinct().collect())
    if not powers:
        return points.join(intervals.limit(0).drop(key), F.lit(False))
    shift = lambda v: F.expr(f"shiftright({v}, _power)")
    binned = binned.withColumn("_bin", F.explode(F.array_distinct(F.array(shift("_begin"), shift("_end - 1")))))
    asked = points.withColumn("_at", at).withColumn("_asks", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.shiftright("_at", p).alias("b")) for p in powers])))
    on = (F.col(key) == F.col("_key")) & (F.col("_asks.p") == F.col("_power")) & (F.col("_asks.b") == F.col("_bin")) & (F.col("_at") >= F.col("_begin")) & (F.col("_at") < F.col("_end"))
    return asked.join(binned, on).drop("_key", "_begin", "_end", "_power", "_bin", "_at", "_asks")


def overlapping(left: DataFrame, right: DataFrame, key: str, left_ends: tuple[str, str], right_ends: tuple[str, str], width: int = 4096) -> DataFrame:
    """Pairs of a key's intervals, [begin, end) on both sides, that share a place: an equi-join by key and bin of ``width``.

    A pair is given once, in the first bin that both lie in.  Empty intervals take no part; the sides' other columns must differ.
    """
    (a, b), (c, d) = left_ends, right_ends

    def bins(df: DataFrame, begin: str, end: str, name: str) -> DataFrame:
        first, last = F.expr(f"{begin} div {width}"), F.expr(f"({end} - 1) div {width}")
        return df.where(F.col(end) > F.col(begin)).withColumn(f"_first_{name}", first).withColumn("_bin", F.explode(F.sequence(first, last)))

    joined = bins(left, a, b, "l").join(bins(right, c, d, "r"), [key, "_bin"])
    once = F.col("_bin") == F.greatest("_first_l", "_first_r")
    return joined.where(once & (F.col(a) < F.col(d)) & (F.col(c) < F.col(b))).drop("_bin", "_first_l", "_first_r")


def running_ends(rows: DataFrame, key: str, order: str, size: str, run: int = RUN) -> DataFrame:
    """rows with ``start`` and ``end``, the sums of ``size`` before and through each row of its key.

    ``order`` is a whole number from 0.  Runs of it are summed apart, then their sums, so that a key with most of the rows is spread over tasks.
    """
    r = rows.withColumn("_run", F.expr(f"{order} div {run}"))
    sums = r.groupBy(key, "_run").agg(F.sum(size).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum(size).over(Window.partitionBy(key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    told = r.withColumn("_within", within).join(sums.select(key, "_run", before.alias("_before")), [key, "_run"])
    return told.withColumn("end", F.col("_before") + F.col("_within")).withColumn("start", F.col("end") - F.col(size)).drop("_run", "_within", "_before")


def next_within(asks: DataFrame, answers: DataFrame, key: str, at: str, value: str, within: int) -> DataFrame:
    """asks with ``found_at`` and ``found``, the first answer of their key at their time or up to ``within`` microseconds later; null without one.

    Both have ``at`` (timestamps); answers also ``value``, and of answers at one time the least counts.  Sorted backwards, the last answer
    met is the next one in time; bins of ``within`` with each answer in its own bin and the one before keep that sort short.
    """
    us = F.unix_micros(at)
    names = [c for c in asks.columns if c not in (key, at)]
    one = asks.select(F.col(key).alias("_k"), F.col(at).alias("_t"), us.alias("_us"), F.expr(f"unix_micros({at}) div {within}").alias("_bin"), F.lit(1).alias("_side"), F.lit(None).cast(answers.schema[value].dataType).alias("_value"), F.struct(F.lit(True).alias("_"), *names).alias("_row"))
    own = F.expr(f"unix_micros({at}) div {within}")
    two = answers.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(at).alias("_t"), us.alias("_us"), F.explode(F.array(own, own - 1)).alias("_bin"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy("_k", "_bin").orderBy(F.desc("_us"), "_side", F.desc("_value")).rowsBetween(Window.unboundedPreceding, 0)
    met = F.last(F.when(F.col("_side") == 0, F.struct("_us", "_t", "_value")), ignorenulls=True).over(w)
    told = one.unionByName(two).withColumn("_met", met).where("_side = 1")
    near = F.when(F.col("_met._us") - F.col("_us") <= within, F.col("_met"))
    return told.select(F.col("_k").alias(key), F.col("_t").alias(at), *[F.col(f"_row.{n}") for n in names], near["_t"].alias("found_at"), near["_value"].alias("found"))
