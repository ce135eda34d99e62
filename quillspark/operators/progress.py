"""Progress, durations and load summaries of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import written


def percent(stages: DataFrame, key: str, running_share: Column | None = None) -> DataFrame:
    """round(100 * done weight / all weight), half to even; a running stage counts its share."""
    share = F.when(F.col("status") == "done", 1.0).when(F.col("status") == "running", F.least(F.greatest(running_share, F.lit(0.0)), F.lit(1.0)) if running_share is not None else F.lit(0.0)).otherwise(0.0)
    return stages.groupBy(key).agg(F.bround(F.round(100 * F.sum(F.col("weight") * share) / F.sum("weight"), 9), 0).cast("long").alias("percent"))


def capped_mean(rows: DataFrame, key: str, value: str, order: list[str], cap: int = 20, ranges: int = 64) -> DataFrame:
    """avg += (x - avg) / min(n, cap) in order, as a closed form over numbered rows.

    The mean of the first ``cap`` values, then every later one weighs 1 / cap and all before
    shrink by 1 - 1 / cap; so no key's values are ever gathered in an array.  Rows are numbered
    within ``ranges`` parts of the first order column (a number or a timestamp), so even a key with most of
    the rows is spread over as many tasks; the parts' counts give the numbers before them.
    """
    at = F.col(order[0]).cast("double")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    part = F.coalesce(F.floor((at - F.lit(low)) / F.lit(max((high or 0) - (low or 0), 1e-9)) * ranges).cast("int"), F.lit(-1))  # nulls come first
    own = rows.select(key, value, *order).withColumn("_part", part)
    nth = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    counts = own.groupBy(key, "_part").agg(F.count("*").alias("_m"))
    w = Window.partitionBy(key)
    counts = counts.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), (F.sum("_m").over(w.orderBy("_part")) - F.col("_m")).alias("before"), F.sum("_m").over(w).alias("n"))
    numbered = own.withColumn("nth", nth).join(counts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p"))).withColumn("nth", F.col("nth") + F.col("before"))
    keep = 1 - 1 / cap
    weight = F.when(F.col("nth") <= cap, F.pow(F.lit(keep), F.greatest(F.col("n") - cap, F.lit(0))) / F.least(F.col("n"), F.lit(cap))).otherwise(F.pow(F.lit(keep), F.col("n") - F.col("nth")) / cap)
    return numbered.groupBy(key).agg(F.sum(F.col(value) * weight).alias("avg"), F.max("n").alias("n"))


def eta(stages: DataFrame, means: DataFrame, key: str) -> DataFrame:
    """Seconds left: mean less elapsed for running, mean for pending stages; the weight without history."""
    j = stages.join(means, "stage", "left")
    left = F.when(F.col("status") == "done", 0.0).when(F.col("status") == "running", F.greatest(F.coalesce("avg", "weight") - F.col("elapsed"), F.lit(0.0))).otherwise(F.coalesce("avg", "weight"))
    return j.groupBy(key).agg(F.sum(left).cast("long").alias("eta"))


def resume(stages: DataFrame, key: str, failed: str) -> DataFrame:
    """State of every stage for a retry from the failed one: earlier ones stay, it and later ones are reset.

    stages: key, stage, pos, status; failed: a column of ``stages`` with the failed stage's name.
    """
    at = F.max(F.when(F.col("stage") == F.col(failed), F.col("pos"))).over(Window.partitionBy(key))
    return stages.withColumn("next", F.when(F.col("pos") >= F.coalesce(at, F.lit(0)), "pending").otherwise(F.col("status")))


def order_statistics(rows: DataFrame, key: str, value: str, places: dict[str, Column], bins: int = 1024, few: int = 10_000) -> DataFrame:
    """key, which, value: the values at the named places (from 0, columns of ``n``) of every key's values in order; nulls and NaN take no part.

    A selection, not a sort: a histogram over a key's range tells the bin that holds a place, then that bin is the range.  When few
    rows are left, or all are equal, the place is read off; so a key with most of the rows is counted by all tasks and never sorted in one.
    """
    v = F.col(value)
    rows = rows.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(F.col(key).alias("_k"), v.alias("_v"))
    begin = rows.groupBy("_k").agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("n"))
    listed = F.array(*[F.struct(F.lit(name).alias("which"), c.cast("long").alias("place")) for name, c in places.items()])
    state = written(begin.select("_k", "low", "high", F.col("n").alias("size"), F.inline(listed)), "places")
    wide = (F.col("low") < F.col("high")) & (F.col("size") > few)
    for _ in range(8):  # enough for 64-bit numbers, whatever their distribution
        open_ = state.where(wide)
        if open_.isEmpty():
            break
        ranges = open_.select("_k", "low", "high").distinct()
        within = rows.join(ranges, "_k").where(F.col("_v").between(F.col("low"), F.col("high")))
        share = (F.col("_v").cast("double") - F.col("low")) / (F.col("high").cast("double") - F.col("low"))
        counts = within.withColumn("bin", F.least(F.lit(bins - 1), F.floor(share * bins))).groupBy("_k", "low", "high", "bin").agg(F.count("*").alias("m"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        w = Window.partitionBy("_k", "low", "high").orderBy("bin")
        counts = counts.withColumn("before", F.sum("m").over(w) - F.col("m"))
        held = open_.join(counts, ["_k", "low", "high"]).where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("m")))
        held = held.select("_k", F.col("lo").alias("low"), F.col("hi").alias("high"), F.col("m").alias("size"), "which", (F.col("place") - F.col("before")).alias("place"))
        state = written(state.where(~wide).unionByName(held), "places")
    equal = state.where("low = high").select("_k", "which", F.col("low").alias("_v"))
    last = rows.join(state.where("low < high"), "_k").where(F.col("_v").between(F.col("low"), F.col("high")))
    nth = F.row_number().over(Window.partitionBy("_k", "which").orderBy("_v")) - 1
    few_ = last.withColumn("nth", nth).where(F.col("nth") == F.col("place")).select("_k", "which", "_v")
    return equal.unionByName(few_).select(F.col("_k").alias(key), "which", F.col("_v").alias("value"))


def load_levels(calls: DataFrame, level: str, seconds: float, latency: str = "latency", most_errors: float = 0.05) -> DataFrame:
    """rps, error rate, median and p95 of every level; best marks the fastest acceptable one.

    p95 is the value at place max(0, int(0.95 n) - 1) of the sorted latencies, the median the mean of the middle ones.
    """
    ok = F.col("status") == "ok"
    n = F.col("n")
    places = {"below": F.floor((n - 1) / 2), "above": F.floor(n / 2), "p95": F.greatest(F.lit(0), F.floor(n * 0.95) - 1)}
    told = order_statistics(calls.where(ok), level, latency, places)
    at = lambda name: F.max(F.when(F.col("which") == name, F.col("value")))
    told = told.groupBy(level).agg(((at("below") + at("above")) / 2).alias("median"), at("p95").alias("p95"))
    a = calls.groupBy(level).agg(F.count("*").alias("calls"), F.count_if(ok).alias("ok"), F.count_if(F.col("status") == "limited").alias("limited"))
    a = a.join(told, level, "left").withColumns({"rps": F.col("ok") / seconds, "error_rate": 1 - F.col("ok") / F.col("calls")})
    fine = a.where((F.col("error_rate") <= most_errors) & (F.col("ok") > 0)).agg(F.max_by(level, "rps").alias("best"))
    return a.join(F.broadcast(fine), F.lit(True), "left").withColumn("is_best", F.coalesce(F.col(level) == F.col("best"), F.lit(False))).drop("best")


def recommended(levels: DataFrame, level: str, margin: float = 0.9) -> DataFrame:
    """The best of ``load_levels`` with a rate that leaves a margin, to one decimal and 1 at least; no row without a best."""
    return levels.where("is_best").select(level, F.greatest(F.lit(1.0), F.round(F.col("rps") * margin, 1)).alias("rate"))


def debounced(moves: DataFrame, key: str, gap: str = "2 seconds") -> DataFrame:
    """The last position of every stretch of moves without a pause of ``gap``; works on streams too."""
    s = moves.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.max_by("value", "ts").alias("value"), F.count("*").alias("moves"))
    return s.select(key, F.col("w.start").alias("start"), "value", "moves")


def throttled(moves: DataFrame, key: str, millis: int = 120) -> DataFrame:
    """The moves that a throttle of one in ``millis`` lets pass, from the first on.

    The fold carries the last emission.  Each key's times are cut where a pause lets the next
    move pass anyway, so that a fold only sees one unbroken stretch.
    """
    ms = F.unix_millis("ts")
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    fresh = F.coalesce(ms - F.lag(ms).over(w) >= millis, F.lit(True))
    runs = moves.withColumn("run", F.sum(fresh.cast("long")).over(w))
    g = runs.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct(F.unix_millis("ts").alias("t"), "event_id"))).alias("l"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(None).cast("long").alias("passed"))

    def step(s: Column, x: Column) -> Column:
        passes = s["last"].isNull() | (x["t"] - s["last"] >= millis)
        return F.struct(F.when(passes, x["t"]).otherwise(s["last"]).alias("last"), F.when(passes, x["event_id"].cast("long")).alias("passed"))

    return g.select(key, F.explode(X.running(F.col("l"), start, step, lambda s: s["passed"], "bigint")).alias("event_id")).where("event_id is not null")
