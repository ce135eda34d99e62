"""Queries over orders (as a library), customers (as owners) and events, with their SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import library as B
from ..operators import progress as P
from ..sources import tables as S


def orders(spark, d):
    return S.table(spark, d, "orders")


def owner_docs(spark, d):
    return B.owned(orders(spark, d), "o_custkey", 7).select("o_orderkey", "o_custkey", "o_totalprice")


def visible_docs(spark, d):
    deleted = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate"))
    return B.visible(orders(spark, d).withColumn("deleted_at", deleted)).select("o_orderkey", "o_custkey")


def status_gate(spark, d):
    return B.in_status(orders(spark, d), "o_orderstatus", "F").select("o_orderkey", "o_orderstatus")


def history_order(spark, d):
    """Library order of one owner: last opened (finished orders' date), then newest."""
    opened = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    o = B.owned(orders(spark, d), "o_custkey", 7).withColumn("at", F.coalesce(opened, F.col("o_orderdate")))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("at"), F.desc("o_orderdate"), "o_orderkey")
    return o.select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


def history_order_all(spark, d):
    """Library order of every owner."""
    o = orders(spark, d)
    at = F.coalesce(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")), F.col("o_orderdate"))
    w = Window.partitionBy("o_custkey").orderBy(at.desc(), F.desc("o_orderdate"), "o_orderkey")
    return o.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


def summaries(spark, d):
    o = orders(spark, d).withColumn("translated", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))
    return o.select("o_orderkey", "o_orderstatus", F.col("translated").isNotNull().alias("has_translated"))


def summaries_by_time(spark, d):
    o = orders(spark, d)
    return B.newest_first(o.select("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderstatus", "place")


def membership(spark, d):
    """Documents of owners in the BUILDING segment."""
    c = S.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return orders(spark, d).join(c, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def favourites(spark, d):
    """Favourite ids (each owner's dearest document) among all documents."""
    o = orders(spark, d)
    best = o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"))
    return o.join(best.select("o_orderkey"), "o_orderkey", "left_semi").select("o_custkey", "o_orderkey")


def priority_union(spark, d):
    o = orders(spark, d)
    cached = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("cached").alias("origin"))
    return B.priority_union(cached, o.select("o_orderkey", F.lit("stored").alias("origin")), "o_orderkey")


def delete_by_key(spark, d):
    o = orders(spark, d)
    gone = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    return S.deleted(o, gone, ["o_orderkey", "o_custkey"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def latest_state(spark, d):
    return B.latest(S.events(spark, d).select("user_id", "event_id", "event_type", "value"), "user_id", F.col("event_id"))


def upsert_view(spark, d):
    e = S.events(spark, d).select("user_id", "event_id", "event_type", F.col("event_id").alias("created_id"))
    return S.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id", "created_id").select("user_id", "created_id", "event_id", "event_type")


def session_validity(spark, d):
    """Events inside their user's validity: ten days from a start that depends on the user."""
    e = S.events(spark, d)
    users = e.select("user_id").distinct()
    start = F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(days=(F.col("user_id") % 15).cast("int"))
    s = users.select("user_id", start.alias("created"), (start + F.expr("interval 10 days")).alias("expires"))
    return B.valid_sessions(e, s, "user_id", "ts").select("event_id", "user_id")


def stalled_runs(spark, d):
    return B.stalled(S.events(spark, d), "user_id", "event_type", "view", "purchase").select("user_id", F.unix_micros("started").alias("started_us"))


def review_decisions(spark, d):
    e = S.events(spark, d)
    p = e.where("event_type = 'view'").select(F.col("event_id").alias("proposal_id"), "user_id", "ts")
    c = e.where("event_type = 'click'").select("user_id", "ts", F.when(F.col("value") > 50, "accept").otherwise("reject").alias("decision"))
    return B.decided(p, c, "user_id", timedelta(hours=6)).select("proposal_id", F.coalesce("decision", F.lit("timeout")).alias("decision"))


def reading_position(spark, d):
    r = P.debounced(S.events(spark, d), "user_id", "2 hours")
    return r.select("user_id", F.unix_micros("start").alias("start_us"), "moves", F.round("value", 6).alias("value"))


def throttled_input(spark, d):
    return P.throttled(S.events(spark, d), "user_id", 3_600_000)


def capped_mean(spark, d):
    m = P.capped_mean(S.events(spark, d), "event_type", "value", ["ts", "event_id"])
    return m.select("event_type", F.round("avg", 6).alias("avg"), "n")


def _stages(spark, d):
    """Event types as a user's stages: done with 20 events or more, running with ten."""
    g = S.events(spark, d).groupBy("user_id", F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.sum("value").alias("elapsed"))
    status = F.when(F.col("n") >= 20, "done").when(F.col("n") >= 10, "running").otherwise("pending")
    return g.withColumns({"status": status, "weight": F.length("stage").cast("double"), "share": F.col("n") / 20})


def stage_progress(spark, d):
    return P.percent(_stages(spark, d), "user_id", F.col("share"))


def stage_eta(spark, d):
    means = P.capped_mean(S.events(spark, d), "event_type", "value", ["ts", "event_id"]).select(F.col("event_type").alias("stage"), F.round(F.col("avg") * 20, 4).alias("avg"))
    s = _stages(spark, d).withColumn("elapsed", F.round("elapsed", 4))
    return P.eta(s, means, "user_id")


def load_levels(spark, d):
    e = S.events(spark, d)
    status = F.when(F.col("event_type") == "purchase", "limited").when((F.col("event_type") == "click") & (F.hour("ts") < 12), "error").otherwise("ok")
    calls = e.select(F.hour("ts").cast("long").alias("level"), status.alias("status"), F.col("value").alias("latency"))
    return P.load_levels(calls, "level", 12.0, most_errors=0.3).select("level", "calls", "ok", "limited", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), F.round("rps", 6).alias("rps"), "is_best")


def resume_frontier(spark, d):
    s = _stages(spark, d)
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("stage")) - 1
    s = s.select("user_id", "stage", "status", pos.alias("pos"), F.when(F.col("user_id") % 2 == 0, "purchase").otherwise("nothing").alias("failed"))
    return P.resume(s, "user_id", "failed").select("user_id", "stage", "next")


QUERIES = {
    f.__name__: f
    for f in (
        owner_docs, visible_docs, status_gate, history_order, history_order_all, summaries, summaries_by_time, membership, favourites, priority_union, delete_by_key, latest_state, upsert_view, session_validity,
        stalled_runs, review_decisions, reading_position, throttled_input, capped_mean, stage_progress, stage_eta, load_levels, resume_frontier,
    )
}

_STAGES = "g as (select user_id, event_type as stage, count(*) n, sum(value) as elapsed from events group by all), st as (select *, case when n >= 20 then 'done' when n >= 10 then 'running' else 'pending' end as status, cast(length(event_type) as double) as weight, n / 20 as share from (select *, stage as event_type from g))"
_MEAN = """num as (select event_type, value, row_number() over (partition by event_type order by ts, event_id) k, count(*) over (partition by event_type) n from events),
mean as (select event_type, sum(value * case when k <= 20 then pow(0.95, greatest(n - 20, 0)) / least(n, 20) else pow(0.95, n - k) / 20 end) as avg, max(n) as n from num group by event_type)"""

ORACLES = {
    "owner_docs": "select o_orderkey, o_custkey, o_totalprice from orders where o_custkey = 7",
    "visible_docs": "select o_orderkey, o_custkey from orders where o_orderpriority <> '5-LOW'",
    "status_gate": "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'",
    "history_order": "select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey) as place from orders where o_custkey = 7",
    "history_order_all": "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as place from orders",
    "summaries": "select o_orderkey, o_orderstatus, o_orderstatus = 'F' as has_translated from orders",
    "summaries_by_time": "select o_orderkey, o_orderstatus, row_number() over (order by o_orderdate desc nulls last, o_orderkey) as place from orders",
    "membership": "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')",
    "favourites": "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) r from orders) where r = 1",
    "priority_union": "select o_orderkey, case when o_orderkey % 3 = 0 then 'cached' else 'stored' end as origin from orders",
    "delete_by_key": "select o_orderpriority, count(*) n from orders where o_orderpriority <> '1-URGENT' group by 1",
    "latest_state": "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) r from events) where r = 1",
    "upsert_view": "select user_id, min(event_id) created_id, max(event_id) event_id, arg_max(event_type, event_id) event_type from events group by user_id",
    "session_validity": "select event_id, user_id from events where ts >= timestamp '2024-01-01' + to_days(cast(user_id % 15 as int)) and ts < timestamp '2024-01-01' + to_days(cast(user_id % 15 as int) + 10)",
    "stalled_runs": "select user_id, epoch_us(v) started_us from (select user_id, max(ts) filter (event_type = 'view') v, max(ts) filter (event_type = 'purchase') p from events group by 1) where v is not null and (p is null or p < v)",
    "review_decisions": """with v as (select event_id, user_id, ts from events where event_type = 'view'), c as (select user_id, ts t, case when value > 50 then 'accept' else 'reject' end dec from events where event_type = 'click')
select event_id as proposal_id, coalesce(arg_min(dec, t), 'timeout') as decision from v left join c on v.user_id = c.user_id and t >= ts and t <= ts + interval 6 hours group by event_id""",
    "reading_position": """with g as (select *, case when ts - lag(ts) over w < interval 2 hours then 0 else 1 end f from events window w as (partition by user_id order by ts)), s as (select *, sum(f) over (partition by user_id order by ts) k from g)
select user_id, epoch_us(min(ts)) start_us, count(*) moves, round(arg_max(value, ts), 6) as value from s group by user_id, k""",
    "throttled_input": """with recursive n as (select user_id, event_id, epoch_ms(ts) t, row_number() over (partition by user_id order by ts, event_id) r from events),
f as (select user_id, r, event_id, t as last, true as hit from n where r = 1 union all select n.user_id, n.r, n.event_id, case when n.t - f.last >= 3600000 then n.t else f.last end, n.t - f.last >= 3600000 from f join n on n.user_id = f.user_id and n.r = f.r + 1)
select user_id, event_id from f where hit""",
    "capped_mean": f"with {_MEAN} select event_type, round(avg, 6) as avg, n from mean",
    "stage_progress": f"with {_STAGES} select user_id, cast(round_even(round(100 * sum(weight * case when status = 'done' then 1.0 when status = 'running' then least(1.0, share) else 0.0 end) / sum(weight), 9), 0) as bigint) as percent from st group by user_id",
    "stage_eta": f"with {_MEAN}, {_STAGES} select user_id, cast(trunc(sum(case when status = 'done' then 0.0 when status = 'running' then greatest(round(avg * 20, 4) - round(elapsed, 4), 0.0) else round(avg * 20, 4) end)) as bigint) as eta from st join mean using (event_type) group by user_id",
    "load_levels": """with c as (select hour(ts) as level, case when event_type = 'purchase' then 'limited' when event_type = 'click' and hour(ts) < 12 then 'error' else 'ok' end as status, value from events),
o as (select level, value, row_number() over (partition by level order by value) - 1 k, count(*) over (partition by level) n from c where status = 'ok'),
a as (select level, count(*) calls, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'limited') as limited, median(value) filter (status = 'ok') as med from c group by level),
p as (select level, value as p95 from o where k = greatest(0, cast(floor(n * 0.95) as bigint) - 1)),
b as (select arg_max(level, ok) best from a where 1 - ok / calls <= 0.3 and ok > 0)
select level, calls, ok, limited, round(med, 6) as median, round(p95, 6) as p95, round(ok / 12.0, 6) as rps, coalesce(level = best, false) as is_best from a left join p using (level), b""",
    "resume_frontier": f"with {_STAGES}, p as (select user_id, stage, status, row_number() over (partition by user_id order by stage) - 1 as pos from st), q as (select *, max(case when user_id % 2 = 0 and stage = 'purchase' then pos end) over (partition by user_id) as cut from p) select user_id, stage, case when pos >= coalesce(cut, 0) then 'pending' else status end as next from q",
}
