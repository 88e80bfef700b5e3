"""Log analytics in batch, and the same windows as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import logs as L
from ..registry import register
from ..sources.corpus import table
from ..streaming import logs as S


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def stream(spark, sf_dir):
    read = spark.readStream.schema(events(spark, sf_dir).schema).parquet(f"{sf_dir}/events.parquet*")
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


@register("q_log_rollup", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(sum(value) FILTER (event_type = 'purchase'), 4) AS sold, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean, count(DISTINCT event_type) AS kinds, max_by(event_type, (ts, event_id)) AS last_kind, min_by(event_type, (ts, event_id)) AS first_kind, list_sort(list(DISTINCT event_type)) AS set FROM events GROUP BY 1")
def _rollup(spark, sf_dir):
    return L.rollup(events(spark, sf_dir), "user_id", "ts", "value", "event_type").withColumns({"sold": F.round("sold", 4), "mean": F.round("mean", 6)})


@register("q_log_breakdown", "WITH e AS (SELECT event_type, ts::DATE::VARCHAR AS day, (user_id % 10)::VARCHAR AS grp FROM events) SELECT CASE WHEN grouping(event_type) = 0 THEN 'event_type' WHEN grouping(day) = 0 THEN 'day' ELSE 'grp' END AS kind, coalesce(event_type, day, grp) AS key, count(*) AS n FROM e GROUP BY GROUPING SETS ((event_type), (day), (grp))")
def _breakdown(spark, sf_dir):
    return L.breakdown(events(spark, sf_dir).select("event_type", F.to_date("ts").alias("day"), F.pmod("user_id", F.lit(10)).alias("grp")), ["event_type", "day", "grp"])


@register("q_log_union", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def _union(spark, sf_dir):
    e = events(spark, sf_dir).select("event_type", "value")
    return L.union_existing(spark, "event_type string, value double", e.where("event_type = 'view'"), None, e.where("event_type = 'click'").drop("value")).groupBy("event_type").agg(F.count("*").alias("n"))


@register("q_log_silent", "WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id, last FROM l WHERE epoch(date_trunc('second', (SELECT max(ts) FROM events)))::BIGINT - epoch(date_trunc('second', last))::BIGINT > 60 * 720")
def _silent(spark, sf_dir):
    return L.silent(events(spark, sf_dir), "user_id", "ts", 720)


@register("q_top_searches", "SELECT q, count(*) AS n FROM (SELECT event_type || ' ' || (user_id % 7) AS q FROM events) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def _top(spark, sf_dir):
    q = F.concat(F.lit("  "), "event_type", F.lit(" \n"), F.pmod("user_id", F.lit(7)).cast("string"))
    return L.top_searches(events(spark, sf_dir).select(L.normalised_query(q).alias("q")), "q", 12)


@register("q_peak_rates", "WITH p AS (SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM events GROUP BY 1) SELECT m::DATE AS day, max(n) AS peak FROM p GROUP BY 1")
def _peak(spark, sf_dir):
    return S.peak_rates(events(spark, sf_dir).withColumn("ts", F.date_trunc("minute", "ts")))


@register("q_percentiles", "SELECT event_type, count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1")
def _percentiles(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.round(F.stddev_samp("value"), 6).alias("sd"))


@register("q_json_props", "SELECT (props->>'$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1")
def _json(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@register("q_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def _sessions(spark, sf_dir):
    return S.sessions(events(spark, sf_dir), "6 hours")


@register("q_stream_days", "WITH e AS (SELECT ts::DATE AS day, event_type FROM events WHERE event_type <> 'error') SELECT day, event_type, count(*) AS n FROM e WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 45 MINUTE FROM events WHERE event_type <> 'error') GROUP BY 1, 2")
def _days(spark, sf_dir):
    """Days that are final: the watermark is the last record's time less the lateness."""
    return S.drained(S.daily_counts(S.admitted(stream(spark, sf_dir))), f"days_{uuid.uuid4().hex}")


@register("q_stream_newest", "SELECT count(DISTINCT user_id) AS keys FROM events")
def _newest(spark, sf_dir):
    s = stream(spark, sf_dir).select("user_id", "ts")
    return S.drained(S.newest(s, "user_id", late="400 days"), f"newest_{uuid.uuid4().hex}").agg(F.count_distinct("user_id").alias("keys"))


@register("q_stream_leases")
def _leases(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "send").when(F.col("event_type") == "purchase", "delete").otherwise("receive")
    m = stream(spark, sf_dir).select(F.pmod("user_id", F.lit(50)).cast("string").alias("key"), kind.alias("action"), "ts")
    return S.drained(S.leases(m, lease="6 hours"), f"leases_{uuid.uuid4().hex}").groupBy("state").agg(F.count("*").alias("n"))


@register("q_rate_limit")
def _limit(spark, sf_dir):
    m = stream(spark, sf_dir).select(F.pmod("user_id", F.lit(50)).cast("string").alias("key"), "ts")
    return S.drained(S.limited(m, 1 / 180, 3), f"limit_{uuid.uuid4().hex}").groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))
