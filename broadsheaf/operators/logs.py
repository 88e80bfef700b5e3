"""Operational log rollups: latest rows, conditional sums, silences, breakdowns over missing tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rollup(rows: DataFrame, key: str, ts: str, value: str, kind: str) -> DataFrame:
    """Per key: counts, conditional sums, first and last rows, distinct kinds."""
    return rows.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(F.col(kind) == "error").alias("errors"), F.sum(F.when(F.col(kind) == "purchase", F.col(value))).alias("sold"), F.avg(F.when(F.col(kind) != "error", F.col(value))).alias("mean"),
        F.count_distinct(kind).alias("kinds"), F.max_by(kind, F.struct(ts, "event_id")).alias("last_kind"), F.min_by(kind, F.struct(ts, "event_id")).alias("first_kind"), F.array_sort(F.collect_set(kind)).alias("set"),
    )


def breakdown(rows: DataFrame, columns: list[str], value: str | None = None) -> DataFrame:
    """Counts by each of several columns, as (kind, key, n), by grouping sets in one pass."""
    named = rows.select(*(F.col(c).cast("string").alias(c) for c in columns))
    g = named.groupingSets([[c] for c in columns], *columns).agg(F.grouping_id(*columns).alias("g"), F.count("*").alias("n"))
    full = (1 << len(columns)) - 1
    kind = reduce(lambda w, i: w.when(F.col("g") == full - (1 << (len(columns) - 1 - i)), columns[i]), range(1, len(columns)), F.when(F.col("g") == full - (1 << (len(columns) - 1)), columns[0]))
    return g.select(kind.alias("kind"), F.coalesce(*columns).alias("key"), "n")


def union_existing(spark: SparkSession, schema: str, *frames: DataFrame | None) -> DataFrame:
    """What exists of several tables, over an empty one."""
    out = spark.createDataFrame([], schema)
    for f in frames:
        if f is not None:
            out = out.unionByName(f, allowMissingColumns=True)
    return out


def silent(rows: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """Keys whose last line is older than so many minutes before the last line of all."""
    last = rows.groupBy(key).agg(F.max(ts).alias("last"))
    now = rows.agg(F.max(ts).alias("now"))
    return last.crossJoin(F.broadcast(now)).where(F.unix_timestamp("now") - F.unix_timestamp("last") > 60 * minutes).select(key, "last")  # one row


def top_searches(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def normalised_query(q):
    """White space and controls folded, trimmed, 256 characters at most."""
    return F.substring(F.trim(F.regexp_replace(q, r"[\p{Cntrl}\s]+", " ")), 1, 256)
