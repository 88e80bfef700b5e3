"""Daily log windows with late data, latest-wins deduplication and leased work, as Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Records later than this after their day's end are dropped; a day is final then. (The watermark follows the records'
#: own times, not the wall clock.)
LATE = "45 minutes"
MAX_ATTEMPTS = 5


def admitted(records: DataFrame) -> DataFrame:
    """Records that may be counted: no errors of bots, no opt-outs."""
    return records.where((F.col("event_type") != "error") & F.col("user_id").isNotNull())


def daily_counts(records: DataFrame, ts: str = "ts", key: str = "event_type", late: str = LATE) -> DataFrame:
    """Counts by UTC day and key: a day is emitted once, when no record of it can come any more (append mode)."""
    return records.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), key, "n")


def peak_rates(records: DataFrame, ts: str = "ts") -> DataFrame:
    """The busiest second of each day (batch)."""
    per = records.groupBy(F.date_trunc("second", ts).alias("second")).agg(F.count("*").alias("n"))
    return per.groupBy(F.to_date("second").alias("day")).agg(F.max("n").alias("peak"))


def sessions(records: DataFrame, gap: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Runs of records of a key without a silence of ``gap``."""
    return records.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def newest(records: DataFrame, key: str, ts: str = "ts", late: str = LATE) -> DataFrame:
    """Each key once within the watermark, whichever record comes first."""
    return records.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def leases(messages: DataFrame, key: str = "key", lease: str = "10 minutes", keep: str = "14 days", late: str = LATE) -> DataFrame:
    """Work with a visibility lease as keyed state: columns key, action (send, receive, delete), ts.

    Emits each delivery: a message is handed out again when its lease ran out, at most five times, then as dead. The state of a
    key goes with its message (deleted or dead), and where nothing came for ``keep`` of the records' own time. Records later than
    ``late`` are dropped.
    """
    seconds, rest = int(pd.Timedelta(lease).total_seconds()), int(pd.Timedelta(keep).total_seconds() * 1000)

    def run(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        there, until, tries = state.get if state.exists else (False, 0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for ts, now, action in zip(rows["ts"], rows["ts"].map(pd.Timestamp.timestamp).astype(int), rows["action"]):
            if action == "send" and not there:
                there, until, tries = True, 0, 0
            elif action == "receive" and there and now >= until:
                tries += 1
                out.append((k[0], ts, tries, "dead" if tries > MAX_ATTEMPTS else "delivered"))
                there, until = tries <= MAX_ATTEMPTS, now + seconds
            elif action == "delete":
                there = False
        if there:
            state.update((there, until, tries))
            state.setTimeoutTimestamp(max(int(rows["ts"].iloc[-1].timestamp() * 1000) + rest, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "ts", "attempt", "state"])

    return messages.withWatermark("ts", late).groupBy(key).applyInPandasWithState(run, "key string, ts timestamp, attempt int, state string", "there boolean, until long, tries int", "append", GroupStateTimeout.EventTimeTimeout)


def limited(requests: DataFrame, per_minute: float, burst: int, key: str = "key", late: str = LATE) -> DataFrame:
    """Each request with whether its client may have it, and the seconds until it may: columns key, ts.

    A client has ``burst`` tokens, one of which comes back every 60 / ``per_minute`` seconds. The state is the time at which all
    tokens are back, and goes then.
    """
    each = 60.0 / per_minute

    def run(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        full = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, now in zip(rows["ts"], rows["ts"].map(pd.Timestamp.timestamp)):
            wait = full - now - each * (burst - 1)
            if wait <= 0:
                full = max(full, now) + each
            out.append((k[0], ts, wait <= 0, max(wait, 0.0)))
        state.update((full,))
        state.setTimeoutTimestamp(max(int(full * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "ts", "allowed", "wait"])

    return requests.withWatermark("ts", late).groupBy(key).applyInPandasWithState(run, "key string, ts timestamp, allowed boolean, wait double", "full double", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run an appending streaming query over what is there now, into Parquet, and give its rows.

    The files go to the folder that the cluster shares (``spark.checkpoint.dir``); a session on one machine may have none.
    """
    spark = stream.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="broadsheaf-stream-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"  # each run has a place of its own
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
