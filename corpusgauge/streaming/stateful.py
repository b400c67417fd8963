"""Stream operators that hold state: edge triggers, sessions, restart, observation.

State is bounded: by a watermark (seen ids, open sessions) or by an expiry of
idle keys (edge triggers). Everything restarts from a streaming checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusgauge.streaming import events as ev

TRIGGER = "stage string, threshold int, observed_count long, reason string, dedupe_key string"


def partial_counts(events: DataFrame, status: str, time: str) -> DataFrame:
    """Number of events and last time of each status in each Arrow batch, so
    that a keyed operator gets few rows, however many events a status has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.table(batch.columns, names=["status", "last_ts"]).group_by("status").aggregate([([], "count_all"), ("last_ts", "max")])
            yield from made.select(["status", "count_all", "last_ts_max"]).rename_columns(["status", "n", "last_ts"]).combine_chunks().to_batches()

    known = events.filter(F.col(status).isNotNull() & (F.col(status) != ""))
    known = known.select(F.col(status).alias("status"), F.col(time).alias("last_ts"))
    # the time stays the stream's event time: its field keeps the watermark
    own = known.schema["last_ts"]
    schema = T.StructType([known.schema["status"], T.StructField("n", T.LongType()), T.StructField("last_ts", own.dataType, True, own.metadata)])
    return known.mapInArrow(run, schema)


def edge_triggers(events: DataFrame, threshold: int, status: str = "status", time: str = "event_ts", delay: str = "5 minutes", idle_s: int | None = None, expire_s: int | None = None) -> DataFrame:
    """A trigger when a status's count is at or above the threshold and higher
    than at its last trigger. *stream*

    Events are taken once by ``event_id`` within the watermark's ``delay``. The
    state of a status is its count, the count of its last trigger, and its last
    event's time. Without ``idle_s`` the rule is looked at with every micro-batch
    that has events of the status; with it, only by a timer, when the watermark
    is ``idle_s`` seconds behind the status's last event. ``expire_s`` seconds
    behind it (or behind the timer's look) the state goes; a status that comes
    back counts from 0.
    """
    once = ev.once(events, time=time, delay=delay) if events.isStreaming else events
    parts = partial_counts(once, status, time)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, fired, last_ms, looked = state.get if state.exists else (0, 0, 0, False)

        def look() -> Iterator[pd.DataFrame]:
            nonlocal fired
            if n >= threshold and n > fired:
                fired = n
                yield pd.DataFrame([(key[0], threshold, n, "threshold_reached", f"{key[0]}:{threshold}:{n}")], columns=["stage", "threshold", "observed_count", "reason", "dedupe_key"])

        if state.hasTimedOut:
            if idle_s is None or looked:
                state.remove()
                return
            yield from look()
            looked = True
        else:
            for frame in frames:
                n += int(frame["n"].sum())
                last_ms = max(last_ms, int(frame["last_ts"].max().timestamp() * 1000))
            looked = False
            if idle_s is None:
                yield from look()
        state.update((n, fired, last_ms, looked))
        wait = idle_s if idle_s is not None and not looked else expire_s
        if wait is not None:
            # a timer has to be ahead of the watermark
            state.setTimeoutTimestamp(max(last_ms + wait * 1000, state.getCurrentWatermarkMs() + 1))

    return parts.groupBy("status").applyInPandasWithState(step, TRIGGER, "n long, fired long, last_ms long, looked boolean", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "record_id", time: str = "event_ts", delay: str = "10 minutes") -> DataFrame:
    """``key, start, end, n``: runs of a key's events without a gap; ``end`` is
    ``gap`` after the last one, when the key is stalled. *stream*: a session
    comes out when the watermark passes its end, so every key that has stalled
    by then is reported once for each stall, late events within ``delay``
    included. Events without a key or time are left out."""
    events = events.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    if events.isStreaming:
        events = events.withWatermark(time, delay)
    made = events.groupBy(key, F.session_window(time, gap).alias("_w")).agg(F.count("*").alias("n"))
    return made.select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def append_files(stream: DataFrame, out: str, checkpoint: str):
    """All that the checkpoint hasn't seen to Parquet files, exactly once."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def counted(events: DataFrame, name: str, values: tuple[str, ...], status: str) -> DataFrame:
    """``events``, observed: how many there are of each status. *stream*"""
    return events.observe(name, *[F.count_if(F.col(status) == v).alias(v) for v in values])


def observed_totals(progress: Iterable, name: str) -> dict[str, int]:
    """Sums of an observation over the micro-batches of a query's progress."""
    total: dict[str, int] = {}
    for p in progress:
        row = p.observedMetrics.get(name)
        for k, v in (row.asDict() if row is not None else {}).items():
            total[k] = total.get(k, 0) + (v or 0)
    return total


def reconcile_observed(spark: SparkSession, raw: dict[str, int], once: dict[str, int], direct: DataFrame, status: str) -> DataFrame:
    """Deliveries, distinct events and the table's own count of each observed
    status, with what was lost and what was delivered again.

    ``raw`` and ``once`` hold a number for each observed status; ``direct`` is
    ``status, n``.
    """
    seen = spark.createDataFrame([(k, raw[k], once.get(k, 0)) for k in raw], f"{status} string, delivered long, distinct_events long")
    both = seen.join(direct.select(status, F.col("n").alias("direct")), status, "left").withColumn("direct", F.coalesce("direct", F.lit(0)))
    lost, again = F.col("direct") - F.col("distinct_events"), F.col("delivered") - F.col("distinct_events")
    verdict = F.when((lost != 0) & (again != 0), "LOSS AND REDELIVERY").when(lost > 0, "LOSS").when(lost < 0, "UNKNOWN EVENTS").when(again > 0, "REDELIVERY").otherwise("OK")
    return both.withColumns({"lost": lost, "redelivered": again, "verdict": verdict})
