"""Status events: parsing, running counts, triggers and monitoring.

Every function takes and returns DataFrames. Those marked *stream* also work on
streaming ones; their batch form is the state after all events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "event_id string, source string, op string, record_id int, status_eval_first string, old_status_eval_first string, "
    "status_eval_final string, old_status_eval_final string, event_ts string, trace_id string, version string"
)
CHANGE_SCHEMA = (
    "data struct<type:string, record:struct<id:int, status_eval_first:string, status_eval_final:string>, "
    "old_record:struct<status_eval_first:string, status_eval_final:string>>"
)


def parse_events(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON text to event columns (malformed: nulls) with ``event_ts`` as a time. *stream*"""
    parsed = raw.select(F.from_json(F.col(value).cast("string"), EVENT_SCHEMA).alias("e")).select("e.*")
    return parsed.withColumn("event_ts", F.try_to_timestamp("event_ts"))


def normalize_changes(raw: DataFrame, value: str = "value") -> DataFrame:
    """Change payloads to events; a missing type is an update. *stream*"""
    e = raw.select("*", F.from_json(F.col(value).cast("string"), CHANGE_SCHEMA).alias("_c"))
    old = F.coalesce(F.col("_c.data.type"), F.lit("UPDATE")) == "UPDATE"
    return e.select(
        F.sha2(F.col(value).cast("string"), 256).alias("event_id"), F.coalesce("_c.data.type", F.lit("UPDATE")).alias("op"), F.col("_c.data.record.id").alias("record_id"),
        F.col("_c.data.record.status_eval_first").alias("status_eval_first"), F.when(old, F.col("_c.data.old_record.status_eval_first")).alias("old_status_eval_first"),
        F.col("_c.data.record.status_eval_final").alias("status_eval_final"), F.when(old, F.col("_c.data.old_record.status_eval_final")).alias("old_status_eval_final"), F.lit("1.0").alias("version"))


def is_valid(record: str, *statuses: str) -> Column:
    """A record id other than 0, and any status that isn't empty."""
    return (F.coalesce(F.col(record), F.lit(0)) != 0) & (F.coalesce(*[F.nullif(F.col(s), F.lit("")) for s in statuses]).isNotNull())


def once(events: DataFrame, key: str = "event_id", time: str = "event_ts", delay: str = "5 minutes") -> DataFrame:
    """Each event once. On a stream, redeliveries within ``delay`` go. *stream*"""
    if events.isStreaming:
        return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def status_counts(events: DataFrame, status: str = "status") -> DataFrame:
    """Running count of each status. *stream* (update or complete mode)"""
    return events.filter(F.col(status).isNotNull() & (F.col(status) != "")).groupBy(status).agg(F.count("*").alias("n"))


def level_triggers(counts: DataFrame, threshold: int, status: str = "status") -> DataFrame:
    """A trigger for every status that has reached the threshold. *stream*"""
    reached = counts.filter(F.col("n") >= threshold)
    return reached.select(F.col(status).alias("stage"), F.lit(threshold).alias("threshold"), F.col("n").alias("observed_count"), dedupe_key(F.col(status), F.col("n"), threshold).alias("dedupe_key"))


def dedupe_key(stage: Column, n: Column, threshold: int) -> Column:
    """One key for each multiple of the threshold that is reached."""
    return F.concat_ws(":", stage, F.lit(str(threshold)), F.floor(n / threshold).cast("string"))


def edge_triggers(events: DataFrame, threshold: int, batch: Column, status: str = "status") -> DataFrame:
    """Batch form of the edge trigger: at the end of which batches a status's
    count is at or above the threshold and higher than at its last trigger.

    Counts are first summed by batch and status; the running sum goes over that
    small table, by status.
    """
    from pyspark.sql import Window

    per = events.filter(F.col(status).isNotNull()).groupBy(batch.alias("batch"), status).agg(F.count("*").alias("n"))
    total = per.withColumn("observed_count", F.sum("n").over(Window.partitionBy(status).orderBy("batch")))
    return total.filter(F.col("observed_count") >= threshold).select("batch", F.col(status).alias("stage"), "observed_count")


def monitor(events: DataFrame, window: str = "5 minutes", time: str = "event_ts", group: str = "status", value: str = "latency_ms", delay: str = "10 minutes") -> DataFrame:
    """Tumbling windows per group: count, mean and high percentiles. *stream*"""
    if events.isStreaming:
        events = events.withWatermark(time, delay)
    w = F.window(time, window)
    return events.groupBy(w, group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile_approx(value, 0.95, 100000).alias("p95"), F.percentile_approx(value, 0.99, 100000).alias("p99")).select(F.col("window.start").alias("start"), group, "n", "mean", "p95", "p99")


def stalled(events: DataFrame, now: Column, minutes: int = 30, key: str = "record_id", time: str = "event_ts") -> DataFrame:
    """Keys without an event in the last minutes before ``now``."""
    last = events.groupBy(key).agg(F.max(time).alias("last_ts"))
    return last.filter(F.col("last_ts") < now - F.make_interval(mins=F.lit(minutes)))


def trigger_rows(triggers: DataFrame, key: str = "stage") -> DataFrame:
    """Key and JSON value, as a message sink takes them. *stream*"""
    return triggers.select(F.col(key).alias("key"), F.to_json(F.struct("*")).alias("value"))


def route_triggers(batch: DataFrame, log: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """Each trigger with its route: rejected, duplicate, unknown or run.

    Of triggers with one key only the first (by ``trigger_id``) can run.
    """
    first = batch.filter("dedupe_key is not null").groupBy("dedupe_key").agg(F.min("trigger_id").alias("_first")).withColumnRenamed("dedupe_key", "_k1")
    seen = log.select(F.col("dedupe_key").alias("_k")).distinct().withColumn("_seen", F.lit(True))
    both = batch.join(seen, F.col("dedupe_key") == F.col("_k"), "left").join(first, F.col("dedupe_key") == F.col("_k1"), "left")
    missing = F.col("trigger_id").isNull() | F.col("stage").isNull() | F.col("dedupe_key").isNull()
    route = F.when(missing, "rejected").when(F.col("_seen") | (F.col("trigger_id") != F.col("_first")), "duplicate").when(~F.col("stage").isin(*stages), "unknown").otherwise("run")
    return both.withColumn("route", route).drop("_k", "_k1", "_seen", "_first")
