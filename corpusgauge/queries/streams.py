"""Queries that run streams: the given events arrive in four parts, the stream
is started again from its checkpoint for each, and its tables are the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.plans import inputs
from corpusgauge.queries.events import ONCE, VALID
from corpusgauge.streaming import events as ev
from corpusgauge.streaming import feed, sinks, stateful
from corpusgauge.streaming.store import BatchLog, KeyedState

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARTS = 4
STATUSES = ("done", "ready", "created", "score", "failed")


def query(sql: str):
    def keep(f: Callable[[SparkSession, DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, arriving(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return keep


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the part in which it arrives first."""
    return feed.part_of(inputs.frame(spark, sf_dir, "status_events").dropDuplicates(["event_id"]), "event_id", PARTS)


def redelivered(events: DataFrame) -> DataFrame:
    """Every twentieth event arrives again in the next part (the last: in its own)."""
    again = events.filter("event_id % 20 = 0").withColumn("part", F.least(F.col("part") + 1, F.lit(PARTS - 1)))
    return events.unionByName(again)


ARRIVING = f"(SELECT *, CAST(event_id * {PARTS} // (SELECT max(event_id) + 1 FROM events) AS BIGINT) AS part FROM {ONCE}) a"
DELIVERED = f"(SELECT * FROM {ARRIVING} UNION ALL SELECT * REPLACE (least(part + 1, {PARTS - 1}) AS part) FROM {ARRIVING} WHERE event_id % 20 = 0) d"
TOTALS = f"(SELECT status, part, sum(n) OVER (PARTITION BY status ORDER BY part) AS total FROM (SELECT status, part, count(*) AS n FROM {ARRIVING} WHERE status IS NOT NULL AND {{}} GROUP BY status, part) g) t"
#: A status's total when each part has arrived, whether or not the part has events of it.
AFTER = f"(SELECT s.status, p.part, (SELECT count(*) FROM {ARRIVING} WHERE status = s.status AND {VALID} AND a.part <= p.part) AS total FROM (SELECT DISTINCT status FROM {ARRIVING}) s, range({PARTS}) p(part)) f"


@query(f"""SELECT 'consumed' AS sink, CAST(event_id AS VARCHAR) AS key, 1 AS n, part AS batch FROM {ARRIVING} WHERE {VALID}
UNION ALL SELECT 'dead', event_id || ':' || CASE WHEN coalesce(record_id, 0) = 0 THEN 'no record' ELSE 'no status' END, 1, part FROM {DELIVERED} WHERE NOT ({VALID})
UNION ALL SELECT 'counts', status, count(*), NULL FROM {ARRIVING} WHERE {VALID} AND status IS NOT NULL GROUP BY status
UNION ALL SELECT 'log', status || ':500:' || total // 500, arg_min(total, part), min(part) FROM {AFTER} WHERE total >= 500 GROUP BY status, total // 500""")
def f16_stream_sinks(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The four tables of the event sink; the last batch is replayed at the end."""
    valid = ev.is_valid("record_id", "status", "old_status", "status_final")
    reason = F.when(F.coalesce("record_id", F.lit(0)) == 0, "no record").otherwise("no status")
    delivered = redelivered(events)
    sink_of = lambda root: sinks.EventSink(spark, f"{root}/tables", 500, valid, reason)
    root, _ = feed.in_parts(delivered, PARTS, lambda stream, root: sinks.run_to_end(stream, sink_of(root), f"{root}/checkpoint"))
    sink = sink_of(root)
    sink(delivered.filter(F.col("part") == PARTS - 1).drop("part"), PARTS - 1)
    one = F.lit(1).cast("long").alias("n")
    consumed = sink.consumed.read().select(F.lit("consumed").alias("sink"), F.col("event_id").cast("string").alias("key"), one, "batch")
    dead = sink.dead.read().select(F.lit("dead").alias("sink"), F.concat_ws(":", F.col("event_id").cast("string"), "dlq_reason").alias("key"), one, "batch")
    counts = sink.counts.state(PARTS).select(F.lit("counts").alias("sink"), F.col("status").alias("key"), "n", F.lit(None).cast("long").alias("batch"))
    log = sink.log.read().select(F.lit("log").alias("sink"), F.col("dedupe_key").alias("key"), F.col("observed_count").alias("n"), "batch")
    return consumed.unionByName(dead).unionByName(counts).unionByName(log)


MESSAGES = f"(SELECT event_id AS trigger_id, status AS stage, CASE WHEN record_id IS NOT NULL THEN status || ':' || record_id END AS dedupe_key, part FROM {DELIVERED} GROUP BY ALL) m"


@query(f"""SELECT trigger_id, batch, route, route = 'run' AS ran FROM (SELECT trigger_id, part AS batch, CASE WHEN stage IS NULL OR dedupe_key IS NULL THEN 'rejected'
  WHEN row_number() OVER (PARTITION BY dedupe_key ORDER BY part, trigger_id) > 1 THEN 'duplicate' WHEN stage NOT IN ('done', 'score') THEN 'unknown' ELSE 'run' END AS route FROM {MESSAGES}) r""")
def f16_stream_dispatch(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Routes of all trigger messages and whether a stage's handler got them."""
    key = F.concat(F.col("status"), F.lit(":"), F.col("record_id").cast("string"))
    messages = redelivered(events).select(F.col("event_id").alias("trigger_id"), F.col("status").alias("stage"), key.alias("dedupe_key"), "part")

    def work_of(root: str, stage: str) -> BatchLog:
        return BatchLog(spark, f"{root}/work/{stage}", "trigger_id long, stage string")

    def run(stream: DataFrame, root: str) -> object:
        handlers = {stage: (lambda new, batch, log=work_of(root, stage): log.write(new, batch)) for stage in ("done", "score")}
        return sinks.run_to_end(stream, sinks.TriggerDispatch(spark, f"{root}/tables", handlers), f"{root}/checkpoint")

    root, _ = feed.in_parts(messages, PARTS, run)
    work = work_of(root, "done").read().unionByName(work_of(root, "score").read()).select("trigger_id", "batch", F.lit(True).alias("_ran"))
    routes = sinks.TriggerDispatch(spark, f"{root}/tables", {}).routes.read()
    return routes.join(work, ["trigger_id", "batch"], "left").select("trigger_id", "batch", "route", F.coalesce("_ran", F.lit(False)).alias("ran"))


@query(f"SELECT event_id, status FROM {ONCE}")
def f18_stream_restart(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Events once in files, over four starts from one checkpoint, with bounded state."""
    def run(stream: DataFrame, root: str) -> object:
        return stateful.append_files(ev.once(stream).select("event_id", "status"), f"{root}/out", f"{root}/checkpoint")

    root, _ = feed.in_parts(redelivered(events), PARTS, run)
    return spark.read.schema("event_id long, status string").parquet(f"{root}/out")


@query(f"SELECT status AS stage, 900 AS threshold, total AS observed_count, status || ':900:' || total AS dedupe_key FROM {TOTALS.format('true')} WHERE total >= 900")
def f12_stream_edge(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Edge triggers from keyed state, looked at with each part; four starts."""
    def run(stream: DataFrame, root: str) -> object:
        return stateful.append_files(stateful.edge_triggers(stream, 900), f"{root}/out", f"{root}/checkpoint")

    root, _ = feed.in_parts(redelivered(events), PARTS, run)
    return spark.read.schema(stateful.TRIGGER).parquet(f"{root}/out").select("stage", "threshold", "observed_count", "dedupe_key")


DAYS = 10


@query(f"""WITH e AS (SELECT record_id, event_ts, event_ts - lag(event_ts) OVER (PARTITION BY record_id ORDER BY event_ts) AS since FROM {ONCE} WHERE record_id IS NOT NULL),
s AS (SELECT record_id, event_ts, count(*) FILTER (since IS NULL OR since >= INTERVAL 12 HOUR) OVER (PARTITION BY record_id ORDER BY event_ts) AS run FROM e),
r AS (SELECT record_id, min(event_ts) AS start, max(event_ts) + INTERVAL 12 HOUR AS stalled, count(*) AS n FROM s GROUP BY record_id, run)
SELECT record_id, epoch_us(start) AS start_us, epoch_us(stalled) AS end_us, n FROM r WHERE stalled <= (SELECT max(event_ts) FROM e) - INTERVAL {DAYS} DAY""")
def f19_stream_sessions(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Stalls that the stream has reported; every seventh event is a part late."""
    late = F.when(F.col("event_id") % 7 == 3, F.least(F.col("part") + 1, F.lit(PARTS - 1))).otherwise(F.col("part"))

    def run(stream: DataFrame, root: str) -> object:
        return stateful.append_files(stateful.sessions(stream, "12 hours", delay=f"{DAYS} days"), f"{root}/out", f"{root}/checkpoint")

    root, _ = feed.in_parts(events.withColumn("part", late).select("event_id", "record_id", "event_ts", "part"), PARTS, run)
    out = spark.read.schema("record_id long, start timestamp, end timestamp, n long").parquet(f"{root}/out")
    return out.select("record_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


CLOSED = f"time_bucket(INTERVAL '5 minutes', event_ts) + INTERVAL 5 MINUTE <= (SELECT max(event_ts) FROM {ONCE}) - INTERVAL {DAYS} DAY"


@query(f"SELECT CAST(epoch(time_bucket(INTERVAL '5 minutes', event_ts)) AS BIGINT) AS start, status, count(*) AS n, round(avg(latency_ms), 5) AS mean FROM {ONCE} WHERE {CLOSED} GROUP BY ALL")
def f13_stream_monitor(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Windows that the watermark (F9) has closed, late events within its delay
    included; each window comes out once, over four starts."""
    late = F.when(F.col("event_id") % 7 == 3, F.least(F.col("part") + 1, F.lit(PARTS - 1))).otherwise(F.col("part"))

    def run(stream: DataFrame, root: str) -> object:
        made = ev.monitor(stream, delay=f"{DAYS} days").select("start", "status", "n", "mean")
        return stateful.append_files(made, f"{root}/out", f"{root}/checkpoint")

    root, _ = feed.in_parts(events.withColumn("part", late).select("event_id", "status", "event_ts", "latency_ms", "part"), PARTS, run)
    out = spark.read.schema("start timestamp, status string, n long, mean double").parquet(f"{root}/out")
    return out.select(F.unix_seconds("start").alias("start"), "status", "n", F.round("mean", 5).alias("mean"))


@query(f"SELECT status, count(*) AS n FROM {ONCE} WHERE status IS NOT NULL GROUP BY status")
def f15_stream_running_counts(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Running counts in update mode, upserted with each micro-batch."""
    state_of = lambda root: KeyedState(spark, f"{root}/counts", "status string, n long", ("status",), every=3)

    def run(stream: DataFrame, root: str) -> object:
        state = state_of(root)
        return sinks.run_to_end(ev.status_counts(ev.once(stream)), state.upsert, f"{root}/checkpoint", "update")

    root, _ = feed.in_parts(redelivered(events), PARTS, run)
    state = state_of(root)
    return state.state((state.read().agg(F.max("batch")).first()[0] or 0) + 1)


@query(f"""SELECT status, delivered, once AS distinct_events, direct, direct - once AS lost, delivered - once AS redelivered,
  CASE WHEN direct <> once AND delivered <> once THEN 'LOSS AND REDELIVERY' WHEN direct > once THEN 'LOSS' WHEN direct < once THEN 'UNKNOWN EVENTS' WHEN delivered > once THEN 'REDELIVERY' ELSE 'OK' END AS verdict
FROM (SELECT status, count(*) FILTER (event_id % 97 <> 0 OR status <> 'failed') AS once, count(*) AS direct,
  count(*) FILTER (event_id % 97 <> 0 OR status <> 'failed') + count(*) FILTER (event_id % 20 = 0 AND status <> 'done' AND (event_id % 97 <> 0 OR status <> 'failed')) AS delivered FROM {ONCE} WHERE status IS NOT NULL GROUP BY status) x""")
def f17_stream_reconciliation_live(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Observed deliveries against the table: some failed events never arrive,
    every twentieth event but the done ones arrives twice."""
    sent = redelivered(events).filter("not (event_id % 97 = 0 and status <=> 'failed')")
    first = events.select(F.col("event_id").alias("_id"), F.col("part").alias("_part"))
    again = sent.filter("event_id % 20 = 0 and status <=> 'done'").dropDuplicates(["event_id"]).drop("part").join(first, F.col("event_id") == F.col("_id")).withColumnRenamed("_part", "part").drop("_id")
    sent = sent.filter("not (event_id % 20 = 0 and status <=> 'done')").unionByName(again)

    def run(stream: DataFrame, root: str) -> list:
        raw = stateful.counted(stream, "raw", STATUSES, "status")
        once = stateful.counted(ev.once(raw), "once", STATUSES, "status")
        q = once.writeStream.format("noop").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return list(q.recentProgress)

    _, runs = feed.in_parts(sent, PARTS, run)
    progress = [p for r in runs for p in r]
    return stateful.reconcile_observed(spark, stateful.observed_totals(progress, "raw"), stateful.observed_totals(progress, "once"), ev.status_counts(events), "status")
