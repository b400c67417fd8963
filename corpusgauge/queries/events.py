"""Queries over the status events: batch forms of the stream operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.operators import tables
from corpusgauge.plans import inputs
from corpusgauge.streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
EV = f"({inputs.text('status_events')}) e"
ONCE = f"(SELECT DISTINCT * FROM {EV}) o"


def query(sql: str, table: str = "status_events"):
    def keep(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(inputs.frame(spark, sf_dir, table))
        ORACLES[f.__name__] = sql
        return f

    return keep


def as_json(df: DataFrame) -> DataFrame:
    """Events as message texts; every thirtieth is cut short."""
    fields = F.struct(F.col("event_id").cast("string").alias("event_id"), "op", F.col("record_id").cast("int").alias("record_id"), F.col("status").alias("status_eval_first"), F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("event_ts"))
    text = F.to_json(fields)
    return df.select(F.when(F.col("event_id") % 30 == 0, F.substring(text, 1, 10)).otherwise(text).alias("value"))


BROKEN = "event_id % 30 = 0"


@query(f"SELECT CASE WHEN NOT {BROKEN} THEN CAST(event_id AS VARCHAR) END AS event_id, CASE WHEN NOT {BROKEN} THEN op END AS op, CASE WHEN NOT {BROKEN} THEN record_id END AS record_id, CASE WHEN NOT {BROKEN} THEN status END AS status FROM {EV}")
def a02_json_events(df):
    return ev.parse_events(as_json(df)).select("event_id", "op", F.col("record_id").cast("long").alias("record_id"), F.col("status_eval_first").alias("status"))


@query(f"SELECT CASE WHEN NOT {BROKEN} THEN CAST(event_id AS VARCHAR) END AS event_id, CASE WHEN NOT {BROKEN} THEN CAST(floor(epoch(event_ts)) AS BIGINT) END AS seconds FROM {EV}")
def a03_event_time(df):
    return ev.parse_events(as_json(df)).select("event_id", F.unix_seconds("event_ts").alias("seconds"))


COUNTS = f"SELECT status, count(*) AS n FROM {ONCE} WHERE status IS NOT NULL GROUP BY status"
KEY = "status || ':500:' || CAST(floor(n / 500) AS BIGINT)"


@query(f"SELECT status AS key, '{{\"stage\":\"' || status || '\",\"threshold\":500,\"observed_count\":' || n || ',\"dedupe_key\":\"' || {KEY} || '\"}}' AS value FROM ({COUNTS}) c WHERE n >= 500")
def a04_trigger_rows(df):
    return ev.trigger_rows(ev.level_triggers(ev.status_counts(ev.once(df)), 500))


@query(f"SELECT status, CASE WHEN status = 'done' THEN 7 ELSE n END AS n FROM ({COUNTS}) c UNION ALL SELECT 'global', -1")
def a05_count_upsert(df):
    """Old counts with a stale and a foreign row, replaced by the new ones."""
    counts = ev.status_counts(ev.once(df))
    stale = counts.filter("status <> 'failed'").withColumn("n", F.lit(0).cast("long")).unionByName(counts.filter("status = 'done'").select(F.lit("global").alias("status"), F.lit(-1).cast("long").alias("n")))
    new = counts.withColumn("n", F.when(F.col("status") == "done", F.lit(7)).otherwise(F.col("n")).cast("long"))
    return tables.upsert(stale, new, ["status"])


@query(f"SELECT record_id, min(event_id) AS event_id FROM {EV} WHERE record_id IS NOT NULL GROUP BY record_id")
def a06_append_if_absent(df):
    rows = df.filter("record_id is not null").select("record_id", "event_id")
    log = tables.earliest(rows.filter("record_id % 2 = 0"), ["record_id"], ["event_id"])
    return tables.append_if_absent(log, rows, ["record_id"], ["event_id"])


@query(f"SELECT DISTINCT event_id, 'evaluator' AS consumer FROM {EV}")
def a07_consumed_mark(df):
    marks = df.select("event_id", F.lit("evaluator").alias("consumer"))
    return tables.append_if_absent(marks.filter("event_id % 3 = 0").distinct(), marks, ["event_id", "consumer"], [])


VALID = "coalesce(record_id, 0) <> 0 AND coalesce(status, old_status, status_final, '') <> ''"


@query(f"SELECT event_id, CASE WHEN coalesce(record_id, 0) = 0 THEN 'no record' ELSE 'no status' END AS dlq_reason FROM {EV} WHERE NOT ({VALID})")
def a08_dead_letters(df):
    reason = F.when(F.coalesce("record_id", F.lit(0)) == 0, "no record").otherwise("no status")
    return tables.split_valid(df, ev.is_valid("record_id", "status", "old_status", "status_final"), reason)[1].select("event_id", "dlq_reason")


@query(f"SELECT event_id, record_id FROM {EV} WHERE {VALID}")
def b06_valid_events(df):
    return df.filter(ev.is_valid("record_id", "status", "old_status", "status_final")).select("event_id", "record_id")


@query(f"SELECT CASE WHEN event_id % 5 = 0 THEN 'INSERT' ELSE 'UPDATE' END AS op, record_id, status AS status_eval_first, CASE WHEN event_id % 5 <> 0 THEN old_status END AS old_status_eval_first, status_final AS status_eval_final FROM {EV}")
def b05_change_payloads(df):
    """Payloads lack the type of updates, which is the default."""
    record = F.struct(F.col("record_id").cast("int").alias("id"), F.col("status").alias("status_eval_first"), F.col("status_final").alias("status_eval_final"))
    old = F.struct(F.col("old_status").alias("status_eval_first"))
    payload = F.to_json(F.struct(F.struct(F.when(F.col("op") == "INSERT", "INSERT").alias("type"), record.alias("record"), old.alias("old_record")).alias("data")))
    made = ev.normalize_changes(df.select(payload.alias("value")))
    return made.select("op", F.col("record_id").cast("long").alias("record_id"), "status_eval_first", "old_status_eval_first", "status_eval_final")


@query(f"SELECT event_id FROM {EV} WHERE status = 'done'")
def b07_target_status(df):
    return df.filter("status = 'done'").select("event_id")


@query(f"SELECT event_id, coalesce(status, '') <> coalesce(old_status, '') AS changed FROM {EV} WHERE op = 'UPDATE'")
def e05_status_changes(df):
    return df.filter("op = 'UPDATE'").select("event_id", (F.coalesce("status", F.lit("")) != F.coalesce("old_status", F.lit(""))).alias("changed"))


@query(f"SELECT count(*) AS n FROM {EV} WHERE status = 'done'")
def f10_running_count(df):
    """Counts deliveries, as the plain running count does."""
    return df.filter("status = 'done'").agg(F.count("*").alias("n"))


@query(f"SELECT status AS stage, 500 AS threshold, n AS observed_count, {KEY} AS dedupe_key FROM ({COUNTS}) c WHERE n >= 500")
def f11_level_trigger(df):
    return ev.level_triggers(ev.status_counts(ev.once(df)), 500)


@query(f"SELECT batch, status AS stage, total AS observed_count FROM (SELECT batch, status, sum(n) OVER (PARTITION BY status ORDER BY batch) AS total FROM (SELECT event_id // 1000 AS batch, status, count(*) AS n FROM {ONCE} WHERE status IS NOT NULL GROUP BY ALL) a) b WHERE total >= 900")
def f12_edge_trigger(df):
    return ev.edge_triggers(ev.once(df), 900, F.floor(F.col("event_id") / 1000))


@query(f"SELECT CAST(epoch(time_bucket(INTERVAL '5 minutes', event_ts)) AS BIGINT) AS start, status, count(*) AS n, round(avg(latency_ms), 5) AS mean, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99 FROM {ONCE} GROUP BY ALL")
def f13_monitor(df):
    return ev.monitor(ev.once(df)).select(F.unix_seconds("start").alias("start"), "status", "n", F.round("mean", 5).alias("mean"), "p95", "p99")


@query(f"SELECT count(*) AS n FROM {ONCE}")
def f14_event_dedup(df):
    return ev.once(df).agg(F.count("*").alias("n"))


@query(COUNTS)
def f15_status_counts(df):
    return ev.status_counts(ev.once(df))


ROUTED = f"SELECT event_id AS trigger_id, status AS stage, CASE WHEN record_id IS NOT NULL THEN status || ':' || record_id END AS dedupe_key FROM {ONCE}"


@query(f"WITH b AS ({ROUTED}), l AS (SELECT DISTINCT dedupe_key AS k FROM b WHERE trigger_id % 7 = 0), f AS (SELECT dedupe_key AS k, min(trigger_id) AS first FROM b GROUP BY 1) SELECT trigger_id, CASE WHEN stage IS NULL OR dedupe_key IS NULL THEN 'rejected' WHEN l.k IS NOT NULL OR trigger_id <> first THEN 'duplicate' WHEN stage NOT IN ('done', 'score') THEN 'unknown' ELSE 'run' END AS route FROM b LEFT JOIN l ON l.k = dedupe_key LEFT JOIN f ON f.k = dedupe_key")
def f16_trigger_routes(df):
    batch = ev.once(df).select(F.col("event_id").alias("trigger_id"), F.col("status").alias("stage"), F.concat(F.col("status"), F.lit(":"), F.col("record_id").cast("string")).alias("dedupe_key"))
    log = batch.filter("trigger_id % 7 = 0 and dedupe_key is not null")
    return ev.route_triggers(batch, log, ("done", "score")).select("trigger_id", "route")


@query(f"WITH s AS (SELECT status, count(*) AS n FROM {EV} WHERE status IS NOT NULL GROUP BY status), d AS ({COUNTS}) SELECT s.status, s.n AS stream, d.n AS direct, s.n - d.n AS delta, CASE WHEN s.n = d.n THEN 'OK' ELSE 'MISMATCH' END AS verdict FROM s JOIN d ON s.status = d.status")
def f17_stream_reconciliation(df):
    return tables.reconcile(ev.status_counts(df), ev.status_counts(ev.once(df)), ["status"])


@query(f"SELECT event_id, status FROM {ONCE} WHERE event_id % 3 <> 0")
def f18_replay_safety(df):
    """Events that no earlier run has consumed, each once."""
    return tables.anti_on(ev.once(df), df.filter("event_id % 3 = 0"), ["event_id"]).select("event_id", "status")


@query(f"SELECT record_id FROM {EV} GROUP BY record_id HAVING max(event_ts) < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 MINUTE")
def f19_stalled(df):
    return ev.stalled(df, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("record_id")


@query(f"SELECT status, count(*) AS n, round(avg(latency_ms), 5) AS mean, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95 FROM {ONCE} GROUP BY status")
def a20_latency_probe(df):
    return ev.once(df).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 5).alias("mean"), F.percentile_approx("latency_ms", 0.5, 1000000).alias("p50"), F.percentile_approx("latency_ms", 0.95, 1000000).alias("p95"))
