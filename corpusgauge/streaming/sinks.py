"""What a micro-batch does: counts, trigger log, consumed marks, dead letters,
dispatch of triggers to stages.

The classes are called by ``foreachBatch`` with a batch and its id. They write
only to ``store`` tables and read only what earlier batches wrote, so a replayed
batch changes nothing, and nothing of a batch goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.operators import tables
from corpusgauge.streaming import events as ev
from corpusgauge.streaming.store import BatchLog, KeyedState

Handler = Callable[[DataFrame, int], None]


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Run ``sink`` over all that the checkpoint hasn't seen, then stop."""
    query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@contextmanager
def kept(batch: DataFrame):
    """The batch, computed once for the sinks that read it."""
    batch = batch.persist()
    try:
        yield batch
    finally:
        batch.unpersist()


class EventSink:
    """Status events to four tables.

    dead: events that fail ``valid`` and why. consumed: a mark for each event,
    by the day of its time, so a batch meets only marks of its own days. counts:
    events by status, upserted. log: a trigger for each multiple of the
    threshold that a status has reached, absent ones only. Null event ids are
    dead letters; events without a status are consumed and not counted.
    """

    def __init__(self, spark: SparkSession, root: str, threshold: int, valid: Column, reason: Column, consumer: str = "counts", status: str = "status", time: str = "event_ts") -> None:
        self.threshold, self.consumer, self.status, self.time = threshold, consumer, status, time
        self.valid, self.reason = valid & F.col("event_id").isNotNull(), F.when(F.col("event_id").isNull(), "no event id").otherwise(reason)
        self.dead = BatchLog(spark, f"{root}/dead", "event_id long, dlq_reason string")
        self.consumed = BatchLog(spark, f"{root}/consumed", "event_id long, consumer string, day date", ("day",))
        self.counts = KeyedState(spark, f"{root}/counts", f"{status} string, n long", (status,))
        self.log = BatchLog(spark, f"{root}/log", "stage string, threshold int, observed_count long, dedupe_key string")

    def fresh(self, events: DataFrame, batch: int) -> DataFrame:
        """Events that no earlier batch has consumed, each once."""
        own = events.withColumn("day", F.coalesce(F.to_date(self.time), F.lit("1970-01-01").cast("date"))).dropDuplicates(["event_id"])
        marks = self.consumed.read(batch).filter(F.col("consumer") == self.consumer)
        days = own.select("day").distinct()
        # the days of a batch, at most as many as the calendar has, select the partitions of marks
        marks = marks.join(F.broadcast(days), "day", "left_semi").select("event_id")
        return own.join(marks, "event_id", "left_anti")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with kept(batch) as events:
            good, bad = tables.split_valid(events, self.valid, self.reason)
            self.dead.write(bad, batch_id)
            with kept(self.fresh(good, batch_id)) as fresh:
                self.consumed.write(fresh.withColumn("consumer", F.lit(self.consumer)), batch_id)
                more = ev.status_counts(fresh, self.status)
                old = self.counts.state(batch_id).withColumnRenamed("n", "_old")
                self.counts.upsert(more.join(old, self.status, "left").withColumn("n", F.col("n") + F.coalesce("_old", F.lit(0))), batch_id)
            triggers = ev.level_triggers(self.counts.state(batch_id + 1), self.threshold, self.status)
            self.log.write(tables.anti_on(triggers, self.log.read(batch_id), ["dedupe_key"]), batch_id)


class TriggerDispatch:
    """Trigger messages to the handlers of their stages.

    Every message, once in a batch, gets a route (``events.route_triggers``); keys that run, or
    whose stage is unknown, are logged and duplicates from then on. A handler
    gets its stage's new triggers of the batch as a DataFrame and the batch id;
    it is called again with the same ones if the batch is replayed. Afterwards
    they are marked as consumed.
    """

    def __init__(self, spark: SparkSession, root: str, handlers: dict[str, Handler], consumer: str = "dispatch") -> None:
        self.handlers, self.consumer = handlers, consumer
        self.routes = BatchLog(spark, f"{root}/routes", "trigger_id long, stage string, dedupe_key string, route string")
        self.log = BatchLog(spark, f"{root}/log", "trigger_id long, stage string, dedupe_key string")
        self.consumed = BatchLog(spark, f"{root}/consumed", "event_id long, consumer string")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        messages = batch.dropDuplicates(["trigger_id", "stage", "dedupe_key"])
        self.routes.write(ev.route_triggers(messages, self.log.read(batch_id), tuple(self.handlers)), batch_id)
        routed = self.routes.read().filter(F.col("batch") == batch_id)
        self.log.write(routed.filter("route in ('run', 'unknown')"), batch_id)
        for stage, handler in self.handlers.items():
            handler(routed.filter((F.col("route") == "run") & (F.col("stage") == stage)).drop("batch"), batch_id)
        self.consumed.write(routed.filter("route = 'run'").select(F.col("trigger_id").alias("event_id"), F.lit(self.consumer).alias("consumer")), batch_id)
