"""Streams over small files: replays, crashes, restarts, timers, late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusgauge.streaming import events as ev
from corpusgauge.streaming import feed, sinks, stateful
from corpusgauge.streaming.store import BatchLog, KeyedState

SCHEMA = "event_id long, status string, record_id long, event_ts timestamp"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def events(spark, rows):
    """(event_id, status, record_id, minute) rows."""
    return spark.createDataFrame([(i, s, r, None if m is None else at(m)) for i, s, r, m in rows], SCHEMA)


class Feed:
    """Files that arrive one by one, and a stream over them."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)

    def arrive(self, rows):
        events(self.spark, rows).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        return self.spark.readStream.schema(SCHEMA).parquet(f"{self.path}/in")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- tables -------------------------------------------------------------------

def test_a_batch_replaces_its_own_rows_only(spark, tmp_path):
    log = BatchLog(spark, f"{tmp_path}/log", "k string, n long")
    df = lambda *rows: spark.createDataFrame(list(rows), "k string, n long")
    assert rows_of(log.read()) == []
    log.write(df(("a", 1)), 0)
    log.write(df(("b", 2), ("c", 3)), 1)
    log.write(df(("b", 2)), 1)
    assert rows_of(log.read()) == [("a", 1, 0), ("b", 2, 1)] and rows_of(log.read(before=1)) == [("a", 1, 0)]
    again = BatchLog(spark, f"{tmp_path}/log", "k string, n long")
    assert rows_of(again.read()) == [("a", 1, 0), ("b", 2, 1)]


def test_state_is_the_last_value_and_reads_go_back_little(spark, tmp_path):
    state, want = KeyedState(spark, f"{tmp_path}/state", "k string, n long", ("k",), every=3), {}
    for batch in range(8):
        changed = {f"k{batch % 5}": batch, "often": batch * 10}
        state.upsert(spark.createDataFrame(list(changed.items()), "k string, n long"), batch)
        want |= changed
        assert dict(rows_of(state.state(batch + 1))) == want
    assert dict(rows_of(state.state(3))) == {"k0": 0, "k1": 1, "k2": 2, "often": 20}
    whole = {r.batch: r.n for r in state.read().groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert whole[6] == 6 and whole[7] == 2


# ---- sinks ----------------------------------------------------------------------

def plan_of(seed=0):
    """Three files: null ids, bad rows, redelivery within a file and across files."""
    first = [(i, ["done", "ready", None][i % 3], i, i) for i in range(1, 30)] + [(5, "ready", 5, 5), (None, "done", 7, 7), (100, "done", 0, 8), (101, "", None, 9), (102, "done", 3, None)]
    second = [(i, "done", i, i) for i in range(25, 40)] + [(102, "done", 3, None)]
    third = [(i, "done", i, 2000 + i) for i in range(39, 45)] + [(1, "ready", 1, 1)]
    return [first, second, third]


def sink_of(spark, root, **options):
    reason = F.when(F.coalesce("record_id", F.lit(0)) == 0, "no record").otherwise("no status")
    valid = (F.coalesce("record_id", F.lit(0)) != 0) & ~F.col("status").eqNullSafe("")
    return sinks.EventSink(spark, f"{root}/tables", 5, valid, reason, **options)


def want_of(parts):
    seen, counts, log, dead = set(), {}, {}, []
    for batch, part in enumerate(parts):
        for i, status, record, _ in part:
            if i is None or not record or status == "":
                dead.append((i, "no event id" if i is None else "no record" if not record else "no status", batch))
            elif i not in seen:
                seen.add(i)
                if status:
                    counts[status] = counts.get(status, 0) + 1
        for s, n in counts.items():
            if n >= 5:
                log.setdefault(f"{s}:5:{n // 5}", (n, batch))
    return seen, counts, log, sorted(dead, key=repr)


def tables_of(sink, batches):
    return (
        sorted(r.event_id for r in sink.consumed.read().collect()),
        {r.status: r.n for r in sink.counts.state(batches).collect()},
        {r.dedupe_key: (r.observed_count, r.batch) for r in sink.log.read().collect()},
        rows_of(sink.dead.read()),
    )


class Broken(Exception):
    pass


@pytest.mark.parametrize("broken_at", [None, "consumed", "counts", "log"])
def test_event_sink_survives_a_crash_between_its_tables(spark, tmp_path, broken_at):
    """The second batch fails after one of its writes; the restart replays it."""
    parts, source = plan_of(), Feed(spark, tmp_path)
    for k, rows in enumerate(parts):
        stream, sink = source.arrive(rows), sink_of(spark, tmp_path)
        if k == 1 and broken_at:
            table = getattr(sink, broken_at)
            write = table.write
            table.write = lambda *a: (write(*a), (_ for _ in ()).throw(Broken("after the write")))
            with pytest.raises(Exception, match="after the write"):
                sinks.run_to_end(stream, sink, f"{tmp_path}/checkpoint")
            sink = sink_of(spark, tmp_path)
        sinks.run_to_end(stream, sink, f"{tmp_path}/checkpoint")
    seen, counts, log, dead = want_of(parts)
    got = tables_of(sink_of(spark, tmp_path), 3)
    assert got == (sorted(seen), counts, log, dead)
    # a batch that is called again changes nothing
    sink_of(spark, tmp_path)(events(spark, parts[2]), 2)
    assert tables_of(sink_of(spark, tmp_path), 3) == got


def test_dispatch_runs_each_key_once(spark, tmp_path):
    called = []
    handlers = {s: (lambda new, batch, s=s: called.append((s, batch, sorted(r.trigger_id for r in new.collect())))) for s in ("run", "other")}
    schema = "trigger_id long, stage string, dedupe_key string"
    batches = [[(1, "run", "a"), (2, "run", "a"), (2, "run", "a"), (3, "what", "w"), (None, "run", "n"), (4, None, "m"), (5, "run", None)], [(6, "run", "a"), (7, "other", "b"), (8, "what", "w")]]
    dispatch = sinks.TriggerDispatch(spark, str(tmp_path), handlers)
    for k, rows in enumerate([*batches, batches[1]]):
        dispatch(spark.createDataFrame(rows, schema), min(k, 1))
    assert called == [("run", 0, [1]), ("other", 0, []), ("run", 1, []), ("other", 1, [7]), ("run", 1, []), ("other", 1, [7])]
    routes = [(r.trigger_id, r.route) for r in dispatch.routes.read().collect()]
    assert sorted(routes, key=repr) == sorted([(1, "run"), (2, "duplicate"), (3, "unknown"), (None, "rejected"), (4, "rejected"), (5, "rejected"), (6, "duplicate"), (7, "run"), (8, "duplicate")], key=repr)
    assert sorted(r.event_id for r in dispatch.consumed.read().collect()) == [1, 7]


# ---- state ----------------------------------------------------------------------

def edge(spark, source, out, rows, **options):
    stream = source.arrive(rows)
    stateful.append_files(stateful.edge_triggers(stream, 3, **options), f"{out}/out", f"{out}/checkpoint")
    return sorted((r.stage, r.observed_count) for r in spark.read.schema(stateful.TRIGGER).parquet(f"{out}/out").collect())


def test_edge_trigger_by_batch_and_over_restarts(spark, tmp_path):
    source = Feed(spark, tmp_path)
    go = lambda rows: edge(spark, source, tmp_path, rows)
    assert go([(1, "done", 1, 0), (2, "done", 1, 1), (3, "x", 1, 1), (4, None, 1, 1), (5, "", 1, 1)]) == []
    assert go([(6, "done", 1, 2), (6, "done", 1, 2)]) == [("done", 3)]
    assert go([(6, "done", 1, 2), (7, "x", 1, 3)]) == [("done", 3)]
    assert go([(8, "x", 1, 3), (9, "done", 1, 3), (10, "done", 1, 3)]) == [("done", 3), ("done", 5), ("x", 3)]


def test_edge_trigger_waits_for_its_timer_and_expires(spark, tmp_path):
    source = Feed(spark, tmp_path)
    go = lambda rows: edge(spark, source, tmp_path, rows, idle_s=600, expire_s=3600)
    assert go([(i, "done", 1, i) for i in range(5)]) == []
    assert go([(10, "x", 1, 30)]) == [("done", 5)]
    assert go([(11, "x", 1, 31), (12, "done", 1, 31), (3, "done", 1, 3)]) == [("done", 5)]
    assert go([(13, "x", 1, 60)]) == [("done", 5), ("done", 6)]
    # five hours later both counts are gone; they start from 0
    assert go([(14, "y", 1, 400)]) == [("done", 5), ("done", 6), ("x", 3)]
    assert go([(15, "done", 1, 401), (16, "done", 1, 401)]) == [("done", 5), ("done", 6), ("x", 3)]
    assert go([(17, "done", 1, 402), (18, "y", 1, 900)])[-1] == ("x", 3)


def test_stream_and_batch_report_the_same_stalls(spark, tmp_path):
    rows = [(i, "s", k, m) for i, (k, m) in enumerate([(1, 0), (1, 10), (1, 100), (2, 5), (2, 20), (2, 45), (3, 90), (None, 1), (4, None), (1, 104), (9, 300)])]
    late = [(50, "s", 1, 25), (51, "s", 2, 60)]
    source = Feed(spark, tmp_path)
    for part in (rows[:4] + rows[6:9], rows[4:6] + late, rows[9:]):
        stream = source.arrive(part)
        stateful.append_files(stateful.sessions(stream, "30 minutes", delay="2 hours"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = rows_of(spark.read.schema("record_id long, start timestamp, end timestamp, n long").parquet(f"{tmp_path}/out"))
    batch = stateful.sessions(events(spark, rows + late), "30 minutes")
    assert got == rows_of(batch.filter(F.col("end") <= F.lit(at(180))))
    assert [(r[0], r[3]) for r in got] == [(1, 3), (1, 2), (2, 4), (3, 1)]


def test_restart_gives_the_table_of_one_run(spark, tmp_path):
    rows = [[(i, "s", 1, 20 * k + i % 20) for i in range(20 * k, 20 * k + 20)] for k in range(3)]
    rows[1] += [(i, "s", 1, i) for i in (15, 16, 17)]
    for name, splits in (("one", [rows[0] + rows[1] + rows[2]]), ("three", rows)):
        source = Feed(spark, tmp_path / name)
        for part in splits:
            stateful.append_files(ev.once(source.arrive(part)).select("event_id"), f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/checkpoint")
        assert rows_of(spark.read.schema("event_id long").parquet(f"{tmp_path}/{name}/out")) == [(i,) for i in sorted(range(60), key=lambda i: repr((i,)))]


def test_loss_and_redelivery_are_told_apart(spark, tmp_path):
    kinds = {"ok": (6, 6, 0), "lost": (4, 6, 0), "again": (6, 6, 2), "both": (5, 6, 1), "extra": (6, 4, 0)}
    sent, known, n = [], [], 0
    for status, (arrive, direct, twice) in kinds.items():
        ids = list(range(n, n + 10))
        n += 10
        sent += [(i, status, 1, i % 5) for i in ids[:arrive] + ids[:twice]]
        known += [(status, direct)]
    progress, source = [], Feed(spark, tmp_path)
    for part in (sent[::2], sent[1::2]):
        raw = stateful.counted(source.arrive(part), "raw", tuple(kinds), "status")
        q = stateful.counted(ev.once(raw), "once", tuple(kinds), "status").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        progress += q.recentProgress
    totals = [stateful.observed_totals(progress, name) for name in ("raw", "once")]
    got = {r.status: (r.lost, r.redelivered, r.verdict) for r in stateful.reconcile_observed(spark, *totals, spark.createDataFrame(known, "status string, n long"), "status").collect()}
    assert got == {"ok": (0, 0, "OK"), "lost": (2, 0, "LOSS"), "again": (0, 2, "REDELIVERY"), "both": (1, 1, "LOSS AND REDELIVERY"), "extra": (-2, 0, "UNKNOWN EVENTS")}


def test_parts_cover_all_rows(spark):
    rows = spark.range(0, 103).withColumnRenamed("id", "k")
    got = feed.part_of(rows, "k", 4).groupBy("part").count().collect()
    assert sorted(r.part for r in got) == [0, 1, 2, 3] and sum(r["count"] for r in got) == 103
    assert feed.part_of(rows.limit(0), "k", 4).count() == 0
