"""Queries over tables that grow: increments, sketches and sampled counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.operators import estimates
from corpusgauge.operators.incremental import IncrementalSummary
from corpusgauge.plans import inputs
from corpusgauge.session import read_table, shared_dir
from corpusgauge.streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SC = f"({inputs.text('scored')}) s"
STATES = ("score", "finetune", "output_tuned", "score_tuned", "completed")


def query(sql: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


@query("SELECT checkpoint, count(*) AS total, count(*) FILTER (status IS NULL) AS n_null, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in STATES)
       + f", round(avg(overall / 10000.0), 4) AS base, round(avg(overall_tuned / 10000.0), 4) AS tuned, round(avg((coalesce(overall_tuned, 0) - overall) / 10000.0), 4) AS gain, 4 AS increments FROM {SC} GROUP BY checkpoint")
def a10_incremental_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint summary from four increments behind a stored high-water mark;
    each sees the whole table so far and reads only what is new."""
    rows = feed.part_of(inputs.frame(spark, sf_dir, "scored"), "id", 4)
    is_state = {f"n_{s}": F.when(F.col("status") == s, 1).otherwise(0) for s in STATES}
    parts = {"n_null": F.when(F.col("status").isNull(), 1).otherwise(0), **is_state, "base": F.col("overall"), "tuned": F.col("overall_tuned"), "n_tuned": F.when(F.col("overall_tuned").isNotNull(), 1).otherwise(0), "gain": F.coalesce("overall_tuned", F.lit(0)) - F.col("overall")}
    path = f"{shared_dir(spark)}/summary-{uuid.uuid4().hex}"
    for k in range(4):
        # a new object each time: all that is known is in the stored batches
        last = IncrementalSummary(spark, path, "id", "checkpoint", "int", parts)
        batch = last.advance(rows.filter(F.col("part") <= k))
    total = last.totals()
    mean = lambda part, n: F.round(F.try_divide(F.col(part) / 10000.0, F.col(n)), 4)
    return total.select("checkpoint", F.col("n").alias("total"), "n_null", *is_state, mean("base", "n").alias("base"), mean("tuned", "n_tuned").alias("tuned"), mean("gain", "n").alias("gain"), F.lit(batch + 1).alias("increments"))


LINES = "(SELECT l_returnflag AS mode, year(l_shipdate) AS year, l_orderkey FROM lineitem) l"


@query(f"SELECT mode, year, CAST(CASE WHEN mode IS NULL THEN 0 WHEN year IS NULL THEN 1 ELSE 2 END AS INT) AS level, count(DISTINCT l_orderkey) AS exact, true AS within FROM {LINES} GROUP BY ROLLUP (mode, year)")
def d25_sketch_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct orders by mode and year, by mode, and in all, from one sketch for
    each finest group, beside exact counts and whether the error holds."""
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("mode"), F.year("l_shipdate").alias("year"), "l_orderkey")
    made = estimates.rolled_up(estimates.distinct_sketches(lines, ["mode", "year"], "l_orderkey"), ["mode", "year"])
    exact = lines.rollup("mode", "year").agg(F.count_distinct("l_orderkey").alias("exact"), F.grouping_id().alias("_g")).withColumn("level", (2 - F.bit_count("_g")).cast("int")).drop("_g")
    same = F.col("e.mode").eqNullSafe(F.col("x.mode")) & F.col("e.year").eqNullSafe(F.col("x.year")) & (F.col("e.level") == F.col("x.level"))
    both = made.alias("e").join(exact.alias("x"), same)
    return both.select("x.mode", F.col("x.year").cast("long").alias("year"), "x.level", "x.exact", estimates.within(F.col("estimate"), F.col("exact")).alias("within"))


@query("SELECT l_returnflag AS flag, count(*) AS exact, true AS covered FROM lineitem GROUP BY l_returnflag")
def d19_estimated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts estimated from a sixteenth of the rows, and whether the interval
    holds the exact count."""
    lines = read_table(spark, sf_dir, "lineitem")
    made = estimates.sampled_counts(lines.withColumnRenamed("l_returnflag", "flag"), ["flag"], F.struct("l_orderkey", "l_linenumber"))
    exact = lines.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("exact"))
    return made.join(exact, "flag").select("flag", "exact", ((F.col("exact") >= F.col("low")) & (F.col("exact") <= F.col("high"))).alias("covered"))
