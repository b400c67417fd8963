"""Registered queries of the library, with an independent SQL text for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusgauge.queries import analytics, events, growth, records, relational, reports, scores, streams

MODULES = (scores, analytics, relational, records, events, streams, growth, reports)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.QUERIES["d07_category_win_rates"](spark, sf_dir)
