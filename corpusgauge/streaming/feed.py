"""A table as a stream: its rows arrive in parts, a run of the stream after each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.session import settle, shared_dir


def part_of(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` with ``part``: n equal ranges of an integer key from 0 on."""
    top = (rows.agg(F.max(key)).first()[0] or 0) + 1
    return rows.withColumn("part", F.floor(F.col(key) * n / F.lit(top)).cast("int"))


def in_parts(rows: DataFrame, n: int, run: Callable[[DataFrame, str], object]) -> tuple[str, list]:
    """Let the rows of each ``part`` arrive, then call ``run(stream, folder)``.

    Every run starts the stream anew from the checkpoint it keeps below
    ``folder``. Returns the folder and what the runs returned.
    """
    spark = rows.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    staged = settle(rows)
    schema = staged.drop("part").schema
    results = []
    for k in range(n):
        staged.filter(F.col("part") == k).drop("part").write.mode("append").parquet(f"{root}/in")
        results.append(run(spark.readStream.schema(schema).parquet(f"{root}/in"), root))
    return root, results
