"""A user's batch function over records of like length.

Records are dealt out by ranges of their length, so a batch holds records of
nearly one length and little of it is padding. The function gets batches of a
fixed size; its results are keyed by id, so the caller may join them back in any
order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_length(df: DataFrame, length: Column, id_col: str, partitions: int | None = None) -> DataFrame:
    """Rows in partitions by ranges of length, sorted within each; ids break
    ties, so a single common length still spreads."""
    made = df.withColumn("_length", F.coalesce(length, F.lit(0)))
    keys = [F.col("_length"), F.col(id_col)]
    ranged = made.repartitionByRange(partitions, *keys) if partitions else made.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def in_batches(df: DataFrame, run: Callable[[pd.DataFrame], pd.Series], length: Column, id_col: str = "id", size: int = 50, result: str = "string", partitions: int | None = None) -> DataFrame:
    """``id, result, batch_rows, batch_padding``: what ``run`` gives for each
    record of a batch of at most ``size`` records of like length.

    ``run`` gets the columns of ``df`` and returns one value for each row, in
    order. ``batch_padding`` is the length that the batch's records lack to its
    longest one, in all. Every row comes back once, whatever the order, rows of
    equal ids too; null lengths count as 0; a full batch may join the end of one
    Arrow batch with the start of the next.
    """
    names = df.columns
    kind = df.schema[id_col].dataType.simpleString()

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(part: pd.DataFrame) -> pd.DataFrame:
            values = list(run(part[names].reset_index(drop=True)))
            if len(values) != len(part):
                raise ValueError("the batch function has to return a value for each row")
            lengths = part["_length"]
            return pd.DataFrame({id_col: part[id_col].to_numpy(), "result": values, "batch_rows": len(part), "batch_padding": int((lengths.max() - lengths).sum())})

        rest = None
        for frame in frames:
            rest = frame if rest is None or rest.empty else pd.concat([rest, frame], ignore_index=True)
            whole = len(rest) // size * size
            for at in range(0, whole, size):
                yield done(rest.iloc[at : at + size])
            rest = rest.iloc[whole:]
        if rest is not None and len(rest):
            yield done(rest)

    return by_length(df, length, id_col, partitions).mapInPandas(step, f"{id_col} {kind}, result {result}, batch_rows long, batch_padding long")


def padding(df: DataFrame, length: Column, order: list[Column], size: int = 50) -> DataFrame:
    """``total, padded``: summed lengths, and summed lengths when every ``size``
    records in a partition, in the given order, are padded to their longest."""
    from pyspark.sql import Window

    made = df.select(F.coalesce(length, F.lit(0)).alias("_n"), *[c.alias(f"_o{i}") for i, c in enumerate(order)]).withColumn("_part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*[f"_o{i}" for i in range(len(order))])) - 1
    blocks = made.withColumn("_block", F.floor(place / size)).groupBy("_part", "_block").agg(F.sum("_n").alias("total"), (F.max("_n") * F.count("*")).alias("padded"))
    return blocks.agg(F.sum("total").alias("total"), F.sum("padded").alias("padded"))
