"""Tables that micro-batches write to, safe to replay.

A table is a folder on shared storage with one partition for each batch id. A
batch replaces its own partition and reads only those before it, so running it
again, after a crash or a redelivery, leaves every table as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BatchLog:
    """Rows of each batch in a partition of their own.

    ``scope`` names columns of the rows that partition a batch further; a reader
    that joins on them reads only the scopes it meets.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, scope: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.scope = spark, path, scope
        fields = T._parse_datatype_string(schema).fields
        self.columns = [f.name for f in fields]
        self.schema = T.StructType([*[f for f in fields if f.name not in scope], T.StructField("batch", T.LongType()), *[f for f in fields if f.name in scope]])
        if not self.columns:
            raise ValueError("a table needs columns")
        # a first, empty partition, so that reads find the folder
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1" + "".join(f"/{c}=__HIVE_DEFAULT_PARTITION__" for c in scope))

    def write(self, rows: DataFrame, batch: int) -> None:
        """Replace what this batch has written before."""
        rows.select(*self.columns).write.mode("overwrite").partitionBy(*self.scope).parquet(f"{self.path}/batch={batch}")

    def read(self, before: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        rows = rows if before is None else rows.filter(F.col("batch") < before)
        return rows.select(*self.columns, "batch")


class KeyedState(BatchLog):
    """The last value of each key. Every ``every`` batches a partition holds all
    keys, so no read goes back further."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], every: int = 16) -> None:
        super().__init__(spark, path, schema)
        self.keys, self.every = list(keys), every
        self.values = [c for c in self.columns if c not in keys]

    def state(self, before: int) -> DataFrame:
        """Keys and values after all batches before ``before``."""
        since = max(before - 1, 0) // self.every * self.every
        rows = self.read(before).filter(F.col("batch") >= since)
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.values), "batch").alias("_v"))
        return last.select(*self.keys, "_v.*")

    def upsert(self, changed: DataFrame, batch: int) -> None:
        """New values of some keys; others keep theirs."""
        rows = changed.select(*self.columns)
        if batch % self.every == 0:
            rows = rows.unionByName(self.state(batch).join(rows.select(*self.keys), self.keys, "left_anti"))
        self.write(rows, batch)
