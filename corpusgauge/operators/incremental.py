"""Summaries of a growing table, kept from increment to increment.

An increment reads only rows beyond the high-water mark of an ascending key,
aggregates them, and stores the partial aggregates as a batch of its own; the
summary merges the batches. Nothing is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.streaming.store import BatchLog


def read_since(df: DataFrame, key: str, last: int | None) -> DataFrame:
    """Rows beyond the mark; all rows where there is none yet. The comparison
    is pushed down to the scan."""
    return df if last is None else df.filter(F.col(key) > F.lit(last))


class IncrementalSummary:
    """Counts and sums by group, added up over increments.

    ``parts`` names what is summed: each expression gives a whole number for a
    row (null: nothing). Rows that arrive with a key at or below the mark are
    not seen, as with any keyset scan; null keys never are. An increment that
    ends before its batch is complete is done again by the next call.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, group: str, group_type: str, parts: dict[str, Column]) -> None:
        self.key, self.group, self.parts = key, group, parts
        fields = ", ".join(f"{p} long" for p in parts)
        self.log = BatchLog(spark, path, f"{group} {group_type}, n long, {fields}, top long")

    def mark(self) -> tuple[int | None, int]:
        """The highest key seen and the number of the next batch."""
        row = self.log.read().agg(F.max("top").alias("top"), F.max("batch").alias("batch")).first()
        return row.top, 0 if row.batch is None else row.batch + 1

    def advance(self, df: DataFrame) -> int:
        """Take in what ``df`` holds beyond the mark; the number of its batch."""
        last, batch = self.mark()
        sums = [F.sum(c.cast("long")).alias(p) for p, c in self.parts.items()]
        new = read_since(df.filter(F.col(self.key).isNotNull()), self.key, last).groupBy(self.group).agg(F.count("*").alias("n"), *sums, F.max(self.key).cast("long").alias("top"))
        self.log.write(new, batch)
        return batch

    def totals(self) -> DataFrame:
        """``group, n`` and the sum of each part, merged over all batches."""
        return self.log.read().groupBy(self.group).agg(F.sum("n").alias("n"), *[F.sum(p).alias(p) for p in self.parts])
