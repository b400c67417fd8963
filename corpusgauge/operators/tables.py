"""Keyed updates, routing and deduplication as functions of DataFrames.

Nothing is written here: each function returns the table that a sink would
hold. Keys are compared null-safely.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def same_keys(keys: list[str], prefix: str = "_r_") -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def renamed(df: DataFrame, prefix: str = "_r_") -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns})


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one of the greatest order columns (partial
    aggregation, so that a hot key isn't sorted in one task)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def earliest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def keep_latest(df: DataFrame, keys: list[str], order: list[str], row_id: str) -> tuple[DataFrame, DataFrame]:
    """The latest row of each key, and the ids of all others."""
    kept = latest(df, keys, order)
    ids = renamed(kept.select(row_id))
    dropped = df.join(ids, same_keys([row_id]), "left_anti").select(row_id)
    return kept, dropped


def merge_update(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Sets the update's columns on rows with its key; never inserts."""
    right = renamed(updates).withColumn("_hit", F.lit(True))
    joined = base.join(right, same_keys(keys), "left")
    changed = [c for c in updates.columns if c not in keys]
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_r_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in base.columns])


def upsert(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the update replace those of their key, or are added."""
    return anti_on(base, updates, keys).unionByName(updates)


def anti_on(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(renamed(other.select(*keys).distinct()), same_keys(keys), "left_anti")


def semi_on(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(renamed(other.select(*keys).distinct()), same_keys(keys), "left_semi")


def append_if_absent(base: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The log with the first of each new key added."""
    return base.unionByName(anti_on(earliest(new, keys, order), base, keys))


def reconcile(stream: DataFrame, direct: DataFrame, keys: list[str]) -> DataFrame:
    """Counts ``n`` of both sides by key: delta (stream less direct) and verdict."""
    right = renamed(direct)
    joined = stream.withColumn("_l", F.lit(True)).join(right.withColumn("_d", F.lit(True)), same_keys(keys), "full_outer")
    verdict = F.when(F.col("_l").isNull(), "MISSING_FROM_STREAM").when(F.coalesce("n", F.lit(0)) == F.coalesce("_r_n", F.lit(0)), "OK").otherwise("MISMATCH")
    return joined.select(*[F.when(F.col("_l"), F.col(k)).otherwise(F.col(f"_r_{k}")).alias(k) for k in keys], F.col("n").alias("stream"), F.col("_r_n").alias("direct"),
                         (F.coalesce("n", F.lit(0)) - F.coalesce("_r_n", F.lit(0))).alias("delta"), verdict.alias("verdict"))


def split_valid(df: DataFrame, valid: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the others with ``dlq_reason``."""
    ok = F.coalesce(valid, F.lit(False))
    return df.filter(ok), df.filter(~ok).withColumn("dlq_reason", reason)


def exact_cut(df: DataFrame, order: list[Column], share: float, buckets: int = 4096) -> DataFrame:
    """``df`` with ``part``: train for the first ``floor(share * n)`` rows by
    ``order``, else val, and ``place`` from 1.

    The first order column is a hash in [0, 1) or any number scaled to it:
    rows are counted per bucket of it, the counts are cumulated, and places are
    given inside a bucket, so no task sorts the whole table.
    """
    from pyspark.sql import Window

    placed = df.withColumn("_bucket", F.least(F.lit(buckets - 1), F.floor(order[0] * buckets)).cast("int"))
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    run = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(run), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy())}).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    out = placed.join(offsets, "_bucket").withColumn("place", F.col("_before") + inside)
    return out.withColumn("part", F.when(F.col("place") <= F.floor(F.lit(share) * F.col("_all")), "train").otherwise("val")).drop("_bucket", "_before", "_all")


def checkpoints_to_long(df: DataFrame, id_col: str, prefixes: tuple[str, ...], n: int, mark: str = "_ckpt") -> DataFrame:
    """``id, checkpoint`` and a column for each prefix, from columns named
    prefix, mark, number; checkpoints where all of them are null are left out."""
    rows = [F.struct(F.lit(k).alias("checkpoint"), *[F.col(f"{p}{mark}{k}").alias(p) for p in prefixes]) for k in range(1, n + 1)]
    long = df.select(id_col, F.explode(F.array(*rows)).alias("x")).select(id_col, "x.*")
    return long.filter(F.coalesce(*[F.col(p).cast("string") for p in prefixes]).isNotNull())


def first_of_files(spark: SparkSession, glob: str, schema: str, keys: list[str], **options: str) -> DataFrame:
    """All CSV files that a pattern names, the first row of each key: by file
    path, then by place in the file. Files of any size are read in splits; a
    split's start and the order of reading give a row's place."""
    rows = spark.read.schema(schema).options(**{"header": "true"} | options).csv(glob)
    names = rows.columns
    placed = rows.select(*names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    return earliest(placed, keys, ["_file", "_start", "_row"]).select(*names)


def scaled(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_u`` in [0, 1): a key's place between the table's least and
    greatest, so that ``exact_cut`` has buckets that follow the data at every
    size. Runs once over the key."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    width = float((high or 0) - (low or 0)) + 1.0
    return df.withColumn("_u", (F.col(key) - F.lit(low or 0)) / F.lit(width))


def hash_unit(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the md5 of seed and key, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
