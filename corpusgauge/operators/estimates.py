"""Estimated counts: mergeable sketches of distinct values, and sampled counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12

#: Relative standard error of a sketch with 2**lg_k registers after unions.
SKETCH_ERROR = 1.04


def distinct_sketches(df: DataFrame, groups: list[str], value: str, lg_k: int = LG_K) -> DataFrame:
    """``groups, sketch``: one sketch of a few KB for each finest group, built
    map-side, whatever the number of values; nulls aren't counted."""
    return df.groupBy(*groups).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def rolled_up(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Estimates for each prefix of ``groups`` down to the grand total, from the
    sketches alone: ``groups`` (null where rolled up), ``level`` (number of
    groups kept), ``estimate``."""
    made = sketches.rollup(*groups).agg(F.hll_union_agg("sketch").alias("_s"), F.grouping_id().alias("_g"))
    level = F.lit(len(groups)) - F.bit_count("_g")
    return made.select(*groups, level.cast("int").alias("level"), F.hll_sketch_estimate("_s").alias("estimate"))


def within(estimate: Column, exact: Column, lg_k: int = LG_K, sigmas: float = 4.0) -> Column:
    """Whether an estimate is as close as the sketch's error states."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * (sigmas * SKETCH_ERROR / 2 ** (lg_k / 2)))


def sampled_counts(df: DataFrame, groups: list[str], key: Column, share: float = 1 / 16, sigmas: float = 4.0, seed: int = 0) -> DataFrame:
    """``groups, estimate, low, high``: rows counted in a sample by hash of a
    row's key, so that reruns agree, with a normal interval of ``sigmas``
    standard errors (never below what was seen). Groups without a sampled row
    are missing; equal keys are sampled together."""
    sampled = df.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    seen = sampled.groupBy(*groups).agg(F.count("*").alias("_seen"))
    spread = sigmas * F.sqrt(F.col("_seen") * (1 - share)) / share
    estimate = F.col("_seen") / share
    return seen.select(*groups, estimate.alias("estimate"), F.greatest(F.col("_seen").cast("double"), estimate - spread - sigmas**2 / share).alias("low"), (estimate + spread + sigmas**2 / share).alias("high"))
