"""Before and after: improvement summaries over pairs of metric columns.

A metric m is compared with ``m_tuned``. Everything is aggregated in one pass
over the wide table; only the resulting row is turned into a row per metric.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 10000.0


def encode(value: Column, null: str = "zero") -> Column:
    """A score as an integer in ten thousandths, half to even."""
    code = F.rint(value * SCALE).cast("int")
    return F.coalesce(code, F.lit(0)) if null == "zero" else code


def decode(code: Column) -> Column:
    return F.round(F.coalesce(code, F.lit(0)) / SCALE, 4)


def per_metric(df: DataFrame, metrics: tuple[str, ...], aggregates: dict[str, callable], groups: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates of each metric, made in one pass, as a row per metric."""
    wide = df.groupBy(*groups).agg(*[f(m).alias(f"{m}__{name}") for m in metrics for name, f in aggregates.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}__{n}").alias(n) for n in aggregates]) for m in metrics])).alias("x")
    return wide.select(*groups, rows).select(*groups, "x.*")


def before(m: str) -> Column:
    return F.coalesce(F.col(m), F.lit(0)) / SCALE


def after(m: str) -> Column:
    return F.coalesce(F.col(f"{m}_tuned"), F.lit(0)) / SCALE


def percent(m: str) -> Column:
    return F.try_divide(after(m) - before(m), before(m)) * 100


def improvement(df: DataFrame, metrics: tuple[str, ...], rule: str) -> DataFrame:
    """Mean before and after, percent and absolute gain, by one of three rules.

    ``positive_base``: rows with a base above 0 only; ``zero_base``: all rows, 0
    percent without a base; ``means``: rows with both values, percent of means.
    """
    if rule == "positive_base":
        ok = lambda m: before(m) > 0
        gain = lambda m: F.avg(F.when(ok(m), percent(m)))
    elif rule == "zero_base":
        ok = lambda m: F.lit(True)
        gain = lambda m: F.avg(F.when(before(m) > 0, percent(m)).otherwise(0.0))
    elif rule == "means":
        ok = lambda m: F.col(m).isNotNull() & F.col(f"{m}_tuned").isNotNull()
        mean = lambda m, v: F.avg(F.when(ok(m), v(m)))
        gain = lambda m: F.when(mean(m, before) > 0, (mean(m, after) - mean(m, before)) / mean(m, before) * 100).otherwise(0.0)
    else:
        raise ValueError(f"unknown rule {rule}")
    return per_metric(df, metrics, {
        "n": lambda m: F.count_if(ok(m)),
        "mean_before": lambda m: F.avg(F.when(ok(m), before(m))),
        "mean_after": lambda m: F.avg(F.when(ok(m), after(m))),
        "mean_percent": gain,
        "mean_gain": lambda m: F.avg(F.when(ok(m), after(m) - before(m))),
    })


def change(m: str) -> Column:
    """Difference of the codes; null if either is."""
    return F.col(f"{m}_tuned") - F.col(m)


def sign_breakdown(df: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Improved, degraded and unchanged rows; shares are of all rows."""
    counts = {"improved": lambda m: F.count_if(change(m) > 0), "degraded": lambda m: F.count_if(change(m) < 0), "unchanged": lambda m: F.count_if(change(m) == 0), "n": lambda m: F.count("*")}
    rows = per_metric(df, metrics, counts)
    return rows.withColumns({f"{k}_percent": 100 * F.col(k) / F.col("n") for k in ("improved", "degraded", "unchanged")})


def describe_pairs(df: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Mean, exact median and sample deviation before and after, on the codes."""
    rows = per_metric(df, metrics, {
        "mean_before": lambda m: F.avg(m), "mean_after": lambda m: F.avg(f"{m}_tuned"),
        "median_before": lambda m: F.median(m), "median_after": lambda m: F.median(f"{m}_tuned"),
        "std_before": lambda m: F.stddev_samp(m), "std_after": lambda m: F.stddev_samp(f"{m}_tuned"),
    })
    part = lambda k: F.try_divide(F.col(f"{k}_after") - F.col(f"{k}_before"), F.col(f"{k}_before")) * 100
    return rows.withColumns({"mean_percent": part("mean"), "median_percent": part("median")})


BANDS = ((0, 3000), (3000, 5000), (5000, 7000), (7000, 10000))


def banded(df: DataFrame, metric: str, bands: tuple[tuple[int, int], ...] = BANDS) -> DataFrame:
    """Gains by band of the value before (open below, closed above); a band
    without rows has a count of 0."""
    inside = lambda lo, hi: (F.col(metric) > lo) & (F.col(metric) <= hi)
    in_band = lambda lo, hi, v, how: how(F.when(inside(lo, hi), v))
    part = F.try_divide(change(metric), F.col(metric)) * 100
    fields = {"mean_before": F.col(metric), "mean_after": F.col(f"{metric}_tuned"), "mean_change": change(metric), "mean_percent": part}
    aggs = [x for lo, hi in bands for x in (F.count_if(inside(lo, hi)).alias(f"n_{hi}"), *[in_band(lo, hi, v, F.avg).alias(f"{k}_{hi}") for k, v in fields.items()])]
    rows = F.array(*[F.struct(F.lit(f"({lo},{hi}]").alias("band"), F.col(f"n_{hi}").alias("n"), *[F.round(f"{k}_{hi}", 2).alias(k) for k in fields]) for lo, hi in bands])
    return df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*")


def corr_matrix(df: DataFrame, metrics: tuple[str, ...], suffix: str = "") -> DataFrame:
    """Pearson's correlation of each pair of metrics over rows that have both."""
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    value = lambda m: F.col(m + suffix).cast("double")
    wide = df.agg(*[F.corr(F.when(value(b).isNotNull(), value(a)), F.when(value(a).isNotNull(), value(b))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def top_changes(df: DataFrame, metrics: tuple[str, ...], n: int = 5, largest: bool = True) -> DataFrame:
    """The n largest gains (or losses) of each metric; ties by id."""
    long = df.select("id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), change(m).alias("change")) for m in metrics])).alias("x")).select("id", "x.*").filter("change is not null")
    order = F.col("change").desc() if largest else F.col("change").asc()
    ranked = long.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(order, "id")))
    return ranked.filter(F.col("rank") <= n)


def movers(summary: DataFrame, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """The n metrics that gained most, and all that declined."""
    up = summary.orderBy(F.col("mean_percent").desc(), "metric").limit(n)
    return up, summary.filter("mean_percent < 0")


def checkpoint_report(df: DataFrame, score: Column, tuned: Column, groups: tuple[str, ...] = ()) -> DataFrame:
    """Rows with both scores: means, gain, percent of means, shares that rose
    and fell."""
    both = score.isNotNull() & tuned.isNotNull()
    base = df.filter(both).withColumns({"_a": score, "_b": tuned}).groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg("_a").alias("mean_before"), F.avg("_b").alias("mean_after"), F.count_if(F.col("_b") > F.col("_a")).alias("up"), F.count_if(F.col("_b") < F.col("_a")).alias("down"))
    gain = F.col("mean_after") - F.col("mean_before")
    return base.select(*groups, "n", "mean_before", "mean_after", gain.alias("mean_gain"), (F.try_divide(gain, F.col("mean_before")) * 100).alias("percent"),
                       (100 * F.col("up") / F.col("n")).alias("improved_percent"), (100 * F.col("down") / F.col("n")).alias("regressed_percent"), (F.col("n") - F.col("up") - F.col("down")).alias("neutral"))


def verdicts(summary: DataFrame) -> DataFrame:
    """Word for the overall change: above 10 percent, above 0, or not."""
    return summary.withColumn("verdict", F.when(F.col("mean_percent") > 10, "strong").when(F.col("mean_percent") > 0, "slight").otherwise("none"))


def learning_curve(df: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Means by key with the gain on the next smaller key.

    The rows are aggregated first. Keys may still be many, so each meets its
    predecessor inside a block of keys; the last key of a block is handed to
    the next block by a join on block numbers.
    """
    means = df.groupBy(key).agg(*[F.avg(v).alias(k) for k, v in values.items()]).withColumn("_block", F.floor(F.col(key) / 1024))
    w = Window.partitionBy("_block").orderBy(key)
    edges = means.groupBy("_block").agg(F.max_by(F.struct(*values), key).alias("_last"))
    # a block's predecessor is the greatest block below it: neighbours in the table of blocks, by blocks of blocks
    far = edges.withColumn("_far", F.floor(F.col("_block") / 1024))
    tops = far.groupBy("_far").agg(F.max_by(F.struct("_block", "_last"), "_block").alias("_top"))
    over = Window.orderBy("_far")
    tops = tops.select("_far", F.lag("_top").over(over).alias("_before"))  # one row for a million keys
    own = Window.partitionBy("_far").orderBy("_block")
    handed = far.join(tops, "_far").select("_block", F.coalesce(F.lag("_last").over(own), F.col("_before._last")).alias("_last"))
    out = means.join(handed, "_block", "left")
    prior = lambda k: F.coalesce(F.lag(k).over(w), F.when(F.row_number().over(w) == 1, F.col(f"_last.{k}")))
    return out.withColumns({f"{k}_gain": F.col(k) - prior(k) for k in values}).drop("_block", "_last")


def plateau(curve: DataFrame, key: str, value: str, least: float) -> DataFrame:
    """``curve`` (keys with ``value`` and ``value_gain``) with ``share``, the part of
    the whole gain from the first key to the last that is reached by each key,
    and ``flat``: the gain is below ``least``. One row for each checkpoint."""
    ends = curve.agg(F.min_by(value, key).alias("_first"), (F.max_by(value, key) - F.min_by(value, key)).alias("_whole"))
    both = curve.join(F.broadcast(ends))  # a single row
    return both.withColumns({"share": F.try_divide(F.col(value) - F.col("_first"), F.col("_whole")), "flat": F.col(f"{value}_gain") < least}).drop("_first", "_whole")


def exact_quantiles(df: DataFrame, columns: tuple[str, ...], q: float = 0.5, few: int = 1 << 20, accuracy: int = 10_000) -> DataFrame:
    """``column, value``: exact interpolated quantiles of numeric columns.

    A quantile is bracketed by estimates a little below and above it; the rows
    inside are counted by value and the bracket is narrowed until it holds at
    most ``few`` distinct values, so neither all values nor all distinct ones
    meet in one task. Nulls and NaN aren't counted; a column without values has
    a null.
    """
    spark = df.sparkSession
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    totals = df.agg(*[F.count(known[c]).alias(c) for c in columns]).first()
    out: dict[str, float | None] = {c: None for c in columns if not totals[c]}
    # places (from 0) of the two values between which the quantile lies
    at = {c: q * (totals[c] - 1) for c in columns if totals[c]}
    inside = {c: known[c] for c in at}
    below, step = dict.fromkeys(at, 0), dict.fromkeys(at, 20.0 / accuracy)
    while at:
        size = df.agg(*[F.approx_count_distinct(inside[c]).alias(c) for c in at]).first()
        done = [c for c in at if size[c] <= few]
        if done:
            values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), inside[c].alias("v")) for c in done])).alias("x")).select("x.*").filter("v is not null")
            counts = values.groupBy("column", "v").agg(F.count("*").alias("n"))
            run = F.sum("n").over(Window.partitionBy("column").orderBy("v"))
            places = counts.withColumn("upto", run)
            wanted = reduce(lambda a, b: a | b, [(F.col("column") == c) & (F.col("upto") > int(at[c]) - below[c]) & (F.col("upto") - F.col("n") <= int(at[c]) + 1 - below[c]) for c in done])
            found = places.filter(wanted).collect()  # two values a column at most
            for c in done:
                own = sorted((r.v, r.upto + below[c]) for r in found if r["column"] == c)
                pick = lambda k, own=own: next((v for v, upto in own if upto > k), own[-1][0])
                low, high = pick(int(at[c])), pick(int(at[c]) + 1)
                out[c] = low + (high - low) * (at[c] - int(at[c]))
                del at[c]
        if at:
            counted = df.agg(*[F.count(inside[c]).alias(c) for c in at]).first()
            share = {c: (at[c] - below[c]) / counted[c] for c in at}
            marks = df.agg(*[F.percentile_approx(inside[c], [max(0.0, share[c] - step[c]), min(1.0, share[c] + step[c])], accuracy).alias(c) for c in at]).first()
            around = df.agg(*[x for c in at for x in (F.count_if(inside[c] < marks[c][0]).alias(f"{c}_low"), F.count_if(inside[c] <= marks[c][1]).alias(f"{c}_high"))]).first()
            for c in at:
                place = int(at[c]) - below[c]
                if around[f"{c}_low"] > place or around[f"{c}_high"] < min(place + 2, counted[c]):
                    step[c] *= 2  # the estimates left a neighbour out
                    continue
                low, high = marks[c]
                inside[c] = F.when((inside[c] >= low) & (inside[c] <= high), inside[c])
                below[c] += around[f"{c}_low"]
    return spark.createDataFrame([(c, None if out[c] is None else float(out[c])) for c in columns], "column string, value double")


def rule_flags(summary: DataFrame, signs: DataFrame, worse: tuple[str, ...] = ("toxicity", "hallucination_rate"), better: tuple[str, ...] = ("faithfulness",)) -> DataFrame:
    """``metric`` with the verdict of each rule on its improvement and signs.

    ``verdict``: mean change above 10 percent, above 0, or not; ``consistency``:
    more than 70 percent of rows improved or degraded, else mixed; ``warning``:
    a metric that should fall rose, or one that should rise fell, by more than
    10 percent of its mean; ``margin``: gain above 0.1, above 0.05, or less.
    """
    both = verdicts(summary).join(signs.select("metric", "improved_percent", "degraded_percent"), "metric")
    part = F.try_divide(F.col("mean_after") - F.col("mean_before"), F.col("mean_before")) * 100
    metric = F.col("metric")
    return both.withColumns({
        "consistency": F.when(F.col("improved_percent") > 70, "improved").when(F.col("degraded_percent") > 70, "degraded").otherwise("mixed"),
        "warning": F.coalesce(F.when(metric.isin(*worse), part > 10).when(metric.isin(*better), part < -10), F.lit(False)),
        "margin": F.when(F.col("mean_gain") > 0.1, "large").when(F.col("mean_gain") > 0.05, "moderate").otherwise("small"),
    })


def win_share(wins: Column, n: Column) -> Column:
    """Word for a share of wins: above 60 percent, above half, or not."""
    share = F.try_divide(100.0 * wins, n)
    return F.when(share > 60, "clear").when(share > 50, "narrow").otherwise("none")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def sign_test(wins: Column, losses: Column) -> tuple[Column, Column]:
    """z of the split of wins and losses, and its two-sided p (normal)."""
    n = wins + losses
    z = F.try_divide(F.abs(wins - losses).cast("double"), F.sqrt(n.cast("double")))
    # upper tail of the normal by a rational approximation (error below 1e-7)
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return z, F.least(F.lit(1.0), 2 * poly * F.exp(-z * z / 2) / F.sqrt(F.lit(2 * 3.141592653589793)))
