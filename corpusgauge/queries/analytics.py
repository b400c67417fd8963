"""Queries for summaries, improvement and learning curves over scored records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgauge.operators import improve
from corpusgauge.plans import inputs
from corpusgauge.plans.inputs import METRICS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STATUSES = ("score", "finetune", "output_tuned", "score_tuned", "completed")
SC = f"({inputs.text('scored')}) s"
LOWER_IS_BETTER = ("toxicity", "hallucination_rate")


def query(sql: str, table: str = "scored"):
    """Register a function of a derived table, with its SQL."""

    def keep(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(inputs.frame(spark, sf_dir, table))
        ORACLES[f.__name__] = sql
        return f

    return keep


def union(template: str, names: tuple[str, ...] = METRICS) -> str:
    """One SELECT for each metric."""
    return " UNION ALL ".join(template.replace("$m", m) for m in names)


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query(f"SELECT coalesce(status, 'null/empty') AS status, count(*) AS n FROM {SC} GROUP BY 1")
def d01_group_count(df):
    return df.groupBy(F.coalesce("status", F.lit("null/empty")).alias("status")).agg(F.count("*").alias("n"))


@query(f"SELECT checkpoint, count(*) FILTER (overall_tuned > overall) AS up, count(*) FILTER (overall_tuned < overall) AS down FROM {SC} GROUP BY checkpoint")
def d02_conditional_count(df):
    return df.groupBy("checkpoint").agg(F.count_if(F.col("overall_tuned") > F.col("overall")).alias("up"), F.count_if(F.col("overall_tuned") < F.col("overall")).alias("down"))


@query("SELECT checkpoint, count(*) AS total, count(*) FILTER (status IS NULL) AS n_null, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in STATUSES)
       + f", round(avg(overall / 10000.0), 4) AS base, round(avg(overall_tuned / 10000.0), 4) AS tuned, round(avg((coalesce(overall_tuned, 0) - overall) / 10000.0), 4) AS gain, round(avg((coalesce(overall_tuned, 0) - overall) / 10000.0) / nullif(avg(overall / 10000.0), 0) * 100, 2) AS percent FROM {SC} GROUP BY checkpoint")
def d03_checkpoint_summary(df):
    gain = (F.coalesce("overall_tuned", F.lit(0)) - F.col("overall")) / 10000.0
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    base = F.col("overall") / 10000.0
    return df.groupBy("checkpoint").agg(F.count("*").alias("total"), F.count_if(F.col("status").isNull()).alias("n_null"), *counts, F.round(F.avg(base), 4).alias("base"),
        F.round(F.avg(F.col("overall_tuned") / 10000.0), 4).alias("tuned"), F.round(F.avg(gain), 4).alias("gain"), F.round(F.try_divide(F.avg(gain), F.avg(base)) * 100, 2).alias("percent"))


@query("SELECT checkpoint, " + ", ".join(f"round(avg({m}{x} / 10000.0), 6) AS {m}{x}" for m in METRICS for x in ("", "_tuned")) + f" FROM {SC} WHERE status = 'completed' GROUP BY checkpoint")
def d04_metrics_comparison(df):
    return df.filter("status = 'completed'").groupBy("checkpoint").agg(*[F.round(F.avg(F.col(m + x) / 10000.0), 6).alias(m + x) for m in METRICS for x in ("", "_tuned")])


@query(f"SELECT label, count(*) AS n, count(*) FILTER (overall > overall_tuned) AS wins_a, count(*) FILTER (overall < overall_tuned) AS wins_b, count(*) FILTER (overall = overall_tuned) AS ties, round(avg(overall) / 10000, 4) AS a, round(avg(overall_tuned) / 10000, 4) AS b FROM {SC} WHERE status = 'completed' AND label IS NOT NULL GROUP BY label")
def d05_category_summary(df):
    a, b = F.col("overall"), F.col("overall_tuned")
    return df.filter("status = 'completed' and label is not null").groupBy("label").agg(F.count("*").alias("n"), F.count_if(a > b).alias("wins_a"), F.count_if(a < b).alias("wins_b"), F.count_if(a == b).alias("ties"), F.round(F.avg(a) / 10000, 4).alias("a"), F.round(F.avg(b) / 10000, 4).alias("b"))


@query("SELECT checkpoint, count(*) AS n, " + ", ".join(f"round(avg({m}), 4) AS {m}" for m in METRICS) + f" FROM {SC} GROUP BY checkpoint")
def d06_progress(df):
    return df.groupBy("checkpoint").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in METRICS])


D10 = union(f"SELECT '$m' AS metric, avg($m) / 10000 AS a, avg($m_tuned) / 10000 AS b FROM {SC}")


@query(f"SELECT metric, round(a, 6) AS a, round(b, 6) AS b, round(a - b, 6) AS difference, CASE WHEN a = b THEN 'tie' WHEN (a > b) = (metric NOT IN ('toxicity', 'hallucination_rate')) THEN 'a' ELSE 'b' END AS better FROM ({D10}) x")
def d10_metric_table(df):
    rows = improve.per_metric(df, METRICS, {"a": lambda m: F.avg(m) / 10000, "b": lambda m: F.avg(f"{m}_tuned") / 10000})
    higher = ~F.col("metric").isin(*LOWER_IS_BETTER)
    better = F.when(F.col("a") == F.col("b"), "tie").when((F.col("a") > F.col("b")) == higher, "a").otherwise("b")
    return rows.select("metric", r("a"), r("b"), F.round(F.col("a") - F.col("b"), 6).alias("difference"), better.alias("better"))


B, A = "coalesce($m, 0) / 10000.0", "coalesce($m_tuned, 0) / 10000.0"
SHOWN = ("n", "mean_before", "mean_after", "mean_percent", "mean_gain")


def sql_improvement(where: str, percent: str) -> str:
    return union(f"SELECT '$m' AS metric, count(*) AS n, round(avg({B}), 6) AS mean_before, round(avg({A}), 6) AS mean_after, round({percent}, 5) AS mean_percent, round(avg({A} - {B}), 6) AS mean_gain FROM {SC} WHERE {where}")


def shown(df: DataFrame) -> DataFrame:
    return df.select("metric", "n", r("mean_before"), r("mean_after"), r("mean_percent", 5), r("mean_gain"))


@query(sql_improvement("$m > 0", f"avg(({A} - {B}) / ({B}) * 100)"))
def d11_improvement_positive_base(df):
    return shown(improve.improvement(df, METRICS, "positive_base"))


@query(sql_improvement("true", f"avg(CASE WHEN $m > 0 THEN ({A} - {B}) / ({B}) * 100 ELSE 0 END)"))
def d12_improvement_zero_base(df):
    return shown(improve.improvement(df, METRICS, "zero_base"))


@query(sql_improvement("$m IS NOT NULL AND $m_tuned IS NOT NULL", f"CASE WHEN avg({B}) > 0 THEN (avg({A}) - avg({B})) / avg({B}) * 100 ELSE 0 END"))
def d13_improvement_of_means(df):
    return shown(improve.improvement(df, METRICS, "means"))


@query(f"SELECT checkpoint, count(*) AS n, round(avg(overall / 10000.0), 6) AS mean_before, round(avg(overall_tuned / 10000.0), 6) AS mean_after, round(avg((overall_tuned - overall) / 10000.0), 6) AS mean_gain, round((avg(overall_tuned) - avg(overall)) / avg(overall) * 100, 5) AS percent, round(100.0 * count(*) FILTER (overall_tuned > overall) / count(*), 5) AS improved_percent, round(100.0 * count(*) FILTER (overall_tuned < overall) / count(*), 5) AS regressed_percent, count(*) FILTER (overall_tuned = overall) AS neutral FROM {SC} WHERE status = 'completed' AND overall_tuned IS NOT NULL GROUP BY checkpoint")
def d14_checkpoint_report(df):
    out = improve.checkpoint_report(df.filter("status = 'completed'"), F.col("overall") / 10000.0, F.col("overall_tuned") / 10000.0, ("checkpoint",))
    return out.select("checkpoint", "n", r("mean_before"), r("mean_after"), r("mean_gain"), r("percent", 5), r("improved_percent", 5), r("regressed_percent", 5), "neutral")


@query(union(f"SELECT '$m' AS metric, round(avg($m), 4) AS mean_before, round(avg($m_tuned), 4) AS mean_after, CAST(median($m) AS DOUBLE) AS median_before, CAST(median($m_tuned) AS DOUBLE) AS median_after, round(stddev_samp($m), 4) AS std_before, round(stddev_samp($m_tuned), 4) AS std_after, round((avg($m_tuned) - avg($m)) / nullif(avg($m), 0) * 100, 4) AS mean_percent, round((median($m_tuned) - median($m)) / nullif(median($m), 0) * 100, 4) AS median_percent FROM {SC}"))
def d15_descriptive_statistics(df):
    names = ("mean_before", "mean_after", "std_before", "std_after", "mean_percent", "median_percent")
    return improve.describe_pairs(df, METRICS).select("metric", "median_before", "median_after", *[r(n, 4) for n in names])


@query(union(f"SELECT '$m' AS metric, count(*) FILTER ($m_tuned > $m) AS improved, count(*) FILTER ($m_tuned < $m) AS degraded, count(*) FILTER ($m_tuned = $m) AS unchanged, round(100.0 * count(*) FILTER ($m_tuned > $m) / count(*), 4) AS improved_percent, round(100.0 * count(*) FILTER ($m_tuned < $m) / count(*), 4) AS degraded_percent FROM {SC}"))
def d16_sign_breakdown(df):
    return improve.sign_breakdown(df, METRICS).select("metric", "improved", "degraded", "unchanged", r("improved_percent", 4), r("degraded_percent", 4))


@query(" UNION ALL ".join(f"SELECT '({lo},{hi}]' AS band, count(*) AS n, round(avg(overall), 2) AS mean_before, round(avg(overall_tuned), 2) AS mean_after, round(avg(overall_tuned - overall), 2) AS mean_change, round(avg((overall_tuned - overall) / CAST(overall AS DOUBLE) * 100), 2) AS mean_percent FROM {SC} WHERE overall > {lo} AND overall <= {hi}" for lo, hi in improve.BANDS))
def d17_banded(df):
    return improve.banded(df, "overall")


PAIRS = [(a, b) for i, a in enumerate(METRICS) for b in METRICS[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}_tuned, {b}_tuned), 5) AS corr FROM {SC}" for a, b in PAIRS))
def d18_correlation(df):
    return improve.corr_matrix(df, METRICS, "_tuned").select("a", "b", r("corr", 5))


@query(f"SELECT count(*) AS n FROM {SC}")
def d19_exact_count(df):
    return df.agg(F.count("*").alias("n"))


@query("SELECT count(*) AS total, count(*) FILTER (NOT has_context) AS no_context, count(*) FILTER (overall_tuned IS NULL) AS no_tuned, count(*) FILTER (status IS NULL AND overall > 0) AS ready, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in STATUSES) + ", " + ", ".join(f"count(*) FILTER (checkpoint = {k}) AS c{k}" for k in range(1, 11)) + f" FROM {SC}")
def d20_dashboard(df):
    c = F.col
    return df.agg(F.count("*").alias("total"), F.count_if(~c("has_context")).alias("no_context"), F.count_if(c("overall_tuned").isNull()).alias("no_tuned"), F.count_if(c("status").isNull() & (c("overall") > 0)).alias("ready"),
        *[F.count_if(c("status") == s).alias(f"n_{s}") for s in STATUSES], *[F.count_if(c("checkpoint") == k).alias(f"c{k}") for k in range(1, 11)])


@query(" UNION ALL ".join(f"SELECT 'checkpoint {k}' AS stage, count(overall_tuned) AS outputs, round(avg(overall_tuned), 4) AS mean_score FROM {SC} WHERE checkpoint = {k}" for k in range(1, 11)))
def d21_stage_summary(df):
    return df.groupBy(F.concat(F.lit("checkpoint "), F.col("checkpoint").cast("string")).alias("stage")).agg(F.count("overall_tuned").alias("outputs"), F.round(F.avg("overall_tuned"), 4).alias("mean_score"))


@query(f"SELECT 'base' AS stage, count(*) AS outputs, CAST(NULL AS DOUBLE) AS mean_score FROM {SC} UNION ALL SELECT 'stage ' || checkpoint, count(overall_tuned), round(avg(overall_tuned), 4) FROM {SC} GROUP BY checkpoint UNION ALL SELECT 'batch', count(overall_tuned), round(avg(overall_tuned), 4) FROM {SC}")
def d22_incremental_vs_batch(df):
    sets = df.select(F.explode(F.array(F.lit("base"), F.concat(F.lit("stage "), F.col("checkpoint").cast("string")), F.lit("batch"))).alias("stage"), "overall_tuned", "id")
    base = F.col("stage") == "base"
    return sets.groupBy("stage").agg(F.sum(F.when(base | F.col("overall_tuned").isNotNull(), 1).otherwise(0)).alias("outputs"), F.round(F.avg(F.when(~base, F.col("overall_tuned"))), 4).alias("mean_score"))


@query(f"SELECT count(DISTINCT input) AS inputs, count(DISTINCT label) AS labels FROM {SC}")
def d25_distinct_count(df):
    return df.agg(F.count_distinct("input").alias("inputs"), F.count_distinct("label").alias("labels"))


@query("SELECT metric, CASE WHEN p > 10 THEN 'strong' WHEN p > 0 THEN 'slight' ELSE 'none' END AS verdict FROM (" + union(f"SELECT '$m' AS metric, avg(CASE WHEN $m > 0 THEN ({A} - {B}) / ({B}) * 100 ELSE 0 END) AS p FROM {SC}") + ") x")
def d27_verdicts(df):
    return improve.verdicts(improve.improvement(df, METRICS, "zero_base")).select("metric", "verdict")


@query(f"SELECT round((avg(hallucination_rate) - avg(hallucination_rate_tuned)) / nullif(avg(hallucination_rate), 0) * 100, 5) AS reduction FROM {SC}")
def d28_hallucination_reduction(df):
    a, b = F.avg("hallucination_rate"), F.avg("hallucination_rate_tuned")
    return df.agg(F.round(F.try_divide(a - b, a) * 100, 5).alias("reduction"))


@query(f"SELECT wins, losses, round(abs(wins - losses) / sqrt(wins + losses), 5) AS z FROM (SELECT count(*) FILTER (overall > overall_tuned) AS wins, count(*) FILTER (overall < overall_tuned) AS losses FROM {SC}) x")
def d29_sign_test(df):
    counts = df.agg(F.count_if(F.col("overall") > F.col("overall_tuned")).alias("wins"), F.count_if(F.col("overall") < F.col("overall_tuned")).alias("losses"))
    return counts.select("wins", "losses", F.round(improve.sign_test(F.col("wins"), F.col("losses"))[0], 5).alias("z"))


@query(union(f"SELECT checkpoint, '$m' AS metric, round(avg($m), 4) AS mean FROM {SC} WHERE status IS NOT NULL GROUP BY checkpoint"))
def d30_stage_averages(df):
    return improve.per_metric(df.filter("status is not null"), METRICS, {"mean": lambda m: F.round(F.avg(m), 4)}, ("checkpoint",))


@query(f"SELECT CASE WHEN overall > overall_tuned THEN 'a' WHEN overall < overall_tuned THEN 'b' ELSE 'tie' END AS winner, count(*) AS n FROM {SC} WHERE status = 'completed' GROUP BY 1")
def d31_winner_count(df):
    a, b = F.col("overall"), F.col("overall_tuned")
    return df.filter("status = 'completed'").groupBy(F.when(a > b, "a").when(a < b, "b").otherwise("tie").alias("winner")).agg(F.count("*").alias("n"))


@query(f"SELECT checkpoint, count(*) AS n, round(avg(faithfulness / 10000.0), 6) AS faithfulness, round(avg(hallucination_rate / 10000.0), 6) AS hallucination_rate, round(avg(overall / 10000.0), 6) AS overall FROM {SC} WHERE checkpoint IS NOT NULL GROUP BY checkpoint")
def d32_stage_statistics(df):
    names = ("faithfulness", "hallucination_rate", "overall")
    return df.filter("checkpoint is not null").groupBy("checkpoint").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(m) / 10000.0), 6).alias(m) for m in names])


@query(f"SELECT checkpoint, count(*) FILTER (overall_tuned IS NULL) AS pending, count(*) AS n FROM {SC} GROUP BY checkpoint")
def d33_pending_by_checkpoint(df):
    return df.groupBy("checkpoint").agg(F.count_if(F.col("overall_tuned").isNull()).alias("pending"), F.count("*").alias("n"))


@query(f"SELECT count(*) FILTER (has_context) AS with_context, count(*) FILTER (NOT has_context) AS without_context, count(status) AS n_status, count(overall_tuned) AS n_overall_tuned FROM {SC}")
def d34_column_coverage(df):
    return df.agg(F.count_if("has_context").alias("with_context"), F.count_if(~F.col("has_context")).alias("without_context"), F.count("status").alias("n_status"), F.count("overall_tuned").alias("n_overall_tuned"))


@query(f"SELECT count(*) FILTER (status IS NULL) AS status_null, count(*) FILTER (status = 'completed') AS status_done, count(*) FILTER (overall_tuned IS NULL) AS final_null, count(overall_tuned) AS final_done FROM {SC}")
def d35_live_status_counts(df):
    return df.agg(F.count_if(F.col("status").isNull()).alias("status_null"), F.count_if(F.col("status") == "completed").alias("status_done"), F.count_if(F.col("overall_tuned").isNull()).alias("final_null"), F.count("overall_tuned").alias("final_done"))


CURVE = f"SELECT checkpoint, avg(faithfulness) AS f, avg(hallucination_rate) AS h, avg(overall_tuned) AS o FROM {SC} GROUP BY checkpoint"


@query(f"SELECT checkpoint, round(f - lag(f) OVER (ORDER BY checkpoint), 4) AS faithfulness_gain, round(lag(h) OVER (ORDER BY checkpoint) - h, 4) AS hallucination_gain, round(o - lag(o) OVER (ORDER BY checkpoint), 4) AS overall_gain FROM ({CURVE}) c")
def e01_learning_curve(df):
    curve = improve.learning_curve(df, "checkpoint", {"f": F.col("faithfulness"), "h": F.col("hallucination_rate"), "o": F.col("overall_tuned")})
    return curve.select("checkpoint", F.round("f_gain", 4).alias("faithfulness_gain"), F.round(-F.col("h_gain"), 4).alias("hallucination_gain"), F.round("o_gain", 4).alias("overall_gain"))


@query(f"SELECT min(checkpoint) AS plateau FROM (SELECT checkpoint, o - lag(o) OVER (ORDER BY checkpoint) AS g FROM ({CURVE}) c) x WHERE g < 10")
def e04_plateau(df):
    """First checkpoint whose gain in the overall score is under 0.001."""
    curve = improve.learning_curve(df, "checkpoint", {"o": F.col("overall_tuned")})
    return curve.filter("o_gain < 10").agg(F.min("checkpoint").alias("plateau"))


def sql_top(order: str) -> str:
    return "SELECT metric, id, change, rank FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY change " + order + ", id) AS rank FROM (" + union(f"SELECT id, '$m' AS metric, $m_tuned - $m AS change FROM {SC} WHERE $m_tuned IS NOT NULL") + ") x) y WHERE rank <= 5"


@query(sql_top("DESC"))
def f02_top_improvements(df):
    return improve.top_changes(df, METRICS, 5)


@query(sql_top("ASC"))
def f02_top_degradations(df):
    return improve.top_changes(df, METRICS, 5, largest=False)


@query(f"SELECT id, overall - overall_tuned AS difference FROM {SC} WHERE overall_tuned IS NOT NULL ORDER BY difference DESC, id LIMIT 10")
def f03_biggest_wins(df):
    return df.filter("overall_tuned is not null").select("id", (F.col("overall") - F.col("overall_tuned")).alias("difference")).orderBy(F.desc("difference"), "id").limit(10)


MOVES = union(f"SELECT '$m' AS metric, avg(CASE WHEN $m > 0 THEN ({A} - {B}) / ({B}) * 100 ELSE 0 END) AS p FROM {SC}")


@query(f"SELECT metric, round(p, 5) AS mean_percent FROM ({MOVES}) x ORDER BY p DESC, metric LIMIT 3")
def f04_top_movers(df):
    return improve.movers(improve.improvement(df, METRICS, "zero_base"))[0].select("metric", r("mean_percent", 5))


@query(f"SELECT metric, round(p, 5) AS mean_percent FROM ({MOVES}) x WHERE p < 0")
def f04_declined(df):
    return improve.movers(improve.improvement(df, METRICS, "zero_base"))[1].select("metric", r("mean_percent", 5))


@query(f"SELECT id, label, overall FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM {SC}) x WHERE k <= 2")
def f08a_first_per_group(df):
    w = Window.partitionBy("label").orderBy("id")
    return df.withColumn("k", F.row_number().over(w)).filter("k <= 2").select("id", "label", "overall")


@query(f"SELECT id, substr(input, 1, 9) AS input FROM {SC} WHERE has_context ORDER BY created_at DESC, id LIMIT 10")
def f08b_recent_with_context(df):
    return df.filter("has_context").orderBy(F.desc("created_at"), "id").limit(10).select("id", F.substring("input", 1, 9).alias("input"))


@query(f"SELECT min(checkpoint) AS checkpoint FROM {SC} WHERE overall_tuned IS NULL")
def f08_pending_checkpoint(df):
    return df.filter("overall_tuned is null").agg(F.min("checkpoint").alias("checkpoint"))


@query(f"SELECT id, created_at::DATE AS day FROM {SC} ORDER BY created_at, id LIMIT 20 OFFSET 40")
def f01_sorted_page(df):
    return df.orderBy("created_at", "id").offset(40).limit(20).select("id", F.to_date("created_at").alias("day"))


@query("SELECT status AS stage FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, '{s}' AS status, count(*) AS n FROM {SC} WHERE status = '{s}'" for k, s in enumerate(STATUSES)) + ") x WHERE n > 0 ORDER BY k LIMIT 1")
def f07_next_stage(df):
    place = F.coalesce(*[F.when(F.col("status") == s, F.lit(k)) for k, s in enumerate(STATUSES)])
    return df.filter(place.isNotNull()).agg(F.min_by("status", place).alias("stage"))


@query(f"SELECT id, round((coalesce(overall_tuned, 0) - overall) / 10000.0, 4) AS improvement FROM {SC}")
def h26_improvement_column(df):
    return df.select("id", F.bround(F.coalesce(F.col("overall_tuned"), F.lit(0)) / 10000.0 - F.col("overall") / 10000.0, 4).alias("improvement"))


@query(f"SELECT id, CAST(round_even(coalesce(overall_tuned, 0) / 10000.0 * 10000, 0) AS INT) AS zero_code, overall_tuned AS null_code FROM {SC}")
def b08_encode(df):
    score = F.col("overall_tuned") / 10000.0
    return df.select("id", improve.encode(score).alias("zero_code"), improve.encode(score, "null").alias("null_code"))


@query(f"SELECT id, round(coalesce(overall_tuned, 0) / 10000.0, 4) AS overall_tuned FROM {SC}")
def b09_decode(df):
    return df.select("id", improve.decode(F.col("overall_tuned")).alias("overall_tuned"))


@query("SELECT id, " + ", ".join(f"{m}{x} / 10000.0 AS {m}{x}" for m in METRICS for x in ("", "_tuned")) + f", (overall - overall_tuned) / 10000.0 AS overall_difference FROM {SC} WHERE status = 'completed'")
def b10_decimal_view(df):
    return df.filter("status = 'completed'").select("id", *[(F.col(m + x) / 10000.0).alias(m + x) for m in METRICS for x in ("", "_tuned")], ((F.col("overall") - F.col("overall_tuned")) / 10000.0).alias("overall_difference"))
