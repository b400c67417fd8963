"""Whole report rules, real files and every branch of the text primitives."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.functions import lexicons as lex
from corpusgauge.functions import text as tx
from corpusgauge.operators import improve, tables
from corpusgauge.plans import inputs
from corpusgauge.queries.analytics import CURVE, A, B, union
from corpusgauge.queries.records import ER, SC, sql_task
from corpusgauge.session import read_table, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
METRICS = inputs.METRICS


def query(sql: str, table: str | None = "scored"):
    """A query over a derived table, or over the session and folder."""

    def keep(f: Callable):
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(inputs.frame(spark, sf_dir, table))) if table else f
        ORACLES[f.__name__] = sql
        return f

    return keep


LINE_COLUMNS = ("l_extendedprice", "l_quantity", "l_discount")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(median({c}), 6) AS median, round(quantile_cont({c}, 0.9), 6) AS p90 FROM lineitem" for c in LINE_COLUMNS), None)
def d15_exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median and 90th percentile of real-valued columns by refinement."""
    lines = read_table(spark, sf_dir, "lineitem")
    median, p90 = (improve.exact_quantiles(lines, LINE_COLUMNS, q, few=500) for q in (0.5, 0.9))
    return median.join(p90.withColumnRenamed("value", "_p90"), "column").select("column", F.round("value", 6).alias("median"), F.round("_p90", 6).alias("p90"))


RULES = union(f"""SELECT '$m' AS metric, avg(CASE WHEN $m > 0 THEN ({A} - {B}) / ({B}) * 100 ELSE 0 END) AS p, avg({B}) AS b, avg({A}) AS a,
  100.0 * count(*) FILTER ($m_tuned > $m) / count(*) AS up, 100.0 * count(*) FILTER ($m_tuned < $m) / count(*) AS down FROM {SC}""")


@query(f"""SELECT metric, CASE WHEN p > 10 THEN 'strong' WHEN p > 0 THEN 'slight' ELSE 'none' END AS verdict, CASE WHEN up > 70 THEN 'improved' WHEN down > 70 THEN 'degraded' ELSE 'mixed' END AS consistency,
  coalesce(CASE WHEN metric IN ('toxicity', 'hallucination_rate') THEN (a - b) / nullif(b, 0) * 100 > 10 WHEN metric = 'faithfulness' THEN (a - b) / nullif(b, 0) * 100 < -10 END, false) AS warning,
  CASE WHEN a - b > 0.1 THEN 'large' WHEN a - b > 0.05 THEN 'moderate' ELSE 'small' END AS margin FROM ({RULES}) x""")
def d27_rule_flags(df):
    flags = improve.rule_flags(improve.improvement(df, METRICS, "zero_base"), improve.sign_breakdown(df, METRICS))
    return flags.select("metric", "verdict", "consistency", "warning", "margin")


Z = "(abs(wins - losses) / sqrt(wins + losses))"
TAIL = f"(1 / (1 + 0.2316419 * {Z}))"


@query(f"""SELECT metric, wins, losses, round({Z}, 5) AS z, round(least(1.0, 2 * {TAIL} * (0.319381530 + {TAIL} * (-0.356563782 + {TAIL} * (1.781477937 + {TAIL} * (-1.821255978 + {TAIL} * 1.330274429)))) * exp(-{Z} * {Z} / 2) / sqrt(2 * pi())), 6) AS p,
  CASE WHEN 100.0 * wins / n > 60 THEN 'clear' WHEN 100.0 * wins / n > 50 THEN 'narrow' ELSE 'none' END AS share FROM ({union(f"SELECT '$m' AS metric, count(*) AS n, count(*) FILTER ($m_tuned > $m) AS wins, count(*) FILTER ($m_tuned < $m) AS losses FROM {SC} WHERE checkpoint = 3")}) x""")
def d29_win_significance(df):
    """z, two-sided p and the word for the share of wins, by metric."""
    counts = improve.sign_breakdown(df.filter("checkpoint = 3"), METRICS).withColumnsRenamed({"improved": "wins", "degraded": "losses"})
    z, p = improve.sign_test(F.col("wins"), F.col("losses"))
    return counts.select("metric", "wins", "losses", F.round(z, 5).alias("z"), F.round(p, 6).alias("p"), improve.win_share(F.col("wins"), F.col("n")).alias("share"))


LATENCY = "CAST((id * 13) % 997 AS DOUBLE) / 10"


@query(f"SELECT 'checkpoint ' || k AS stage, count(overall_tuned) AS outputs, round(avg(overall_tuned), 4) AS mean_score, round(avg(CASE WHEN overall_tuned IS NOT NULL THEN {LATENCY} END), 4) AS mean_latency FROM range(1, 11) s(k) LEFT JOIN (SELECT * FROM {SC} WHERE checkpoint <> 4) t ON checkpoint = k GROUP BY k")
def d21_stage_report(df):
    """Ten stages, one of them without rows: outputs, score and latency."""
    done = F.col("overall_tuned").isNotNull()
    by = df.filter("checkpoint <> 4").groupBy("checkpoint").agg(F.count("overall_tuned").alias("outputs"), F.round(F.avg("overall_tuned"), 4).alias("mean_score"), F.round(F.avg(F.when(done, F.expr(LATENCY))), 4).alias("mean_latency"))
    stages = df.sparkSession.range(1, 11).select(F.col("id").cast("int").alias("checkpoint"))
    return stages.join(by, "checkpoint", "left").select(F.concat(F.lit("checkpoint "), F.col("checkpoint").cast("string")).alias("stage"), F.coalesce("outputs", F.lit(0)).alias("outputs"), "mean_score", "mean_latency")


TASK_ROWS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(lex.TASKS, 1))


@query(f"SELECT place, task, coalesce(n, 0) AS n, round(coalesce(100.0 * n / (SELECT count(*) FROM {ER} WHERE id % 3 = 0), 0), 4) AS percent FROM (VALUES {TASK_ROWS}) t(place, task) LEFT JOIN (SELECT {sql_task('input')} AS task, count(*) AS n FROM {ER} WHERE id % 3 = 0 GROUP BY 1) x USING (task)", "eval_records")
def d23_label_report(df):
    """All categories in their order, those without rows with a count of 0."""
    counts = df.filter("id % 3 = 0").groupBy(tx.classify_task(F.col("input")).alias("task")).agg(F.count("*").alias("n"))
    fixed = df.sparkSession.createDataFrame(list(enumerate(lex.TASKS, 1)), "place int, task string")
    total = counts.agg(F.sum("n").alias("_all"))
    both = fixed.join(counts, "task", "left").join(F.broadcast(total))  # a single row
    return both.select("place", "task", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce(100 * F.col("n") / F.col("_all"), F.lit(0.0)), 4).alias("percent"))


PARTS = "(CASE WHEN context IS NULL THEN 0 ELSE len([x FOR x IN string_split(context, '. ') IF x <> '']) END)"


@query(f"SELECT task_label AS label, " + ", ".join(f"min(length(coalesce({c}, ''))) AS {n}_min, max(length(coalesce({c}, ''))) AS {n}_max, round(avg(length(coalesce({c}, ''))), 4) AS {n}_mean" for c, n in (("input", "input"), ("teacher_output", "output"))) + f", round(avg({PARTS}), 4) AS context_items FROM {ER} GROUP BY task_label", "eval_records")
def d24_length_report(df):
    """Lengths of inputs and outputs and the number of context items, by label."""
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))).cast("long")
    items = F.coalesce(F.size(F.filter(F.split("context", r"\. "), lambda x: x != "")), F.lit(0))
    stats = [g for c, n in (("input", "input"), ("teacher_output", "output")) for g in (F.min(size(c)).alias(f"{n}_min"), F.max(size(c)).alias(f"{n}_max"), F.round(F.avg(size(c)), 4).alias(f"{n}_mean"))]
    return df.groupBy(F.col("task_label").alias("label")).agg(*stats, F.round(F.avg(items), 4).alias("context_items"))


@query(f"""SELECT checkpoint, round(o, 4) AS score, round((o - first_value(o) OVER w) / nullif(last_value(o) OVER w - first_value(o) OVER w, 0), 4) AS share, o - lag(o) OVER (ORDER BY checkpoint) < 10 AS flat
FROM ({CURVE}) c WINDOW w AS (ORDER BY checkpoint ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def e04_plateau_shares(df):
    """How much of the whole gain each checkpoint has reached, and where it is flat."""
    curve = improve.learning_curve(df, "checkpoint", {"o": F.col("overall_tuned")})
    return improve.plateau(curve, "checkpoint", "o", 10).select("checkpoint", F.round("o", 4).alias("score"), F.round("share", 4).alias("share"), "flat")


PREFIXES = ("student_output", "score", "latency")
WIDE = {"student_output": "CASE WHEN (id + $k) % 4 = 0 THEN NULL ELSE input || ' v$k' END", "score": "CASE WHEN (id + $k) % 4 = 0 THEN NULL ELSE (overall + $k * 7) / 10000.0 END", "latency": "CASE WHEN (id + $k) % 8 < 4 THEN NULL ELSE (id % 97 + $k) / 10.0 END"}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT id, {k} AS checkpoint, " + ", ".join(f"{e.replace('$k', str(k))} AS {p}" for p, e in WIDE.items()) + f" FROM {SC}) x WHERE coalesce(student_output, CAST(score AS VARCHAR), CAST(latency AS VARCHAR)) IS NOT NULL" for k in range(1, 11)))
def b16_checkpoints_to_long(df):
    """Ten times three columns of a legacy table as a row for each checkpoint."""
    wide = df.select("id", *[F.expr(e.replace("$k", str(k))).cast("string" if p == "student_output" else "double").alias(f"{p}_ckpt{k}") for p, e in WIDE.items() for k in range(1, 11)])
    return tables.checkpoints_to_long(wide, "id", PREFIXES, 10)


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN overall + 1 WHEN id % 2 = 0 THEN overall + 2 ELSE overall END AS overall FROM {SC}")
def a13_first_of_files(df):
    """Three CSV files by one pattern; ids are in up to three of them, and in the
    second file twice. The first file by name wins, then the first row."""
    folder = f"{shared_dir(df.sparkSession)}/csv-{uuid.uuid4().hex}"
    twice = df.filter("id % 2 = 0").select("id", F.explode(F.array(F.lit(2), F.lit(900))).alias("_k"), "overall").coalesce(1)
    for name, rows in (("c", df.select("id", "overall")), ("a", df.filter("id % 3 = 0").select("id", (F.col("overall") + 1).alias("overall"))), ("b", twice.select("id", (F.col("overall") + F.col("_k")).alias("overall")))):
        rows.write.option("header", "true").csv(f"{folder}/{name}")
    return tables.first_of_files(df.sparkSession, f"{folder}/*/part-*.csv", "id long, overall int", ["id"])


@query(f"SELECT id, 'created' AS status FROM {SC} WHERE checkpoint = 5 UNION ALL SELECT id, status FROM {SC} WHERE checkpoint = 2")
def a15_replaced_then_appended(df):
    """A table that is written, replaced in full, and appended to, as read back."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    old, new = df.filter("checkpoint = 1").select("id", "status"), df.filter("checkpoint = 2").select("id", "status")
    old.write.mode("overwrite").parquet(path)
    new.write.mode("overwrite").parquet(path)
    df.filter("checkpoint = 5").select("id", F.lit("created").alias("status")).write.mode("append").parquet(path)
    return df.sparkSession.read.schema(new.schema).parquet(path)


# ---- every branch of the primitives, true by construction ------------------------

SCRIPTS = ("привет мир как дела", "你好世界今天天气很好", "مرحبا بالعالم كيف", "plain words here", "12 34 !?", "你a", "приb", "слово слово ab")
SPOKEN = ("russian", "chinese", "arabic", "english", "unknown", "chinese", "russian", "russian")
LIMITS = ("Write 25 words about it", "Use max 12 words", "under 40   words please", "Give 3 sentences", "in 7 sentences", "less than 99 word", "no limit at all", "maximum 5 wordsmith and 8 sentences")
ASKED = (25, 12, 40, 3, 7, 99, None, 5)


def by_place(k: str, values: tuple, kind: str) -> str:
    """The value at a place of a short list, as SQL."""
    quote = lambda v: "NULL" if v is None else str(v) if kind == "INT" else "'" + v + "'"
    return "CAST(CASE " + k + " " + " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values)) + f" END AS {kind})"


@query(f"SELECT id, {by_place('id % 8', SPOKEN, 'VARCHAR')} AS language, {by_place('(id // 8) % 8', ASKED, 'INT')} AS n FROM {ER}", "eval_records")
def g14_g15_cases(df):
    """Languages by script, ties included, and limits by all four patterns."""
    cases = df.select("id", F.expr(by_place("id % 8", SCRIPTS, "STRING")).alias("said"), F.expr(by_place("(id div 8) % 8", LIMITS, "STRING")).alias("asked"))
    return cases.select("id", tx.script_language(F.col("said")).alias("language"), tx.length_limit(F.col("asked")).alias("n"))
