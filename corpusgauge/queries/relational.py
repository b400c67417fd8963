"""Queries for keyed updates, deduplication, selection and stage changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.functions import text as tx
from corpusgauge.operators import scoring, tables
from corpusgauge.plans import inputs
from corpusgauge.queries.scores import EVAL, sql_v2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SC, ER, EV = (f"({inputs.text(t)}) {a}" for t, a in (("scored", "s"), ("eval_records", "r"), ("status_events", "e")))


def query(sql: str, table: str = "scored"):
    def keep(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(inputs.frame(spark, sf_dir, table))
        ORACLES[f.__name__] = sql
        return f

    return keep


@query(f"SELECT id, label, overall FROM {SC} WHERE status = 'completed' AND checkpoint <> 3 AND overall >= 5000")
def b02_comparison_filter(df):
    return df.filter("status = 'completed' and checkpoint <> 3 and overall >= 5000").select("id", "label", "overall")


@query(f"SELECT id, label FROM {SC}")
def b01_column_pruning(df):
    return df.select("id", "label")


@query(f"SELECT id FROM {ER} WHERE coalesce(context, '') = '' AND student_output IS NOT NULL", "eval_records")
def b03_null_or_empty(df):
    return df.filter(tx.is_missing(F.col("context")) & F.col("student_output").isNotNull()).select("id")


@query(f"SELECT id, checkpoint FROM {SC} WHERE checkpoint IN (2, 3, 5, 7)")
def b04_in_list(df):
    return df.filter(F.col("checkpoint").isin(2, 3, 5, 7)).select("id", "checkpoint")


@query(f"SELECT count(*) FILTER (coalesce(status, '') = '' AND coalesce(teacher_output, '') <> '' AND coalesce(student_output, '') <> '') AS ready, count(*) FILTER (coalesce(status, '') = '' AND coalesce(teacher_output, '') = '') AS no_teacher, count(*) FILTER (coalesce(status, '') = '' AND coalesce(teacher_output, '') <> '' AND coalesce(student_output, '') = '') AS no_student FROM {ER}", "eval_records")
def b11_readiness(df):
    new, teacher, student = tx.is_missing(F.col("status")), ~tx.is_missing(F.col("teacher_output")), ~tx.is_missing(F.col("student_output"))
    return df.agg(F.count_if(new & teacher & student).alias("ready"), F.count_if(new & ~teacher).alias("no_teacher"), F.count_if(new & teacher & ~student).alias("no_student"))


@query(f"SELECT id FROM {ER} WHERE coalesce(student_output, '') = '' AND task_label IS NOT NULL", "eval_records")
def b12_pending(df):
    return df.filter(tx.is_missing(F.col("student_output")) & F.col("task_label").isNotNull()).select("id")


@query(f"SELECT id, CASE WHEN status = 'finetune' THEN 'output_tuned' ELSE status END AS status FROM {SC}")
def b13_advance_stage(df):
    return df.select("id", F.when(F.col("status") == "finetune", "output_tuned").otherwise(F.col("status")).alias("status"))


@query(f"SELECT id, overall, CAST(NULL AS DOUBLE) AS improvement, 'general_qa' AS task_label FROM {SC}")
def b15_column_changes(df):
    gone = [c for c in df.columns if c not in ("id", "overall")]
    return df.drop(*gone).withColumns({"improvement": F.lit(None).cast("double"), "task_label": F.lit("general_qa")})


@query(" UNION ALL ".join(f"SELECT id, '{m}' AS metric, {m} AS before, {m}_tuned AS after FROM {SC}" for m in inputs.METRICS))
def b16_wide_to_long(df):
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("before"), F.col(f"{m}_tuned").alias("after")) for m in inputs.METRICS])
    return df.select("id", F.explode(rows).alias("x")).select("id", "x.*")


@query(f"SELECT id, CASE WHEN id % 5 = 0 THEN 1 ELSE overall END AS overall, CASE WHEN id % 5 = 0 THEN NULL ELSE status END AS status FROM {SC}")
def c01_keyed_update(df):
    """Sets two columns, one to null, on every fifth record."""
    updates = df.filter("id % 5 = 0").select("id", F.lit(1).alias("overall"), F.lit(None).cast("string").alias("status"))
    return tables.merge_update(df.select("id", "overall", "status"), updates, ["id"])


COUNTS = f"SELECT checkpoint, status, count(*) AS n FROM {SC} GROUP BY ALL"


@query(f"SELECT checkpoint, status, CASE WHEN checkpoint > 5 THEN n * 10 ELSE n END AS n FROM ({COUNTS}) c WHERE checkpoint > 2")
def c02_composite_upsert(df):
    counts = df.groupBy("checkpoint", "status").agg(F.count("*").alias("n"))
    base = counts.filter("checkpoint between 3 and 8")
    new = counts.filter("checkpoint > 5").withColumn("n", F.col("n") * 10)
    return tables.upsert(base, new, ["checkpoint", "status"])


@query(f"SELECT id FROM {SC} WHERE input NOT IN (SELECT input FROM {SC} WHERE checkpoint = 1)")
def c03_anti_join_text(df):
    return tables.anti_on(df, df.filter("checkpoint = 1"), ["input"]).select("id")


@query(f"SELECT id, overall FROM {SC} WHERE input IN (SELECT input FROM {SC} WHERE status = 'completed')")
def c04_semi_join(df):
    return tables.semi_on(df, df.filter("status = 'completed'"), ["input"]).select("id", "overall")


@query(f"WITH d AS ({COUNTS}) SELECT checkpoint, status, stream, direct, coalesce(stream, 0) - coalesce(direct, 0) AS delta, CASE WHEN stream IS NULL THEN 'MISSING_FROM_STREAM' WHEN stream = coalesce(direct, 0) THEN 'OK' ELSE 'MISMATCH' END AS verdict FROM (SELECT checkpoint, status, CASE WHEN checkpoint = 1 THEN NULL WHEN checkpoint = 2 THEN n + 5 ELSE n END AS stream, CASE WHEN checkpoint <> 9 THEN n END AS direct FROM d) x")
def c05_reconciliation(df):
    counts = df.groupBy("checkpoint", "status").agg(F.count("*").alias("n"))
    stream = counts.filter("checkpoint <> 1").withColumn("n", F.when(F.col("checkpoint") == 2, F.col("n") + 5).otherwise(F.col("n")))
    return tables.reconcile(stream, counts.filter("checkpoint <> 9"), ["checkpoint", "status"])


@query(f"SELECT id, overall AS before, overall_tuned AS after FROM {SC} WHERE overall_tuned IS NOT NULL")
def c07_before_after_pairs(df):
    tuned = df.filter("overall_tuned is not null").select("id", F.col("overall_tuned").alias("after"))
    return df.select("id", F.col("overall").alias("before")).join(tuned, "id")


@query(f"SELECT id, length(student_output) AS chars FROM {ER}", "eval_records")
def c06_pair_by_id(df):
    """Results joined to their inputs by id, not by position."""
    out = df.select("id", F.length("student_output").cast("long").alias("chars"))
    return df.select("id").join(out, "id", "left")


@query(f"SELECT input, max(created_at)::DATE AS day, arg_max(id, (created_at, id)) AS id FROM {SC} GROUP BY input")
def e02_keep_latest(df):
    kept, _ = tables.keep_latest(df.select("id", "input", "created_at"), ["input"], ["created_at", "id"], "id")
    return kept.select("input", F.to_date("created_at").alias("day"), "id")


@query(f"SELECT id FROM {SC} WHERE id NOT IN (SELECT arg_max(id, (created_at, id)) FROM {SC} GROUP BY input)")
def i09_duplicate_report(df):
    return tables.keep_latest(df.select("id", "input", "created_at"), ["input"], ["created_at", "id"], "id")[1]


@query(f"SELECT input, min(id) AS id FROM {SC} GROUP BY input")
def e03_keep_first(df):
    return tables.earliest(df.select("input", "id"), ["input"], ["id"])


@query(f"SELECT id, label FROM {SC} WHERE id > 3000")
def a10_read_since(df):
    return df.filter(F.col("id") > 3000).select("id", "label")


@query(f"SELECT count(*) AS n, sum(overall) AS total FROM {SC}")
def a09_full_scan(df):
    return df.agg(F.count("*").alias("n"), F.sum("overall").alias("total"))


@query(f"SELECT (id - 1) // 5000 + 1 AS checkpoint, id, substr(input, 1, 5000) AS input, coalesce(substr(context, 1, 2000), '') AS context, substr(teacher_output, 1, 5000) AS teacher FROM {ER}", "eval_records")
def a14_bulk_map(df):
    """Column-mapped load; the lengths are the target's column widths."""
    return df.select(F.floor((F.col("id") - 1) / 5000).cast("long").alias("c"), "id", F.substring("input", 1, 5000).alias("input"), F.coalesce(F.substring("context", 1, 2000), F.lit("")).alias("context"), F.substring("teacher_output", 1, 5000).alias("teacher")).withColumn("checkpoint", F.when(F.col("id") == 0, 1).otherwise(F.col("c") + 1)).drop("c")


@query(f"SELECT id FROM {SC} WHERE id NOT IN (SELECT id FROM {SC} WHERE status = 'completed')")
def a18_skip_processed(df):
    return tables.anti_on(df.select("id"), df.filter("status = 'completed'"), ["id"])


@query(f"SELECT id, overall FROM {SC} WHERE checkpoint = 4 UNION ALL SELECT id + 1000000, 0 FROM {SC} WHERE checkpoint = 5")
def a16_append(df):
    new = df.filter("checkpoint = 5").select((F.col("id") + 1000000).alias("id"), F.lit(0).alias("overall"))
    return df.filter("checkpoint = 4").select("id", "overall").unionByName(new)


@query(f"SELECT id, student_output FROM {ER} WHERE checkpoint = 2", "eval_records")
def a15_full_refresh(df):
    """The table after a full replacement holds the new rows only."""
    return df.filter("checkpoint = 2").select("id", "student_output")


FENCED = "'Sure:' || chr(10) || '```json' || chr(10) || '{\"input\": \"' || id || '\"' || CASE WHEN id % 3 = 0 THEN '' ELSE ', \"context\": \"c\", \"expected_output\": \"' || task_label || '\"' END || '}' || chr(10) || '```'"


@query(f"SELECT id, CAST(id AS VARCHAR) AS input, task_label AS expected_output FROM {ER} WHERE id % 3 <> 0", "eval_records")
def a17_fenced_json(df):
    """The object in a fence, where all its fields are there."""
    body = F.concat(F.lit("Sure:\n```json\n{\"input\": \""), F.col("id").cast("string"), F.lit("\""), F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit(", \"context\": \"c\", \"expected_output\": \""), "task_label", F.lit("\""))), F.lit("}\n```"))
    inner = F.coalesce(F.nullif(F.regexp_extract(body, r"```json\s*([\s\S]*?)\s*```", 1), F.lit("")), F.regexp_extract(body, r"```\s*([\s\S]*?)\s*```", 1))
    parsed = df.select("id", F.from_json(inner, "input string, context string, expected_output string").alias("x")).select("id", "x.*")
    return tables.split_valid(parsed, F.col("input").isNotNull() & F.col("context").isNotNull() & F.col("expected_output").isNotNull(), F.lit("fields"))[0].select("id", "input", "expected_output")


STAGE_SQL = sql_v2(*EVAL) + " SELECT id, CASE WHEN coalesce(tea, '') <> '' AND coalesce(stu, '') <> '' THEN round(overall_score, 4) END AS score, 'finetune' AS status FROM v2 WHERE status = 'score'"


@query(STAGE_SQL, "eval_records")
def h25_scoring_stage(df):
    """Rows at ``score`` get one (null without both texts) and move on."""
    scored = scoring.score_v2(df.filter("status = 'score'"))
    whole = ~tx.is_missing(F.col("teacher_output")) & ~tx.is_missing(F.col("student_output"))
    return scored.select("id", F.when(whole, F.round("overall_score", 4)).alias("score"), F.lit("finetune").alias("status"))


@query(f"SELECT checkpoint, count(*) FILTER (status = 'score') AS n, count(*) FILTER (status = 'score') >= 100 AS ready FROM {SC} GROUP BY checkpoint")
def i06_minimum_rows(df):
    n = F.count_if(F.col("status") == "score")
    return df.groupBy("checkpoint").agg(n.alias("n"), (n >= 100).alias("ready"))


@query(f"SELECT count(*) FILTER (status = 'completed' AND overall_tuned IS NULL) >= 2 AS eligible FROM {SC}")
def i07_eligible(df):
    return df.agg((F.count_if((F.col("status") == "completed") & F.col("overall_tuned").isNull()) >= 2).alias("eligible"))
