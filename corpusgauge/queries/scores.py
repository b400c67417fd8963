"""Queries for the two score profiles and the text primitives below them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.functions import lexicons as lex
from corpusgauge.functions import text as tx
from corpusgauge.functions.json_check import holds_json
from corpusgauge.operators import scoring, vectors
from corpusgauge.plans import inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def rounded(*names: str) -> list:
    return [F.round(n, DIGITS).alias(n) for n in names]


# ---- SQL side -------------------------------------------------------------

def sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9'']+')"


def sql_content(x: str, profile: int) -> str:
    return f"[w FOR w IN {sql_tokens(x)} IF NOT list_contains({sql_list(tx.stop_words(profile))}, w) AND NOT regexp_full_match(w, '[0-9]+')]"


def sql_counts(table: str, q: str, t: str, c: str, s: str, profile: int) -> str:
    """CTEs rec, tk, tf, ag: token counts of four texts by row and token."""
    parts = " UNION ALL ".join(f"SELECT id, '{r}' AS r, unnest({sql_content(x, profile)}) AS w FROM rec" for r, x in zip("qtcs", (q, t, c, s), strict=True))
    return f"""WITH rec AS ({inputs.text(table)}), tk AS ({parts}),
tf AS (SELECT id, w, count(*) FILTER (r = 'q') AS q, count(*) FILTER (r = 't') AS t, count(*) FILTER (r = 'c') AS c, count(*) FILTER (r = 's') AS s FROM tk GROUP BY id, w),
sm AS (SELECT id, CAST(sum(q * q) AS DOUBLE) AS qq, CAST(sum(t * t) AS DOUBLE) AS tt, CAST(sum(c * c) AS DOUBLE) AS cc, CAST(sum(s * s) AS DOUBLE) AS ss,
  CAST(sum(q * s) AS DOUBLE) AS qs, CAST(sum(t * s) AS DOUBLE) AS ts, CAST(sum(c * s) AS DOUBLE) AS cs,
  CAST(count(*) FILTER (s > 0) AS DOUBLE) AS ns, CAST(count(*) FILTER (c > 0) AS DOUBLE) AS nc, CAST(count(*) FILTER (c > 0 AND s > 0) AS DOUBLE) AS ncs FROM tf GROUP BY id),
ag AS (SELECT rec.*, least(1.0, coalesce(qs / nullif(sqrt(qq * ss), 0), 0.0)) AS cq, least(1.0, coalesce(ts / nullif(sqrt(tt * ss), 0), 0.0)) AS ct,
  least(1.0, coalesce(cs / nullif(sqrt(cc * ss), 0), 0.0)) AS ccs, coalesce(ns, 0) AS ns, coalesce(nc, 0) AS nc, coalesce(ncs, 0) AS ncs FROM rec LEFT JOIN sm ON sm.id = rec.id)"""


def sql_v1(table: str, q: str, t: str, c: str, s: str) -> str:
    """CTE chain that ends in v1: the scores of profile 1."""
    words = sql_list(tuple(w for w in lex.TOXIC_TERMS if " " not in w))
    blend = lambda a, b: f"CASE WHEN coalesce({t}, '') <> '' AND coalesce({c}, '') <> '' THEN greatest(0.0, least(1.0, 0.6 * {a} + 0.4 * {b})) WHEN coalesce({t}, '') <> '' THEN {a} WHEN coalesce({c}, '') <> '' THEN {b} ELSE 0.0 END"
    own = f"list_distinct({sql_tokens(s)})"
    listed = lambda x: f"list_sort([w FOR w IN {own} IF list_contains({sql_list(tuple(dict.fromkeys(x)))}, w)])"
    return sql_counts(table, q, t, c, s, 1) + f""",
fl AS (SELECT *, list_sort([w FOR w IN {own} IF list_contains({words}, w)] || CASE WHEN contains(trim(regexp_replace(lower(coalesce({s}, '')), '\\s+', ' ', 'g')), 'shut up') THEN ['shut up'] ELSE [] END) AS toxicity_flags,
  greatest(len({own}), 1) AS nt, {listed(lex.SENSITIVE_TERMS)} AS sensitive_mentions, {listed(lex.NEGATIVE_TERMS)} AS negative_cues,
  CASE WHEN ns > 0 THEN ncs / ns ELSE 0.0 END AS prec, CASE WHEN nc > 0 THEN ncs / nc ELSE 0.0 END AS rec_, {blend("ct", "ccs")} AS faith FROM ag),
v1a AS (SELECT *, cq AS answer_relevancy, ccs AS contextual_relevancy, prec AS contextual_precision, rec_ AS contextual_recall, faith AS faithfulness,
  least(1.0, CAST(len(toxicity_flags) AS DOUBLE) / nt) AS toxicity, 1.0 - prec AS hallucination_rate,
  CASE WHEN len(sensitive_mentions) > 0 AND len(negative_cues) > 0 THEN 'harmful' WHEN len(sensitive_mentions) > 0 THEN 'mentions_only' ELSE 'clean' END AS bias_flag FROM fl),
v1 AS (SELECT *, greatest(0.0, least(1.0, (cq + ccs + prec + rec_ + faith) / 5 * (1 - (toxicity + hallucination_rate) / 2))) AS overall FROM v1a)"""


EVAL = ("eval_records", "input", "teacher_output", "context", "student_output")
PAIRS = ("doc_pairs", "input", "expected_output", "context", "actual_output")


def v1_frame(spark: SparkSession, sf_dir: str, shape: tuple) -> DataFrame:
    table, q, t, c, s = shape
    return scoring.score_v1(inputs.frame(spark, sf_dir, table), q, t, c, s)


def register_v1(name: str, shape: tuple, scores: tuple[str, ...], lists: tuple[str, ...] = ()) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return v1_frame(spark, sf_dir, shape).select("id", *rounded(*scores), *[F.array_join(x, ",").alias(x) if x != "bias_flag" else x for x in lists])

    QUERIES[name] = query
    cols = [f"round({x}, {DIGITS}) AS {x}" for x in scores] + [f"array_to_string({x}, ',') AS {x}" if x != "bias_flag" else x for x in lists]
    ORACLES[name] = sql_v1(*shape) + f" SELECT id, {', '.join(cols)} FROM v1"


register_v1("h01_answer_relevancy", EVAL, ("answer_relevancy",))
register_v1("h02_contextual_relevancy", EVAL, ("contextual_relevancy",))
register_v1("h03_contextual_precision_recall", EVAL, ("contextual_precision", "contextual_recall"))
register_v1("h04_faithfulness_v1", EVAL, ("faithfulness",))
register_v1("h05_toxicity_terms", EVAL, ("toxicity",), ("toxicity_flags",))
register_v1("h06_bias_flag", EVAL, (), ("bias_flag", "sensitive_mentions", "negative_cues"))
register_v1("h07_hallucination_rate", EVAL, ("hallucination_rate",))
register_v1("h08_overall_v1", EVAL, ("overall",))
register_v1("h09_dataset_scores", PAIRS, scoring.V1_SCORES, ("bias_flag",))


# ---- profile 2 ------------------------------------------------------------

UNICODE_BLANK = "[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]"


def sql_norm2(x: str) -> str:
    low = f"regexp_replace(lower(coalesce({x}, '')), '^\\s+|\\s+$', '', 'g')"
    return f"trim(regexp_replace(trim({low}, '''\"“”‘’'), '\\s+', ' ', 'g'))"


def sql_v2(table: str, i: str, t: str, c: str, s: str, label: str = "task_label") -> str:
    """CTE chain that ends in v2: the scores of profile 2 but for formats that SQL
    can't parse (JSON and code validity), which the table's texts don't show."""
    refused = " OR ".join(f"contains(nrm, '{p.replace(chr(39), chr(39) * 2)}')" for p in lex.REFUSAL_PHRASES)
    elements = lambda x: f"list_distinct({x} || [{x}[k] || '_' || {x}[k + 1] FOR k IN range(1, len({x}))])"
    bullet = "(?m)^\\s*[-*•]"
    return sql_counts(table, i, t, c, s, 2) + f""",
b1 AS (SELECT *, coalesce({i}, '') AS ins, coalesce({s}, '') AS stu, coalesce({t}, '') AS tea, coalesce({c}, '') AS ctx, {label} AS task, {sql_norm2(s)} AS nrm,
  len({sql_tokens(s)}) AS nw, len({sql_tokens(t)}) AS tw, {sql_content(t, 2)} AS tl, {sql_content(s, 2)} AS sl FROM ag),
b2 AS (SELECT *, ({refused}) AS refused, {elements("tl")} AS te, {elements("sl")} AS se,
  regexp_matches(stu, '{bullet}\\s+') OR regexp_matches(stu, '(?m)^\\s*\\d+[.)]\\s+') AS has_list, regexp_matches(stu, '(?m)^#+\\s+') AS has_headers,
  contains(stu, '{{') OR contains(stu, '[') AS has_json, contains(stu, '```') OR contains(stu, 'def ') OR contains(stu, 'function ') AS has_code,
  coalesce(nullif(regexp_extract(lower(ins), '([0-9]+)\\s*words?', 1), ''), nullif(regexp_extract(lower(ins), '(?:max|maximum|limit|under|less than)\\s*([0-9]+)\\s*words?', 1), ''),
    nullif(regexp_extract(lower(ins), '([0-9]+)\\s*sentences?', 1), ''), nullif(regexp_extract(lower(ins), 'in\\s*([0-9]+)\\s*(?:words?|sentences?)', 1), '')) AS lim_text,
  len(regexp_extract_all(stu, '[a-zA-Z]')) AS latin FROM b1),
b3 AS (SELECT *, TRY_CAST(lim_text AS INT) AS lim, coalesce(json_valid(trim(stu)), false) AND has_json AS json_ok, list_distinct(list_intersect(te, se)) AS cov,
  CASE WHEN latin = 0 THEN 'unknown' ELSE 'english' END AS lang FROM b2),
b4 AS (SELECT *,
  CASE WHEN task = 'technical_code' THEN CASE WHEN has_code THEN 1.0 WHEN regexp_matches(stu, 'def |class |function |=>|return ') THEN 1.0 ELSE 0.2 END
    ELSE least(1.0, 0.5 + CASE WHEN has_list THEN 0.15 ELSE 0.0 END + CASE WHEN has_headers THEN 0.15 ELSE 0.0 END + CASE WHEN json_ok THEN 0.2 ELSE 0.0 END) END AS structured_correctness,
  CASE WHEN NOT regexp_matches(stu, '\\S') THEN 0.0 WHEN refused THEN 0.1 WHEN nw < 5 THEN 0.2 ELSE least(1.0, 0.5 + 0.3 * cq + CASE WHEN tea <> '' THEN 0.2 * ct ELSE 0.0 END + CASE task
    WHEN 'technical_code' THEN CASE WHEN contains(stu, '```') OR contains(stu, 'def ') OR contains(stu, 'function') THEN 0.1 ELSE 0.0 END
    WHEN 'math_logic' THEN CASE WHEN regexp_matches(stu, '\\d') THEN 0.05 ELSE 0.0 END + CASE WHEN regexp_matches(stu, '[-=+*/]') THEN 0.05 ELSE 0.0 END
    WHEN 'classification_analysis' THEN CASE WHEN has_list THEN 0.1 ELSE 0.0 END
    WHEN 'language_editing' THEN CASE WHEN nw >= 20 THEN 0.1 ELSE 0.0 END
    WHEN 'creative_generative' THEN CASE WHEN nw >= 50 THEN 0.1 ELSE 0.0 END ELSE 0.0 END) END AS task_success,
  CASE WHEN coalesce(lim, 0) > 0 AND nw > lim * 1.5 THEN 0 WHEN coalesce(lim, 0) > 0 AND nw > lim * 1.1 THEN 1 ELSE 2 END AS ls,
  CASE WHEN contains(lower(ins), 'json') AND NOT has_json THEN 'json' WHEN contains(lower(ins), 'list') AND NOT regexp_matches(stu, '(?m)^\\s*[-*•\\d]') THEN 'list'
    WHEN contains(lower(ins), 'table') AND NOT contains(stu, '|') THEN 'table' WHEN contains(lower(ins), 'code') AND NOT (contains(stu, '```') OR regexp_matches(stu, 'def |function |class ')) THEN 'code'
    WHEN contains(lower(ins), 'bullet') AND NOT regexp_matches(stu, '{bullet}') THEN 'bullet' WHEN contains(lower(ins), 'numbered') AND NOT regexp_matches(stu, '(?m)^\\s*\\d+[.)]') THEN 'numbered' END AS lacking,
  CASE WHEN tea = '' THEN 0.0 WHEN len(te) = 0 THEN 1.0 ELSE CAST(len(cov) AS DOUBLE) / len(te) END AS coverage,
  CASE WHEN tea <> '' AND ctx <> '' THEN least(1.0, 0.6 * ct + 0.4 * ccs) WHEN tea <> '' THEN ct WHEN ctx <> '' THEN ccs ELSE 0.0 END AS faithfulness,
  CASE WHEN ctx = '' OR ns = 0 THEN 0.0 ELSE 1.0 - ncs / ns END AS hallucination, CASE WHEN ctx = '' OR nc = 0 THEN 1.0 ELSE ncs / nc END AS context_grounding,
  CASE WHEN tea = '' THEN 1.0 WHEN tw = 0 THEN CASE WHEN nw < 50 THEN 1.0 ELSE 0.5 END
    ELSE (SELECT CASE WHEN r BETWEEN 0.8 AND 1.2 THEN 1.0 WHEN r BETWEEN 0.5 AND 2.0 THEN 0.8 WHEN r BETWEEN 0.3 AND 3.0 THEN 0.6 WHEN r BETWEEN 0.2 AND 5.0 THEN 0.4 ELSE 0.2 END FROM (SELECT CAST(nw AS DOUBLE) / tw AS r)) END AS conciseness,
  regexp_matches(stu, '\\S') AND NOT refused AND nw >= 5 AND cq >= 0.1 AND CASE WHEN ctx <> '' THEN (cq + ccs) / 2 ELSE cq END >= 0.5 AS success FROM b3),
b5 AS (SELECT *, (ls + CASE WHEN lacking IS NULL THEN 2 ELSE 1 END + CASE WHEN refused THEN 0 ELSE 2 END + 2) / 8.0 AS instruction_following FROM b4),
v2 AS (SELECT *, (structured_correctness + task_success + instruction_following + coverage + faithfulness + context_grounding + conciseness) / 7 * (1 - hallucination) AS overall_score,
  0.6 * (structured_correctness + task_success + instruction_following) / 3 + 0.4 * (0.375 * coverage + 0.25 * faithfulness + 0.25 * (1 - hallucination) + 0.125 * context_grounding) AS overall_60_40 FROM b5)"""


def v2_frame(spark: SparkSession, sf_dir: str, student: str = "student_output", teacher: str | None = "teacher_output") -> DataFrame:
    return scoring.score_v2(inputs.frame(spark, sf_dir, "eval_records"), student=student, teacher=teacher)


def register_v2(name: str, cols: tuple[str, ...], plain: tuple[str, ...] = (), more: tuple[tuple[str, str, str], ...] = ()) -> None:
    """more: result column, Spark expression, SQL expression."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return v2_frame(spark, sf_dir).select("id", *rounded(*cols), *plain, *[F.expr(e).alias(n) for n, e, _ in more])

    QUERIES[name] = query
    picked = [f"round(CAST({x} AS DOUBLE), {DIGITS}) AS {x}" for x in cols] + list(plain) + [f"{e} AS {n}" for n, _, e in more]
    ORACLES[name] = sql_v2(*EVAL) + f" SELECT id, {', '.join(picked)} FROM v2"


register_v2("h10_structured_correctness", ("structured_correctness",))
register_v2("h11_task_success", ("task_success",))
register_v2("h12_instruction_following", ("instruction_following",), (), (("missing", "get(filter(details.violations, v -> v like 'missing_format:%'), 0)", "'missing_format:' || lacking"), ("n_violations", "cast(size(details.violations) as long)", "CAST((ls < 2)::INT + (lacking IS NOT NULL)::INT + refused::INT AS BIGINT)")))
register_v2("h13_coverage", ("coverage",), (), (("covered", "cast(details.elements_covered as long)", "CASE WHEN tea = '' THEN 0 ELSE len(cov) END"), ("missing", "array_join(details.missing_elements, ',')", "array_to_string(list_sort([w FOR w IN te IF NOT list_contains(se, w)])[1:20], ',')")))
register_v2("h14_conciseness", ("conciseness",))
register_v2("h15_faithfulness_v2", ("faithfulness",))
register_v2("h16_hallucination", ("hallucination",), (), (("ungrounded", "array_join(details.ungrounded_terms, ',')", f"array_to_string(list_sort([w FOR w IN list_distinct(sl) IF NOT list_contains({sql_content('ctx', 2)}, w)])[1:15], ',')"),))
register_v2("h17_context_grounding", ("context_grounding",), (), (("unused", "array_join(details.unused_context_terms, ',')", f"array_to_string(list_sort([w FOR w IN list_distinct({sql_content('ctx', 2)}) IF NOT list_contains(sl, w)])[1:15], ',')"),))
register_v2("h18_success_threshold", (), ("success",))
register_v2("h19_overall_v2", ("overall_score",))
register_v2("h20_overall_60_40", ("overall_60_40",))
register_v2("h27_metric_details", (), (), (("teacher_similarity", "round(details.teacher_similarity, 6)", "round(CASE WHEN tea <> '' THEN ct ELSE 0.0 END, 6)"), ("context_similarity", "round(details.context_similarity, 6)", "round(CASE WHEN ctx <> '' THEN ccs ELSE 0.0 END, 6)"), ("elements_total", "cast(details.elements_total as long)", "CASE WHEN tea <> '' THEN len(te) ELSE 0 END"), ("length_ratio", "round(details.length_ratio, 6)", "round(CASE WHEN tea = '' THEN 1.0 WHEN tw = 0 THEN 0.0 ELSE CAST(nw AS DOUBLE) / tw END, 6)")))


# ---- two models ------------------------------------------------------------

def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = inputs.frame(spark, sf_dir, "eval_records")
    return scoring.compare_models(records, "student_output", "student_output_tuned", "teacher_output")


def sql_compared() -> str:
    a = sql_v2(*EVAL)
    b = sql_v2("eval_records", "input", "teacher_output", "context", "student_output_tuned")
    return f"""WITH sa AS ({a} SELECT id, task_label, context, overall_score AS oa, hallucination AS ha, coverage AS ca FROM v2), sb AS ({b} SELECT id, overall_score AS ob, hallucination AS hb, coverage AS cb FROM v2),
cmp AS (SELECT sa.*, sb.ob, sb.hb, sb.cb, CASE WHEN round(oa, 4) > round(ob, 4) THEN 'a' WHEN round(ob, 4) > round(oa, 4) THEN 'b' ELSE 'tie' END AS winner, coalesce(regexp_matches(context, '\\S'), false) AS has_context FROM sa JOIN sb ON sa.id = sb.id)"""


def h22_two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).select("id", "winner", "has_context", F.round("overall_score_a", 4).alias("a"), F.round("overall_score_b", 4).alias("b"))


QUERIES["h22_two_models"] = h22_two_models
ORACLES["h22_two_models"] = sql_compared() + " SELECT id, winner, has_context, round(oa, 4) AS a, round(ob, 4) AS b FROM cmp"


def win_counts() -> list:
    return [F.count("*").alias("n"), *[F.count_if(F.col("winner") == w).alias(n) for w, n in (("a", "wins_a"), ("b", "wins_b"), ("tie", "ties"))]]


SQL_WINS = "count(*) AS n, count(*) FILTER (winner = 'a') AS wins_a, count(*) FILTER (winner = 'b') AS wins_b, count(*) FILTER (winner = 'tie') AS ties"


def d07_category_win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = compared(spark, sf_dir).groupBy("task_label").agg(*win_counts(), F.round(F.avg("overall_score_a"), DIGITS).alias("mean_a"), F.round(F.avg("overall_score_b"), DIGITS).alias("mean_b"))
    return by.withColumns({"win_rate_a": F.round(F.col("wins_a") / F.col("n"), DIGITS), "win_rate_b": F.round(F.col("wins_b") / F.col("n"), DIGITS)})


QUERIES["d07_category_win_rates"] = d07_category_win_rates
ORACLES["d07_category_win_rates"] = sql_compared() + f" SELECT task_label, {SQL_WINS}, round(avg(oa), 6) AS mean_a, round(avg(ob), 6) AS mean_b, round(count(*) FILTER (winner = 'a') / count(*), 6) AS win_rate_a, round(count(*) FILTER (winner = 'b') / count(*), 6) AS win_rate_b FROM cmp GROUP BY task_label"


def d08_overall_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by category weighed by their counts, and the better model."""
    by = compared(spark, sf_dir).groupBy("task_label").agg(F.count("*").alias("n"), F.avg("overall_score_a").alias("a"), F.avg("overall_score_b").alias("b"))
    whole = by.agg(F.sum("n").alias("n"), (F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("a"), (F.sum(F.col("b") * F.col("n")) / F.sum("n")).alias("b"))
    return whole.select("n", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.when(F.col("a") > F.col("b"), "a").when(F.col("b") > F.col("a"), "b").otherwise("tie").alias("winner"))


QUERIES["d08_overall_winner"] = d08_overall_winner
ORACLES["d08_overall_winner"] = sql_compared() + " SELECT count(*) AS n, round(avg(oa), 4) AS a, round(avg(ob), 4) AS b, CASE WHEN avg(oa) > avg(ob) THEN 'a' WHEN avg(ob) > avg(oa) THEN 'b' ELSE 'tie' END AS winner FROM cmp"


def d09_context_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).groupBy("has_context").agg(*win_counts(), F.round(F.avg("overall_score_a"), DIGITS).alias("mean_a"), F.round(F.avg("overall_score_b"), DIGITS).alias("mean_b"))


QUERIES["d09_context_split"] = d09_context_split
ORACLES["d09_context_split"] = sql_compared() + f" SELECT has_context, {SQL_WINS}, round(avg(oa), 6) AS mean_a, round(avg(ob), 6) AS mean_b FROM cmp GROUP BY has_context"


def h21_teacher_student(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = scoring.compare_pair(inputs.frame(spark, sf_dir, "eval_records"))
    return both.select("id", "error_category", "student_wins", *rounded("degradation_overall_score", "degradation_task_success", "degradation_instruction_following"))


def sql_pair() -> str:
    s = sql_v2(*EVAL)
    t = sql_v2("eval_records", "input", "''", "context", "teacher_output")
    return f"""WITH st AS ({s} SELECT id, overall_score AS os, task_success AS ts_, instruction_following AS fs, success AS ss_ FROM v2), te_ AS ({t} SELECT id, overall_score AS ot, task_success AS tt_, instruction_following AS ft, success AS st_ FROM v2),
pair AS (SELECT st.*, te_.ot, tt_, ft, st_, CASE WHEN st_ AND ss_ THEN 'both_correct' WHEN st_ THEN 'distillation_loss' WHEN ss_ THEN 'student_hallucination' ELSE 'dataset_issue' END AS error_category FROM st JOIN te_ ON st.id = te_.id)"""


QUERIES["h21_teacher_student"] = h21_teacher_student
ORACLES["h21_teacher_student"] = sql_pair() + " SELECT id, error_category, os > ot AS student_wins, round(ot - os, 6) AS degradation_overall_score, round(tt_ - ts_, 6) AS degradation_task_success, round(ft - fs, 6) AS degradation_instruction_following FROM pair"


def d26_error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.compare_pair(inputs.frame(spark, sf_dir, "eval_records")).groupBy("error_category").agg(F.count("*").alias("n"))


QUERIES["d26_error_categories"] = d26_error_categories
ORACLES["d26_error_categories"] = sql_pair() + " SELECT error_category, count(*) AS n FROM pair GROUP BY error_category"


# ---- primitives -------------------------------------------------------------

def simple(name: str, table: str, make: Callable[[], dict], sql: dict[str, str]) -> None:
    """A query that selects expressions over a derived table."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inputs.frame(spark, sf_dir, table).select("id", *[e.alias(n) for n, e in make().items()])

    QUERIES[name] = query
    ORACLES[name] = f"SELECT id, {', '.join(f'{e} AS {n}' for n, e in sql.items())} FROM ({inputs.text(table)}) rec"


S = "student_output"
simple("g01_normalize_v1", "eval_records", lambda: {"text": tx.normalize(F.col(S))}, {"text": f"trim(regexp_replace(lower(coalesce({S}, '')), '\\s+', ' ', 'g'))"})
simple("g02_normalize_v2", "eval_records", lambda: {"text": tx.normalize(F.col(S), 2)}, {"text": sql_norm2(S)})
simple("g03_tokens", "doc_pairs", lambda: {"tokens": F.array_join(tx.tokens(F.col("actual_output")), " ")}, {"tokens": f"array_to_string({sql_tokens('actual_output')}, ' ')"})
simple("g04_content_tokens", "doc_pairs", lambda: {"tokens": F.array_join(tx.content_tokens(F.col("actual_output"), 2), " ")}, {"tokens": f"array_to_string({sql_content('actual_output', 2)}, ' ')"})
simple("g05_token_set", "doc_pairs", lambda: {"tokens": F.array_join(F.array_sort(tx.token_set(F.col("actual_output"))), " ")}, {"tokens": f"array_to_string(list_sort(list_distinct({sql_content('actual_output', 2)})), ' ')"})
simple("g08_word_count", "doc_pairs", lambda: {"n": tx.word_count(F.col("actual_output")).cast("long")}, {"n": f"len({sql_tokens('actual_output')})"})
simple("g12_elements", "eval_records", lambda: {"n": F.size(tx.elements(tx.content_tokens(F.col("teacher_output"), 2))).cast("long")}, {"n": f"(SELECT len(list_distinct(l || [l[k] || '_' || l[k + 1] FOR k IN range(1, len(l))])) FROM (SELECT {sql_content('teacher_output', 2)} AS l))"})
simple("g13_refusal", "eval_records", lambda: {"refused": tx.is_refusal(F.col(S))}, {"refused": "(" + " OR ".join("contains({}, '{}')".format(sql_norm2(S), p.replace("'", "''")) for p in lex.REFUSAL_PHRASES) + ")"})
simple("g14_script_language", "doc_pairs", lambda: {"language": tx.script_language(F.col("actual_output"))}, {"language": "CASE WHEN len(regexp_extract_all(coalesce(actual_output, ''), '[a-zA-Z]')) > 0 THEN 'english' ELSE 'unknown' END"})
simple("g15_length_limit", "eval_records", lambda: {"n": tx.length_limit(F.col("input"))}, {"n": "CAST(coalesce(nullif(regexp_extract(lower(input), '([0-9]+)\\s*words?', 1), ''), nullif(regexp_extract(lower(input), '([0-9]+)\\s*sentences?', 1), '')) AS INT)"})
simple("g18_format_flags", "eval_records", lambda: {k: v for k, v in tx.format_flags(F.col(S)).items() if k in ("has_json", "has_code", "has_list", "has_headers", "has_table")}, {
    "has_json": f"coalesce(contains({S}, '{{') OR contains({S}, '['), false)", "has_code": f"coalesce(contains({S}, '```') OR contains({S}, 'def ') OR contains({S}, 'function '), false)",
    "has_list": f"coalesce(regexp_matches({S}, '(?m)^\\s*[-*•]\\s+') OR regexp_matches({S}, '(?m)^\\s*\\d+[.)]\\s+'), false)", "has_headers": f"coalesce(regexp_matches({S}, '(?m)^#+\\s+'), false)", "has_table": f"coalesce(regexp_matches({S}, '\\|.*\\|'), false)"})
simple("g16_json_validity", "eval_records", lambda: {"valid": holds_json(F.col(S))}, {"valid": f"coalesce(json_valid(trim({S})), false)"})

# ---- all levels of a comparison, term vectors -----------------------------------

def d09_comparison_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories, contexts and all of them from one scoring pass. Rows of one
    category are left out, which is still reported, with a count of 0."""
    made = scoring.comparison_levels(compared(spark, sf_dir).filter("task_label <> 'math_logic'"))
    means = [F.round(c, DIGITS).alias(c) for c in made.columns if c.endswith(("_a", "_b")) and not c.startswith("wins")]
    return made.select("level", "name", "n", "wins_a", "wins_b", "ties", "winner", *means)


SQL_MEANS = ", ".join(f"round(avg({c}{x}), 6) AS {m}_{x}" for m, c in (("overall_score", "o"), ("hallucination", "h"), ("context_grounding", "g"), ("faithfulness", "f")) for x in "ab")
SQL_LEVELS = sql_compared().replace("AS ca FROM v2)", "AS ca, context_grounding AS ga, faithfulness AS fa FROM v2)").replace("AS cb FROM v2)", "AS cb, context_grounding AS gb, faithfulness AS fb FROM v2)").replace("sa.*, sb.ob, sb.hb, sb.cb", "sa.*, sb.* EXCLUDE (id)")
QUERIES["d09_comparison_levels"] = d09_comparison_levels
ORACLES["d09_comparison_levels"] = SQL_LEVELS + f""", part AS (SELECT * FROM cmp WHERE task_label <> 'math_logic'), lv AS ({' UNION ALL '.join(f"SELECT '{level}' AS level, {name} AS name, {SQL_WINS}, CASE WHEN avg(oa) > avg(ob) THEN 'a' WHEN avg(ob) > avg(oa) THEN 'b' ELSE 'tie' END AS winner, {SQL_MEANS} FROM part GROUP BY 2" for level, name in (('category', 'task_label'), ('context', "CASE WHEN has_context THEN 'with_context' ELSE 'without_context' END"), ('overall', "'all'")))})
SELECT * REPLACE (coalesce(n, 0) AS n, coalesce(wins_a, 0) AS wins_a, coalesce(wins_b, 0) AS wins_b, coalesce(ties, 0) AS ties) FROM lv FULL JOIN (SELECT * FROM (VALUES {', '.join(f"('category', '{c}')" for c in lex.TASKS)}, ('context', 'with_context'), ('context', 'without_context'), ('overall', 'all')) t(level, name)) x USING (level, name)"""

ROLES = {"q": "input", "t": "expected_output", "c": "context", "s": "actual_output"}


def doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = inputs.pairs_by_id(spark, sf_dir, vectors.TASK_BYTES)
    return vectors.term_rows(pairs, "id", {r: tx.content_tokens(F.col(c)) for r, c in ROLES.items()}, dealt=True)


def g06_term_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.unit_vectors(doc_terms(spark, sf_dir)).select("id", "role", "token", "tf", F.round("weight", DIGITS).alias("weight"))


def g07_relational_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vectors.relational_overlaps(doc_terms(spark, sf_dir), [("q", "s"), ("t", "s"), ("c", "s")])
    return made.select("id", *rounded("cos_q_s", "cos_t_s", "cos_c_s"), "shared_c_s")


QUERIES |= {f.__name__: f for f in (g06_term_vectors, g07_relational_cosine)}
DOC_COUNTS = sql_counts("doc_pairs", *ROLES.values(), 1)
ORACLES |= {
    "g06_term_vectors": DOC_COUNTS + ", n AS (SELECT id, r, w, count(*) AS tf FROM tk GROUP BY ALL) SELECT id, r AS role, w AS token, tf, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY id, r)), 6) AS weight FROM n",
    "g07_relational_cosine": DOC_COUNTS + " SELECT ag.id, round(cq, 6) AS cos_q_s, round(ct, 6) AS cos_t_s, round(ccs, 6) AS cos_c_s, CAST(ag.ncs AS BIGINT) AS shared_c_s FROM ag JOIN sm ON sm.id = ag.id",
}

# ---- formats well and badly formed ---------------------------------------------

CASES = f"({inputs.text('format_cases')}) c"
GOOD_JSON, CODE, GOOD_CODE = "(0, 1, 2, 3, 7, 9, 10, 12, 15)", "(3, 4, 5, 16, 17, 18, 19, 20, 21, 22, 23)", "(3, 4, 16, 17, 20, 22, 23)"


def g16_json_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict JSON: text behind a value, NaN, fences, depth, escapes."""
    return inputs.frame(spark, sf_dir, "format_cases").select("id", holds_json(F.col("student_output")).alias("valid"))


def g17_code_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code by a parser; brackets alone judge some of these otherwise."""
    flags = tx.format_flags(F.col("student_output"), parse_code=True)
    return inputs.frame(spark, sf_dir, "format_cases").select("id", *[flags[k].alias(k) for k in ("has_code", "code_valid", "has_json", "json_valid")])


def h10_code_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score_v2(inputs.frame(spark, sf_dir, "format_cases"), parse_code=True)
    return scored.select("id", *rounded("structured_correctness"))


QUERIES |= {f.__name__: f for f in (g16_json_cases, g17_code_cases, h10_code_cases)}
BRACKET = "coalesce(contains(student_output, '{') OR contains(student_output, '['), false)"
ORACLES |= {
    "g16_json_cases": f"SELECT id, k IN {GOOD_JSON} AS valid FROM {CASES}",
    "g17_code_cases": f"SELECT id, k IN {CODE} AS has_code, k IN {GOOD_CODE} AS code_valid, {BRACKET} AS has_json, {BRACKET} AND k IN {GOOD_JSON} AS json_valid FROM {CASES}",
    "h10_code_cases": f"SELECT id, CASE WHEN k IN {GOOD_CODE} THEN 1.0 WHEN k IN {CODE} THEN 0.5 ELSE 0.2 END::DOUBLE AS structured_correctness FROM {CASES}",
}
