"""Queries for corpus preparation, prompts, splits and n-gram scores."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgauge.functions import lexicons as lex
from corpusgauge.functions import text as tx
from corpusgauge.operators import batching, ngrams, tables
from corpusgauge.plans import inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ER, DP, SC = (f"({inputs.text(t)}) {a}" for t, a in (("eval_records", "r"), ("doc_pairs", "d"), ("scored", "s")))


def query(sql: str | None, table: str = "eval_records"):
    def keep(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(inputs.frame(spark, sf_dir, table))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(f"SELECT id, array_to_string(['- ' || x FOR x IN [input, context, teacher_output] IF x IS NOT NULL], chr(10)) AS bullets FROM {ER}")
def g10_context_bullets(df):
    return df.select("id", tx.bullet_context(F.array_compact(F.array("input", "context", "teacher_output"))).alias("bullets"))


@query(f"SELECT id, array_to_string([x FOR x IN [context, teacher_output] IF coalesce(x, '') <> ''], ' ') AS text FROM {ER}")
def g09_flat_context(df):
    return df.select("id", tx.flatten_context(F.array("context", "teacher_output")).alias("text"))


@query(f"SELECT id, task_label || chr(10) || checkpoint AS text FROM {ER}")
def g11_context_objects(df):
    """``text`` where it isn't empty, else ``context``, of JSON objects."""
    objects = F.to_json(F.array(F.struct(F.col("task_label").alias("text"), F.lit("x").alias("context")), F.struct(F.lit("").alias("text"), F.col("checkpoint").cast("string").alias("context"))))
    return df.select("id", tx.context_from_json(objects).alias("text"))


def sql_task(x: str) -> str:
    quoted = lambda w: w.replace("'", "''")
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({x}), '{quoted(w)}')" for w in words) + f" THEN '{task}'" for task, words in lex.TASK_RULES) + f" ELSE '{lex.DEFAULT_TASK}' END"


INPUT = "(input || ' ' || coalesce(context, ''))"


@query(f"SELECT id, {sql_task(INPUT)} AS task FROM {ER}")
def g19_task_rules(df):
    return df.select("id", tx.classify_task(F.col("input"), F.coalesce("context", F.lit(""))).alias("task"))


@query(f"SELECT task, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM (SELECT {sql_task('input')} AS task FROM {ER}) x GROUP BY task")
def d23_label_distribution(df):
    counts = df.groupBy(tx.classify_task(F.col("input")).alias("task")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


#: The first sentences of a text as a list, in SQL.
SENTENCES = f"list_transform([trim(p, ' ' || chr(10)) FOR p IN regexp_split_to_array(coalesce(teacher_output, ''), '[.!?]+') IF len([w FOR w IN regexp_split_to_array(trim(p, ' ' || chr(10)), '\\s+') IF true]) >= 3][1:4], lambda p: CASE WHEN len(regexp_split_to_array(p, '\\s+')) > 40 THEN array_to_string(regexp_split_to_array(p, '\\s+')[1:40], ' ') ELSE p END)"


@query(f"SELECT id, array_to_string({SENTENCES}, '|') AS sentences FROM {ER}")
def g20_key_sentences(df):
    return df.select("id", F.array_join(tx.key_sentences(F.col("teacher_output")), "|").alias("sentences"))


#: By label: lead, number of sentences, lead and length where there is no sentence.
LEADS = {"technical_code": ("Technical approach: ", 2, "Teacher guidance: ", 150), "math_logic": ("Mathematical approach: ", 1, "Teacher reasoning: ", 150), "classification_analysis": ("Analysis approach: ", 2, "Teacher analysis: ", 150),
         "creative_generative": ("Creative guidance: ", 1, "Teacher example: ", 150), "language_editing": ("Language guidance: ", 1, "Teacher example: ", 150), "general_qa": ("Teacher knowledge: ", 2, "Teacher reference: ", 200)}
CONTEXTS = " ".join(f"WHEN '{label}' THEN CASE WHEN len(s) > 0 THEN '{lead}' || array_to_string(s[1:{n}], ' ') ELSE '{other}' || clean[1:{size}] END" for label, (lead, n, other, size) in LEADS.items())
#: Every fifth teacher's text is short, every seventh empty, every eleventh one long word.
TEACHER = "CASE WHEN id % 7 = 0 THEN '' WHEN id % 5 = 0 THEN 'Yes ' || id % 1000 WHEN id % 11 = 0 THEN repeat('x', CAST(id % 300 AS INT)) ELSE teacher_output END"


@query(f"""WITH t AS (SELECT id, task_label, {TEACHER} AS teacher_output FROM {ER}), x AS (SELECT id, task_label, teacher_output, regexp_replace(coalesce(teacher_output, ''), '^\\s+|\\s+$', '', 'g') AS clean, {SENTENCES} AS s FROM t),
m AS (SELECT *, trim(regexp_replace(CASE task_label {CONTEXTS} END, '\\s+', ' ', 'g')) AS made FROM x)
SELECT id, CASE WHEN coalesce(teacher_output, '') = '' THEN NULL WHEN length(clean) < 20 THEN CASE WHEN length(clean) > 5 THEN 'Teacher answer: ' || clean END WHEN length(made) < 15 THEN NULL WHEN length(made) > 500 THEN made[1:497] || '...' ELSE made END AS context FROM m""")
def g21_context_cases(df):
    """Derived contexts of whole, short, empty and one-word teacher texts."""
    return df.select("id", tx.derive_context(F.expr(TEACHER), F.col("task_label")).alias("context"))


@query(None)
def g21_derived_context(df):
    return df.select("id", tx.derive_context(F.col("teacher_output"), F.col("task_label")).alias("context"))


@query(f"SELECT id, '### Instruction:' || chr(10) || input || chr(10) || chr(10) || '### Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || '### Response:' || chr(10) AS prompt FROM {ER}")
def g22_prompts(df):
    return df.select("id", tx.build_prompt("response", instruction=F.col("input"), context=F.col("context")).alias("prompt"))


@query(f"SELECT id, trim(teacher_output, ' ' || chr(10)) AS response FROM {ER}")
def g23_responses(df):
    whole = F.concat(tx.build_prompt("response", instruction=F.col("input"), context=F.col("context")), "teacher_output", F.lit("</s> rest"))
    return df.select("id", tx.extract_response(whole, "### Response:", "</s>").alias("response"))


@query(f"SELECT id, task_label AS text FROM {ER}")
def g24_suffix_cleanup(df):
    return df.select("id", tx.cut_suffix(F.concat("task_label", F.lit(" (Manual Test #"), F.col("id").cast("string"), F.lit(": 14:19:11)"))).alias("text"))


@query(f"SELECT id, substr(actual_output, 1, 5000) AS text FROM {DP}", "doc_pairs")
def g25_truncation(df):
    """Text cut to a column's width of 5000, the reference's feature."""
    return df.select("id", F.substring("actual_output", 1, 5000).alias("text"))


@query(f"SELECT label, min(length(actual_output)) AS shortest, max(length(actual_output)) AS longest, round(avg(length(actual_output)), 4) AS mean FROM {DP} GROUP BY label", "doc_pairs")
def d24_length_profile(df):
    n = F.length("actual_output").cast("long")
    return df.groupBy("label").agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 4).alias("mean"))


@query(f"SELECT row_number() OVER (ORDER BY id) AS place, trim(input) AS instruction, coalesce(context, '') AS context FROM {ER}")
def i01_experiment_records(df):
    """Ids by the order of the source ids, counted per bucket."""
    placed = tables.exact_cut(tables.scaled(df, "id"), [F.col("_u"), F.col("id")], 1.0)
    return placed.select("place", F.trim("input").alias("instruction"), F.coalesce("context", F.lit("")).alias("context"))


@query(f"SELECT id, task_label AS instruction, input, coalesce(nullif(teacher_output, ''), student_output) AS output FROM {ER}")
def i02_instruction_samples(df):
    return df.select("id", F.col("task_label").alias("instruction"), "input", F.coalesce(F.nullif("teacher_output", F.lit("")), "student_output").alias("output"))


UNIT = "CAST(('0x' || substr(md5('{seed}:' || id), 1, 8)) AS BIGINT)"


def sql_split(order: str, share: float, table: str) -> str:
    return f"SELECT id, CASE WHEN row_number() OVER (ORDER BY {order}) <= floor({share} * count(*) OVER ()) THEN 'train' ELSE 'val' END AS part FROM {table}"


@query(sql_split(UNIT.replace("{seed}", "42") + ", id", 0.8, SC), "scored")
def i03_seeded_split(df):
    return tables.exact_cut(df.select("id").withColumn("_u", tables.hash_unit(F.col("id"), 42)), [F.col("_u"), F.col("id")], 0.8).select("id", "part")


@query(sql_split("id", 0.95, SC), "scored")
def i04_ordered_split(df):
    return tables.exact_cut(tables.scaled(df.select("id"), "id"), [F.col("_u"), F.col("id")], 0.95).select("id", "part")


@query(sql_split(UNIT.replace("{seed}", "7") + ", id", 0.9, SC), "scored")
def i05_other_seed_split(df):
    return tables.exact_cut(df.select("id").withColumn("_u", tables.hash_unit(F.col("id"), 7)), [F.col("_u"), F.col("id")], 0.9).select("id", "part")


def sql_grams(n: int) -> str:
    piece = " || ' ' || ".join(f"l[k + {j}]" if j else "l[k]" for j in range(n))
    return f"[{piece} FOR k IN range(1, len(l) - {n} + 2)]"


def longest_common(ref: str, hyp: str) -> str:
    """ROUGE-L in SQL: a row of the table of common lengths for each word of the
    second text. Rows never fall, so a cell is the greatest of the one above and,
    over matching places so far, one more than the cell before them above."""
    step = "[greatest(t.line[j + 1], coalesce(list_max([t.line[i] + 1 FOR i IN range(1, j + 1) IF r[i] = h[t.k + 1]]), 0)) FOR j IN range(1, len(r) + 1)]"
    return f"""WITH RECURSIVE rec AS (SELECT id, regexp_extract_all(lower(coalesce({ref}, '')), '[a-z0-9]+') AS r, regexp_extract_all(lower(coalesce({hyp}, '')), '[a-z0-9]+') AS h FROM {ER}),
t AS (SELECT id, 0 AS k, [0 FOR x IN range(len(r) + 1)] AS line FROM rec UNION ALL SELECT t.id, t.k + 1, [0] || {step} FROM t JOIN rec ON rec.id = t.id WHERE t.k < len(h))
SELECT rec.id, round(coalesce(2.0 * t.line[-1] / nullif(len(r) + len(h), 0), 0), 6) AS rougeL FROM rec JOIN t ON t.id = rec.id AND t.k = len(h)"""


ROUGE = f"""WITH rec AS (SELECT id, regexp_extract_all(lower(coalesce(teacher_output, '')), '[a-z0-9]+') AS r, regexp_extract_all(lower(coalesce(student_output_tuned, '')), '[a-z0-9]+') AS h FROM {ER}),
t AS (SELECT id, 'r' AS s, unnest(r) AS w FROM rec UNION ALL SELECT id, 'h', unnest(h) FROM rec),
c AS (SELECT id, w, count(*) FILTER (s = 'r') AS a, count(*) FILTER (s = 'h') AS b FROM t GROUP BY id, w),
m AS (SELECT id, sum(least(a, b)) AS hits FROM c GROUP BY id)
SELECT rec.id, round(coalesce(2.0 * coalesce(hits, 0) / nullif(len(r) + len(h), 0), 0), 6) AS rouge1 FROM rec LEFT JOIN m ON m.id = rec.id"""


@query(ROUGE)
def h23_rouge_1(df):
    return ngrams.rouge_1(df, "teacher_output", "student_output_tuned").select("id", F.round("rouge1", 6).alias("rouge1"))


@query(longest_common("teacher_output", "student_output"))
def h23_rouge_l(df):
    return ngrams.rouge(df, "teacher_output", "student_output").select("id", F.round("rougeL", 6).alias("rougeL"))


@query(None)
def h23_rouge_stemmed(df):
    """Both scores over stems, as the scorer with its stemmer on gives them."""
    return ngrams.rouge_stemmed(df, "teacher_output", "student_output").select("id", F.round("rouge1", 6).alias("rouge1"), F.round("rougeL", 6).alias("rougeL"))


def prompt_sizes(batch: pd.DataFrame) -> pd.Series:
    return batch["input"].str.len() + batch["context"].fillna("").str.len()


@query(f"SELECT id, length(input) + length(coalesce(context, '')) AS result FROM {ER}")
def f06_length_batches(df):
    """A batch function over blocks of 50 records of like length."""
    size = F.length("input") + F.length(F.coalesce("context", F.lit("")))
    made = batching.in_batches(df.select("id", "input", "context"), prompt_sizes, size, result="long")
    return made.select("id", "result")


BLEU_PARTS = ", ".join(f"coalesce((SELECT sum(hits) FROM m WHERE m.id = rec.id AND m.n = {n}), 0) AS m{n}, greatest(1, len(h) - {n} + 1) AS d{n}" for n in range(1, 5))
BLEU = f"""WITH rec AS (SELECT id, [w FOR w IN regexp_split_to_array(coalesce(teacher_output, ''), '\\s+') IF w <> ''] AS r, [w FOR w IN regexp_split_to_array(coalesce(student_output_tuned, ''), '\\s+') IF w <> ''] AS h FROM {ER}),
t AS ({' UNION ALL '.join(f"SELECT id, {n} AS n, '{s}' AS s, unnest({sql_grams(n)}) AS g FROM (SELECT id, {s} AS l FROM rec)" for n in range(1, 5) for s in 'rh')}),
c AS (SELECT id, n, g, count(*) FILTER (s = 'r') AS a, count(*) FILTER (s = 'h') AS b FROM t GROUP BY id, n, g),
m AS (SELECT id, n, sum(least(a, b)) AS hits FROM c GROUP BY id, n),
x AS (SELECT rec.id, len(r) AS nr, len(h) AS nh, {BLEU_PARTS} FROM rec)
SELECT id, round(CASE WHEN m1 = 0 THEN 0.0 ELSE CASE WHEN nh > nr THEN 1.0 ELSE exp(1 - nr / CAST(nh AS DOUBLE)) END * exp(({' + '.join(f"ln(CASE WHEN m{n} > 0 THEN CAST(m{n} AS DOUBLE) ELSE 0.1 END / d{n})" for n in range(1, 5))}) / 4) END, 6) AS bleu FROM x"""


@query(BLEU)
def h24_bleu(df):
    return ngrams.bleu(df, "teacher_output", "student_output_tuned").select("id", F.round("bleu", 6).alias("bleu"))


@query(f"SELECT id, overall FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY f, o) AS k FROM (SELECT id, overall, 'a.csv' AS f, 1 AS o FROM {SC} UNION ALL SELECT id, -1, 'b.csv', 1 FROM {SC} WHERE id % 2 = 0) x) y WHERE k = 1", "scored")
def a13_union_first_wins(df):
    """Rows of two files: the first by file name and place stays."""
    a = df.select("id", "overall", F.lit("a.csv").alias("file"), F.lit(1).alias("place"))
    b = df.filter("id % 2 = 0").select("id", F.lit(-1).alias("overall"), F.lit("b.csv").alias("file"), F.lit(1).alias("place"))
    return tables.earliest(a.unionByName(b), ["id"], ["file", "place"]).select("id", "overall")


@query(f"SELECT id, substr(input, 1, 100) AS input, CASE WHEN length(teacher_output) > 200 THEN substr(teacher_output, 1, 200) || '...' ELSE teacher_output END AS output FROM {ER} ORDER BY id LIMIT 10")
def f05_report_samples(df):
    out = F.when(F.length("teacher_output") > 200, F.concat(F.substring("teacher_output", 1, 200), F.lit("..."))).otherwise(F.col("teacher_output"))
    return df.orderBy("id").limit(10).select("id", F.substring("input", 1, 100).alias("input"), out.alias("output"))
