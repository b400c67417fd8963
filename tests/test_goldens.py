"""Known cases of the metrics, streams against their batch forms, edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from corpusgauge.functions import text as tx
from corpusgauge.functions.json_check import holds_json
from corpusgauge.operators import improve, ngrams, scoring, tables
from corpusgauge.streaming import events as ev


def scored(spark, student, teacher, context, label, instruction):
    df = spark.createDataFrame([(instruction, student, teacher, context, label)], "input string, student_output string, teacher_output string, context string, task_label string")
    return scoring.score_v2(df).collect()[0]


def test_refusal(spark):
    r = scored(spark, "I'm sorry, but I cannot help with that request today.", "Paris is the capital of France.", None, "general_qa", "What is the capital of France?")
    assert r.task_success == 0.1 and r.instruction_following == 0.75 and r.details.violations == ["refusal_detected"]


def test_missing_texts(spark):
    r = scored(spark, None, None, None, None, None)
    assert (r.task_success, r.coverage, r.hallucination, r.context_grounding, r.conciseness, r.success) == (0.0, 0.0, 0.0, 1.0, 1.0, False)
    assert scored(spark, "some words here", "", "the of", "general_qa", "x").hallucination == 1.0


def test_profile_1_by_hand(spark):
    df = spark.createDataFrame([("red fox", "red dog", "red fox den", "red red fox"), (None, None, None, None)], "input string, expected_output string, context string, actual_output string")
    a, b = scoring.score_v1(df).collect()
    assert a.answer_relevancy == pytest.approx(3 / 10**0.5) or a.answer_relevancy == pytest.approx(3 / (2 * 5) ** 0.5)
    assert a.contextual_precision == 1.0 and a.contextual_recall == pytest.approx(2 / 3) and a.hallucination_rate == 0.0
    assert a.faithfulness == pytest.approx(0.6 * 2 / 10**0.5 + 0.4 * 3 / 15**0.5)
    assert b.overall == 0.0 and b.bias_flag == "clean"


def test_int_codes(spark):
    df = spark.createDataFrame([(0.4667,), (None,)], "v double")
    assert [tuple(r) for r in df.select(improve.encode(F.col("v")), improve.encode(F.col("v"), "null")).collect()] == [(4667, 4667), (0, None)]
    assert spark.range(1).select(improve.decode(F.lit(4667))).collect()[0][0] == 0.4667


def test_published_report_figures(spark):
    df = spark.createDataFrame([(0.393, 0.4349)], "a double, b double")
    r = improve.checkpoint_report(df, F.col("a"), F.col("b")).collect()[0]
    assert r.mean_gain == pytest.approx(0.0419) and r.percent == pytest.approx(10.67, abs=0.02)


def test_text_primitives(spark):
    one = spark.range(1)
    first = lambda c: one.select(c).collect()[0][0]
    assert first(tx.cut_suffix(F.lit("How do you make tea? (Manual Test #1: 14:19:11)"))) == "How do you make tea?"
    assert first(tx.length_limit(F.lit("in under 20 words"))) == 20
    assert first(tx.script_language(F.lit("привет"))) == "russian" and first(tx.script_language(F.lit(""))) == "unknown"
    assert first(holds_json(F.lit('see ```json\n{"a": 1}\n```'))) and not first(holds_json(F.lit("{oops")))
    assert first(tx.brackets_match(F.lit("f(x[1]{})"))) and not first(tx.brackets_match(F.lit("(]")))
    assert first(tx.derive_context(F.lit("Short one"), F.lit("general_qa"))) == "Teacher answer: Short one"
    assert first(tx.derive_context(F.lit("Add two numbers first. Then divide by ten. Done!"), F.lit("math_logic"))) == "Mathematical approach: Add two numbers first"
    assert first(tx.extract_response(F.lit("a ### Response: b </s> c"), "### Response:", "</s>")) == "b"


def test_lcs_and_bleu(spark):
    assert ngrams.lcs_length(list("abcbdab"), list("bdcaba")) == 4 and ngrams.lcs_length([], ["a"]) == 0
    df = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat"), ("a b c d", "x y"), ("a b", None)], "r string, h string")
    assert [round(x.bleu, 6) for x in ngrams.bleu(df, "r", "h").collect()] == [1.0, 0.0, 0.0]
    assert [round(x.rougeL, 6) for x in ngrams.rouge(df, "r", "h").collect()] == [1.0, 0.0, 0.0]


def test_null_keys(spark):
    base = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "id int, v string")
    new = spark.createDataFrame([(None, "B"), (3, "d")], "id int, v string")
    assert sorted(map(repr, tables.upsert(base, new, ["id"]).collect())) == sorted(["Row(id=1, v='a')", "Row(id=None, v='B')", "Row(id=2, v='c')", "Row(id=3, v='d')"])
    assert {(r.id, r.v) for r in tables.merge_update(base, new, ["id"]).collect()} == {(1, "a"), (None, "B"), (2, "c")}
    assert tables.anti_on(base, new, ["id"]).count() == 2 and tables.semi_on(base, new, ["id"]).count() == 1


def test_exact_cut_is_the_same_for_any_partitions(spark):
    df = spark.range(1003).select("id", tables.hash_unit(F.col("id"), 42).alias("u"))
    cut = lambda d: {r.id for r in tables.exact_cut(d, [F.col("u"), F.col("id")], 0.8).filter("part = 'train'").collect()}
    one, many = cut(df.coalesce(1)), cut(df.repartition(16))
    assert one == many and len(one) == 802


def test_stream_gives_the_batch_answer(spark, tmp_path):
    """Redelivered and late events over five files, counts and windows."""
    rows = [{"event_id": str(i), "record_id": i, "status_eval_first": "done" if i % 3 else "ready", "event_ts": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}"} for i in range(500)]
    for k in range(5):
        part = rows[100 * k : 100 * k + 100]
        part += part[:7]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.txt").write_text("".join(json.dumps(r) + "\n" for r in part))
    schema = "value string"
    stream = ev.once(ev.parse_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))), delay="1 hour")
    batch = ev.once(ev.parse_events(spark.read.schema(schema).text(str(tmp_path / "in"))))
    counts = lambda df: ev.status_counts(df, "status_eval_first")
    q = counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in counts(batch).collect()} == {("done", 333), ("ready", 167)}
