"""JSON and code validity against Python's own parsers."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusgauge.functions import json_check as jc
from corpusgauge.functions import text as tx
from corpusgauge.operators import scoring

BITS = ["{", "}", "[", "]", ",", ":", '"a"', '"b\\n"', '"\\u00e9"', '"\\x"', '"é "', "1", "-1.5", "1e5", "01", "1.", ".5", "-", "--1", "true", "false", "nul", "null", "NaN", "-Infinity", "Infinity", " ", "\n", "\t", "\x0b", '"', "\\", "\\b", "S", "V", "x", '{"a":1}', "[1,2]", '"tab\tin"', "1 2", "tr ue", "1\\b5", "﻿", "+1", "1E-3", '"\\""', '"\\\\"']
FENCES = ["```json", "```", "```json\n", "\n```", " text ", "{", "}", '{"a": 1}', "[1]", "[", "]", "\n", "1", '"s"', " "]


def parses(text):
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def value(rng, depth):
    kind = rng.randrange(6) if depth else 0
    if kind < 3:
        return rng.choice(["1", '"s"', "null", "true", "-0.5e+7", '"\\"q"', "NaN", '""'])
    blank = rng.choice(["", " ", "\n"])
    parts = [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 3:
        return "[" + blank + (blank + ",").join(parts) + blank + "]"
    return "{" + ",".join(f'"k{i % 2}"{blank}:{blank}{p}' for i, p in enumerate(parts)) + blank + "}"


def test_json_values_match_a_parser(spark):
    rng = random.Random(1)
    texts = {"".join(rng.choice(BITS) for _ in range(rng.randrange(1, 9))) for _ in range(1500)}
    for _ in range(700):
        good = value(rng, 4)
        k = rng.randrange(len(good) + 1)
        texts |= {good, good[:k] + rng.choice(BITS) + good[k:], good[:k] + good[k + 1 :]}
    texts |= {"", "[" * 400 + "]" * 400, '"' + "a" * 200_000 + '"', '"' + "\\n" * 50_000 + '"', "[" + ",".join(["1"] * 20_000) + "]", "[" * 401 + "]" * 400}
    texts = sorted(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)
    got = {r.i: r.v for r in df.select("i", jc.is_json_value(F.col("t")).alias("v")).collect()}
    assert [t[:80] for i, t in enumerate(texts) if got[i] != parses(t)] == [] and sum(got.values()) > 300


def holds(text):
    text = text.strip()
    if parses(text):
        return True
    for pattern in (r"```json\s*([\s\S]*?)\s*```", r"```\s*([\s\S]*?)\s*```", r"(\{[\s\S]*\})", r"(\[[\s\S]*\])"):
        found = re.search(pattern, text)
        if found:
            return parses(found[1])
    return False


def test_first_matching_part_decides(spark):
    rng = random.Random(2)
    texts = sorted({"".join(rng.choice(FENCES) for _ in range(rng.randrange(1, 10))) for _ in range(2500)})
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)
    got = {r.i: r.v for r in df.select("i", jc.holds_json(F.col("t")).alias("v")).collect()}
    assert [t for i, t in enumerate(texts) if got[i] != holds(t)] == [] and 100 < sum(got.values()) < len(texts) - 100


@pytest.mark.parametrize(("code", "parsed", "matched"), [
    ("def f(x):\n    return x", True, True), ("```python\nprint(1)\n```", True, True), ("```python\nprint(1\n```", False, False), ("x = ')'", True, False), ("if x = 1: pass", False, True),
    ("```\nfoo bar\n``` ```PYTHON\ny = 2\n```", True, True), ("", True, True), ("a\x00b", False, True), (None, False, True),
])
def test_code_is_parsed_or_its_brackets_match(spark, code, parsed, matched):
    row = spark.createDataFrame([(code,)], "c string").select(F.coalesce(tx.code_valid(F.col("c")), F.lit(False)), tx.code_valid(F.coalesce("c", F.lit("")), parse=False)).first()
    assert tuple(row) == (parsed, matched)


@pytest.mark.parametrize(("text", "shown", "score"), [("0123abcdef [5, 2] x", False, 0.2), ("9def plain", False, 0.2), ("subclass x", False, 0.2), ("so def f(): pass", True, 0.5), ("def f(): pass", True, 1.0), ("x => 1", False, 0.3)])
def test_parsed_code_is_marked_by_whole_words(spark, text, shown, score):
    """letters at the end of a digest aren't a keyword."""
    df = spark.createDataFrame([(1, "technical_code", "Write it", None, None, text)], "id long, task_label string, input string, context string, teacher_output string, student_output string")
    flags = tx.format_flags(F.col("student_output"), parse_code=True)
    assert df.select(flags["has_code"]).first()[0] == shown
    assert scoring.score_v2(df, parse_code=True).first().structured_correctness == score
    assert df.select(tx.format_flags(F.col("student_output"))["has_code"]).first()[0] == ("def " in text)


def test_elements_make_the_tokens_once(spark):
    """not once for each pair of neighbours."""
    made = spark.createDataFrame([("Red fox, red fox and 12 dogs",)], "t string").select(tx.elements(tx.content_tokens(F.col("t"), 2)).alias("e"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert made.first().e == ["red", "fox", "dogs", "red_fox", "fox_red", "fox_dogs"]
