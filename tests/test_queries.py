"""Every registered query with SQL beside it gives the same rows in both."""

import math
import os
import re

import duckdb
import pytest

from corpusgauge import catalog
from corpusgauge.plans import inputs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v if v is None or isinstance(v, int | str | bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in res.fetchall()), key=repr)
    assert got == want


def test_inputs_lose_no_row_and_no_text(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").filter("role = 'user'").count()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert inputs.frame(spark, SF, "eval_records").count() == turns
    pairs = inputs.frame(spark, SF, "doc_pairs")
    assert sorted(r[0] for r in pairs.select("actual_output").collect()) == sorted(r[0] for r in docs.select("text").collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_shuffles_nothing(spark):
    from corpusgauge.operators import scoring

    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("text as input", "text as expected_output", "text as context", "text as actual_output", "lang as task_label")
    for scored in (scoring.score_v1(docs), scoring.score_v2(docs, student="actual_output", teacher="expected_output")):
        assert "Exchange" not in plan(scored) and "Python" not in plan(scored)


#: Queries with a documented step in Python.
IN_PYTHON = {"h23_rouge_l", "h23_rouge_stemmed", "f06_length_batches", "g17_code_cases", "h10_code_cases"}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if "_stream_" not in n))
def test_plans_hold_no_product_and_no_python(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in text
    if name not in IN_PYTHON:
        assert not re.search("Python|Pandas|Arrow", text)


def test_top_per_group_is_limited_before_the_shuffle(spark):
    assert plan(QUERIES["f02_top_improvements"](spark, SF)).count("WindowGroupLimit") >= 2
