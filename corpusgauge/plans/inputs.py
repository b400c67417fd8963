"""Tables that queries work on, derived from the given ones.

Each is one SELECT that Spark and other engines read alike; the names of given
tables stand in braces. Texts are used whole and all rows come out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.session import input_bytes, read_table, spread

#: Question and answer records, two answers each, one per user turn.
EVAL_RECORDS = """
SELECT p.id, p.conv_id, tpl.prefix || p.q AS input, tpl.task_label,
       CASE WHEN p.m IN (0, 4) THEN b.text || ' ' || p.s WHEN p.m = 6 THEN '' ELSE c.sys END AS context,
       b.text AS teacher_output,
       CASE p.m WHEN 0 THEN '- ' || p.s
                WHEN 1 THEN 'I cannot help with that. ' || p.s
                WHEN 2 THEN '# Title' || chr(10) || '1. ' || p.s
                WHEN 3 THEN CASE WHEN p.s IS NOT NULL THEN 'Yes, it is.' END
                WHEN 4 THEN b.text || ' you stupid old man ' || p.s
                WHEN 5 THEN NULL ELSE '{"a": "' || p.id || ' | 42 = 6 * 7 |"}' END AS student_output,
       b.text || ' ' || p.s AS student_output_tuned,
       CAST((p.conv_id % 10) + 1 AS INT) AS checkpoint,
       CASE (p.conv_id * 5 + p.turn) % 6 WHEN 0 THEN NULL WHEN 1 THEN 'score' WHEN 2 THEN 'finetune'
            WHEN 3 THEN 'output_tuned' WHEN 4 THEN 'score_tuned' ELSE 'completed' END AS status
FROM (SELECT u.conv_id * 1000 + u.turn AS id, u.conv_id, u.turn, u.text AS q, a.text AS s,
             (u.conv_id * 7 + u.turn) % 7 AS m, (u.conv_id * 3 + u.turn) % 8 AS k,
             (u.conv_id * 11 + u.turn) % (SELECT count(*) FROM {benchmark}) AS bi
      FROM {conversations} u
      LEFT JOIN (SELECT conv_id, turn, text FROM {conversations} WHERE role = 'assistant') a
        ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE u.role = 'user') p
JOIN (SELECT * FROM (VALUES
  (0, 'technical_code', 'Write a Python function that sorts: '),
  (1, 'math_logic', 'Calculate the average of 12 and 30 in 20 words: '),
  (2, 'classification_analysis', 'Classify the tone as a list: '),
  (3, 'language_editing', 'Rewrite in max 15 words: '),
  (4, 'creative_generative', 'Write a poem in 3 sentences: '),
  (5, 'general_qa', 'Who said: '),
  (6, 'general_qa', 'Give a numbered answer in JSON: '),
  (7, 'technical_code', 'Show the table of code for: ')) AS t(k, task_label, prefix)) tpl ON tpl.k = p.k
LEFT JOIN {benchmark} b ON b.item_id = p.bi
LEFT JOIN (SELECT conv_id, min(text) AS sys FROM {conversations} WHERE turn = 0 AND role = 'system' GROUP BY conv_id) c ON c.conv_id = p.conv_id
"""

#: Documents in pairs of neighbours, the last with the first; multilingual, long.
DOC_PAIRS = """
SELECT d.doc_id AS id, d.source AS label, b.text AS input, e.text AS expected_output, d.text AS actual_output,
       CASE WHEN d.doc_id % 3 <> 0 THEN b.text || ' ' || d.text END AS context
FROM {documents} d
LEFT JOIN {documents} e ON e.doc_id = (d.doc_id + 1) % (SELECT max(doc_id) + 1 FROM {documents})
LEFT JOIN {benchmark} b ON b.item_id = d.doc_id % (SELECT count(*) FROM {benchmark})
"""

METRICS = ("answer_relevancy", "contextual_precision", "contextual_recall", "contextual_relevancy", "faithfulness", "toxicity", "hallucination_rate", "overall")

#: Records with eight metrics times 10000 before and after a change.
SCORED = """
SELECT o_orderkey AS id, o_orderpriority AS label,
       CAST((o_orderkey % 10) + 1 AS INT) AS checkpoint,
       CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'score' WHEN 2 THEN 'finetune'
            WHEN 3 THEN 'output_tuned' WHEN 4 THEN 'score_tuned' ELSE 'completed' END AS status,
       o_orderkey % 3 = 0 AS has_context, o_orderdate AS created_at, 'input ' || o_custkey AS input,
       CAST((o_orderkey * 37 + o_custkey * 11) % 10001 AS INT) AS answer_relevancy,
       CAST((o_orderkey * 41 + o_custkey * 13) % 10001 AS INT) AS contextual_precision,
       CAST((o_orderkey * 43 + o_custkey * 17) % 10001 AS INT) AS contextual_recall,
       CAST((o_orderkey * 47 + o_custkey * 19) % 10001 AS INT) AS contextual_relevancy,
       CAST((o_orderkey * 53 + o_custkey * 23) % 10001 AS INT) AS faithfulness,
       CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE (o_orderkey * 59) % 501 END AS INT) AS toxicity,
       CAST((o_orderkey * 61 + o_custkey * 29) % 10001 AS INT) AS hallucination_rate,
       CAST((o_orderkey * 67 + o_custkey * 31) % 10001 AS INT) AS overall,
       CAST((o_orderkey * 71 + o_custkey * 5) % 10001 AS INT) AS answer_relevancy_tuned,
       CAST((o_orderkey * 73 + o_custkey * 7) % 10001 AS INT) AS contextual_precision_tuned,
       CAST((o_orderkey * 79 + o_custkey * 3) % 10001 AS INT) AS contextual_recall_tuned,
       CAST((o_orderkey * 83 + o_custkey * 2) % 10001 AS INT) AS contextual_relevancy_tuned,
       CAST((o_orderkey * 89 + o_custkey) % 10001 AS INT) AS faithfulness_tuned,
       CAST((o_orderkey * 97) % 501 AS INT) AS toxicity_tuned,
       CAST((o_orderkey * 101 + o_custkey) % 10001 AS INT) AS hallucination_rate_tuned,
       CAST(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey * 103 + o_custkey) % 10001 END AS INT) AS overall_tuned
FROM {orders}
"""

#: Changes of a record's status; every twentieth event is delivered twice.
STATUS_EVENTS = """
SELECT event_id, op, record_id, status, old_status, status_final, event_ts, latency_ms
FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'INSERT' ELSE 'UPDATE' END AS op,
             CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id END AS record_id, st AS status,
             lag(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_status,
             CASE WHEN event_type = 'purchase' AND value > 100 THEN 'done' END AS status_final,
             CAST(ts AS TIMESTAMP) AS event_ts, value AS latency_ms
      FROM (SELECT event_id, user_id, ts, event_type, value,
                   CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'ready' WHEN 'click' THEN 'created'
                        WHEN 'view' THEN 'score' WHEN 'error' THEN 'failed' END AS st
            FROM {events}) x) y
JOIN (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0)) AS t(again, copy)) z
  ON z.again = CASE WHEN event_id % 20 = 0 THEN 0 ELSE 1 END
"""

#: Texts that show formats well and badly formed, by ``k``; ``<`` and ``>`` stand for curly brackets.
FORMAT_CASES = """
SELECT id, k, CAST('technical_code' AS STRING) AS task_label, 'Write it' AS input, CAST(NULL AS STRING) AS context, CAST(NULL AS STRING) AS teacher_output,
       replace(replace(CASE k WHEN 0 THEN '<"id": ' || id || ', "h": "' || m || '">' WHEN 1 THEN '<"id": ' || id || '> and ' || m
         WHEN 2 THEN '[NaN, -Infinity, ' || id || ']' WHEN 3 THEN '```json' || chr(10) || '<"a": [1, <"b": "' || m || '">]>' || chr(10) || '```'
         WHEN 4 THEN '```json' || chr(10) || '<"a": 1,>' || chr(10) || '``` then <"b": 2>' WHEN 5 THEN '```' || chr(10) || '[1, 2' || chr(10) || '``` [3]'
         WHEN 6 THEN '<"a": 1> and <"b": ' || id || '>' WHEN 7 THEN m || ' [' || id || ', 2] ' || m WHEN 8 THEN '<"a": 01>'
         WHEN 9 THEN repeat('[', 60) || repeat(']', 60) WHEN 10 THEN '"' || m || '"' WHEN 11 THEN m || ' plain' WHEN 12 THEN '[1, 2] and <"a": 1>'
         WHEN 13 THEN '<"a": "x' || chr(10) || 'y">' WHEN 15 THEN '<"a": "' || chr(92) || 'u00e9 ' || chr(92) || 'n ' || chr(92) || '" ">'
         WHEN 16 THEN 'def f(x):' || chr(10) || '    return x + ' || id WHEN 17 THEN '```python' || chr(10) || 'print(' || id || ')' || chr(10) || '``` text'
         WHEN 18 THEN '```python' || chr(10) || 'print(' || id || chr(10) || '```' WHEN 19 THEN 'def broken(:'
         WHEN 20 THEN '```' || chr(10) || 'for i in range(3):' || chr(10) || '    pass' || chr(10) || '```' WHEN 21 THEN 'function words here'
         WHEN 22 THEN '```' || chr(10) || 'foo bar' || chr(10) || '``` ```python' || chr(10) || 'x = ' || id || chr(10) || '```'
         WHEN 23 THEN 'def f(): return "(" + "' || m || '"' END, '<', chr(123)), '>', chr(125)) AS student_output
FROM (SELECT conv_id * 1000 + turn AS id, (conv_id * 5 + turn) % 24 AS k, md5(coalesce(text, '')) AS m FROM {conversations}) x
"""

INPUTS = {"format_cases": FORMAT_CASES, "eval_records": EVAL_RECORDS, "doc_pairs": DOC_PAIRS, "scored": SCORED, "status_events": STATUS_EVENTS}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table as a DataFrame."""
    sql = INPUTS[name]
    tables = {t: read_table(spark, sf_dir, t) for t in set(re.findall(r"\{([a-z]+)\}", sql))}
    tables |= {t: spread(tables[t]) for t in ("documents", "conversations") if t in tables}
    return spark.sql(re.sub(r"\{(?![a-z]+\})", "{{", sql).replace('"}', '"}}'), **tables)


def pairs_by_id(spark: SparkSession, sf_dir: str, task_bytes: int) -> DataFrame:
    """The rows of ``doc_pairs``, dealt by id: a text is shuffled once for the
    record that it is of and once for the record whose neighbour it is.

    The join is the one of ``DOC_PAIRS``, turned round: a document looks for the
    id that comes before its own. That is one id where none is negative;
    otherwise the pairs are made as they stand there and dealt afterwards.
    """
    docs = read_table(spark, sf_dir, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-2 * input_bytes(docs) // task_bytes))
    if low is None or low < 0:
        return frame(spark, sf_dir, "doc_pairs").repartition(tasks, "id")
    before = F.when(F.col("doc_id") == 0, F.lit(high)).otherwise(F.col("doc_id") - 1)
    sql = DOC_PAIRS.replace("{documents} d\n", "{dealt} d\n").replace("{documents} e ON e.doc_id = (d.doc_id + 1) % (SELECT max(doc_id) + 1 FROM {documents})", "{mates} e ON e.before = d.doc_id")
    return spark.sql(sql, dealt=docs.repartition(tasks, "doc_id"), mates=docs.withColumn("before", before).repartition(tasks, "before"), benchmark=read_table(spark, sf_dir, "benchmark"))


def text(name: str) -> str:
    """The derived table as SQL over the given tables."""
    return re.sub(r"\{([a-z]+)\}", r"\1", INPUTS[name])
