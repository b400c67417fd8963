"""A training-data pipeline over the ``documents`` table, stage by stage.

Every stage gets the rows that the stage before it kept, decides about all of
them and returns the columns of ``documents``; the last one returns the mix.
Columns beyond those of ``documents`` go, whatever their names. Null and
repeated ids are rows like others: a stage judges rows, not ids, and equal rows
get equal verdicts (the Jaccard stage keeps one of them). Texts of any length
are read whole, and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.llm import decontaminate, jaccard, lines, mixing
from corpusgauge.llm import toxicity as tox
from corpusgauge.session import read_table, settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine calls toxic go. Null and empty
    texts are scored by the bias; without labels of both kinds all rows have one
    score, the share of toxic labels, or nearly 0 without any."""
    labels = read_table(spark, sf_dir, "labels")
    return tox.toxicity(docs, labels, keep_text=True).filter(F.col("predicted") == 0).select(*COLUMNS)


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs in five documents go, but for its first; so
    does a document that had words and has none left. ``n_chars`` follows the
    text. Passages that few documents share stay: near copies are the next
    stage's, which needs them whole. Null, empty and blank texts stay; of equal
    rows all keep a template's first line, or none; ids and then hashes of texts
    say which document is first."""
    left = lines.drop_recurring_lines(docs.select(*COLUMNS)).filter(~F.col("emptied"))
    return left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least
    id (null ids last), then of the least hash of its text. All documents without
    words stay."""
    return jaccard.keep_one(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty items
    have no window; without items all documents stay."""
    found = decontaminate.decontaminate(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))
    return found.filter(F.col("n_hit") == 0).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each remaining document the mix takes. A null text has
    none; a null source is a source; ties are broken by size and text."""
    mixed = mixing.mix_sources(docs.select("doc_id", "text", "lang", "source"))
    return mixed.select("doc_id", "lang", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_template_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: The first stage's model can't be written as SQL; tests hold the stages
#: against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs)
    return docs
