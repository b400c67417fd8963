"""Term-frequency vectors as rows, and what is computed from them by grouping.

The row-by-row form (``scoring.overlaps``) holds all tokens of a record in one
array; here a token of a record is a row. Records are dealt by id before their
texts become rows, as a text is much smaller than its rows are: tokens are
counted, weighed and summed where their record is, and nothing but records is
shuffled. Counts of one id are a hash table of its distinct tokens, which spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.session import input_bytes

#: Bytes of input files for each task: texts grow to about 50 times their bytes as counted rows.
TASK_BYTES = 8 << 20


def term_rows(df: DataFrame, id_col: str, texts: dict[str, Column], dealt: bool = False) -> DataFrame:
    """``id, role, token, tf``: how often a role's text has a token. ``texts``
    gives an array of tokens for each role; empty and null ones have no rows.
    Records that are ``dealt`` by id stay where they are."""
    if not dealt:
        df = df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // TASK_BYTES)), id_col)
    roles = F.array(*[F.struct(F.lit(r).alias("role"), c.alias("tokens")) for r, c in texts.items()])
    long = df.select(F.col(id_col).alias("id"), F.explode(roles).alias("_t")).select("id", "_t.role", F.explode("_t.tokens").alias("token"))
    return long.groupBy("id", "role", "token").agg(F.count("*").alias("tf"))


def unit_vectors(terms: DataFrame) -> DataFrame:
    """``terms`` with ``weight``: tf divided by the vector's length."""
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy("id", "role")))
    return terms.withColumn("weight", F.col("tf") / norm)


def relational_overlaps(terms: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``id`` and for each pair of roles its cosine ``cos_a_b`` (0 if a vector
    is empty, at most 1) and shared distinct tokens ``shared_a_b``.

    One row for each (id, token) holds all roles' counts; no vector is joined
    with another. Records without any token have no row.
    """
    roles = list(dict.fromkeys(r for p in pairs for r in p))
    wide = terms.groupBy("id", "token").agg(*[F.sum(F.when(F.col("role") == r, F.col("tf")).otherwise(0)).alias(f"_{r}") for r in roles])
    squares = [F.sum(F.col(f"_{r}") * F.col(f"_{r}")).cast("double").alias(f"_q_{r}") for r in roles]
    dots = [F.sum(F.col(f"_{a}") * F.col(f"_{b}")).cast("double").alias(f"_d_{a}_{b}") for a, b in pairs]
    shared = [F.count_if((F.col(f"_{a}") > 0) & (F.col(f"_{b}") > 0)).alias(f"shared_{a}_{b}") for a, b in pairs]
    sums = wide.groupBy("id").agg(*squares, *dots, *shared)
    cosine = [F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(f"_d_{a}_{b}"), F.sqrt(F.col(f"_q_{a}") * F.col(f"_q_{b}"))), F.lit(0.0))).alias(f"cos_{a}_{b}") for a, b in pairs]
    return sums.select("id", *cosine, *[f"shared_{a}_{b}" for a, b in pairs])
