"""ROUGE and BLEU over whole texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.text import BLANKS
from corpusgauge.operators.scoring import overlaps
from corpusgauge.operators.stems import stems
from corpusgauge.session import settle


def rouge_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def f1(hits: Column, n_ref: Column, n_hyp: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * hits, n_ref + n_hyp), F.lit(0.0))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, one bit of a whole number per token of ``a``."""
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        match = places.get(t, 0) & row
        row = (row + match | row - match) & full
    return len(a) - row.bit_count()


def lcs_column(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(a), list(b)) for a, b in zip(ref, hyp, strict=True)], dtype="int64")


def rouge(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """``df`` with ``rouge1`` and ``rougeL`` (F1, no stemming)."""
    df = df.withColumns({"_r": rouge_tokens(F.col(ref)), "_h": rouge_tokens(F.col(hyp))})
    o = overlaps([F.col("_r"), F.col("_h")], [(0, 1)])
    lcs = F.pandas_udf(lcs_column, "long")
    n = lambda c: F.size(c)
    return df.withColumns({"rouge1": f1(o["p01"]["m"], n("_r"), n("_h")), "rougeL": f1(lcs("_r", "_h"), n("_r"), n("_h"))}).drop("_r", "_h")


def rouge_1(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    df = df.withColumns({"_r": rouge_tokens(F.col(ref)), "_h": rouge_tokens(F.col(hyp))})
    o = overlaps([F.col("_r"), F.col("_h")], [(0, 1)])
    return df.withColumn("rouge1", f1(o["p01"]["m"], F.size("_r"), F.size("_h"))).drop("_r", "_h")


#: Up to so many distinct tokens their stems are sent to all tasks; more are joined by a shuffle.
FEW_TOKENS = 1 << 20


def stemmed_tokens(df: DataFrame, id_col: str, texts: dict[str, str]) -> DataFrame:
    """``id`` and for each name the text's tokens, in order, as stems.

    Tokens are rows here: the distinct ones are stemmed once, joined back and
    gathered by id. ``id_col`` has to tell rows apart; a null or empty text has
    an empty array.
    """
    roles = F.array(*[F.struct(F.lit(n).alias("role"), rouge_tokens(F.col(c)).alias("tokens")) for n, c in texts.items()])
    rows = df.select(F.col(id_col).alias("id"), F.explode(roles).alias("_t")).select("id", "_t.role", F.posexplode_outer("_t.tokens").alias("pos", "token"))
    known = settle(stems(rows.filter(F.col("token").isNotNull())))
    known = F.broadcast(known) if known.count() <= FEW_TOKENS else known
    both = rows.join(known, "token", "left")
    word = F.when(F.col("token").isNotNull(), F.struct("pos", "stem"))
    gathered = both.groupBy("id").agg(*[F.array_sort(F.collect_list(F.when(F.col("role") == n, word))).alias(n) for n in texts])
    return gathered.select("id", *[F.col(f"{n}.stem").alias(n) for n in texts])


def rouge_stemmed(df: DataFrame, ref: str, hyp: str, id_col: str = "id") -> DataFrame:
    """``id, rouge1, rougeL`` (F1) over stems; ``id_col`` has to be unique."""
    made = stemmed_tokens(df, id_col, {"_r": ref, "_h": hyp})
    o = overlaps([F.col("_r"), F.col("_h")], [(0, 1)])
    lcs = F.pandas_udf(lcs_column, "long")
    return made.select(F.col("id").alias(id_col), f1(o["p01"]["m"], F.size("_r"), F.size("_h")).alias("rouge1"), f1(lcs("_r", "_h"), F.size("_r"), F.size("_h")).alias("rougeL"))


def grams(tokens: Column, n: int) -> Column:
    made = F.transform(tokens, lambda t, i: F.when(i + n <= F.size(tokens), F.concat_ws(" ", t, *[F.get(tokens, i + k) for k in range(1, n)])))
    return F.filter(made, lambda g: g.isNotNull())


def bleu(df: DataFrame, ref: str, hyp: str, epsilon: float = 0.1) -> DataFrame:
    """``df`` with ``bleu``: up to 4 words, missing orders smoothed by epsilon."""
    split = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), BLANKS), lambda t: t != "")
    df = df.withColumns({"_r": split(ref), "_h": split(hyp)})
    df = df.withColumns({f"_{x}{n}": grams(F.col(f"_{x}"), n) for x in "rh" for n in range(1, 5)})
    df = df.withColumns({f"_m{n}": overlaps([F.col(f"_r{n}"), F.col(f"_h{n}")], [(0, 1)])["p01"]["m"] for n in range(1, 5)})
    size_r, size_h = F.size("_r"), F.size("_h")
    logs = sum((F.log(F.when(F.col(f"_m{n}") > 0, F.col(f"_m{n}")).otherwise(F.lit(epsilon)) / F.greatest(F.lit(1), F.size(f"_h{n}"))) for n in range(1, 5)), F.lit(0.0))
    brevity = F.when(size_h > size_r, 1.0).otherwise(F.exp(1 - F.try_divide(size_r, size_h)))
    score = F.when(F.col("_m1") > 0, brevity * F.exp(logs / 4)).otherwise(0.0)
    gone = ["_r", "_h", *[f"_{x}{n}" for x in "rhm" for n in range(1, 5)]]
    return df.withColumn("bleu", score).drop(*gone)
