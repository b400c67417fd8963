"""Quality rules with thresholds that adapt to language and source.

Each measure is put on a logarithmic grid of fixed relative width; the counts
by (language, source, measure, cell) form a quantile sketch. Two sketches merge
by adding counts, so sketches of a source roll up to its language and to the
corpus, whatever the partitions and in any order, and a rerun gives the same
thresholds. A group's sketch is joined by ``prior`` rows of the sketch one level
up, so a small group mostly has its language's or the corpus's quantiles and a
large one its own, without a size at which that changes. No limit is fixed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.llm.codes import NON_SPACE, Words, groups, mix, per_text
from corpusgauge.llm.texts import per_row
from corpusgauge.session import settle

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: A byte that starts a code point.
LEADS = np.array([b & 0xC0 != 0x80 for b in range(256)])
U = np.uint64

BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


#: Shares of all values at which a sketch is looked at for a jump.
SHARES = (0.5, 0.75, 0.9, 0.95, 0.975, 0.99, 0.995)


def measures() -> dict[str, tuple[Column, str, str | None, int]]:
    """Name: ratio, the bad side, and for a share of a text the count it is a
    share of and how many of these mean little in a text of usual size.

    Word lengths don't count symbols, which have a rule of their own.
    """
    words = F.greatest(F.col("n_words"), F.lit(1))
    letters = F.col("word_chars") - F.col("n_symbols")
    return {
        "symbol_ratio": (F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), "high", "word_chars", 5),
        "repeat_ratio": (F.col("n_repeat_words") / words, "high", "n_words", 5),
        "dup_line_ratio": (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "high", "n_lines", 2),
        "long_words": (letters / words, "high", None, 0),
        "short_words": (letters / words, "low", None, 0),
    }


def text_counts(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    w = Words(buf, offs, NON_SPACE, lower=False)
    out = {
        "n_words": w.counts,
        "word_chars": per_text(NON_SPACE[buf] & LEADS[buf], offs),
        "n_symbols": per_text(SYMBOLS[buf], offs),
    }
    # lines: from a text's start or after a newline, up to a newline or the end
    breaks = np.flatnonzero(buf == 10)
    starts = np.sort(np.r_[offs[:-1], breaks + 1])
    text = np.searchsorted(offs, starts, "right") - 1
    ends = np.r_[starts[1:], len(buf)]
    has_word = np.searchsorted(w.starts, starts) < np.searchsorted(w.starts, ends)
    starts, ends, text = starts[has_word], ends[has_word], text[has_word]
    ends = ends - (buf[ends - 1] == 10)
    keys = mix(mix(w.spans(starts, ends)) + text.astype(U) * U(0x9E3779B97F4A7C15))
    order, first, _ = groups(keys)
    repeated = np.ones(len(keys), np.int64)
    repeated[order[first]] = 0
    out["n_lines"] = np.bincount(text, minlength=len(offs) - 1).astype(np.int64)
    out["n_dup_lines"] = np.bincount(text, repeated, len(offs) - 1).astype(np.int64)
    # words inside five-word windows that occur twice or more
    at, codes = w.windows(5)
    keys = mix(codes + w.text[at].astype(U) * U(0x9E3779B97F4A7C15))
    order, first, n = groups(keys)
    twice = np.zeros(len(keys), bool)
    twice[order] = np.repeat(n > 1, n)
    steps = np.zeros(len(w.codes) + 6, np.int64)
    np.add.at(steps, at[twice], 1)
    np.add.at(steps, at[twice] + 5, -1)
    covered = np.cumsum(steps)[: len(w.codes)] > 0
    out["n_repeat_words"] = per_text(covered, w.first)
    return out


def with_counts(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with the five base counts of each whole text (null: no words)
    and ``n_lines``, its lines that hold a word."""
    return per_row(docs, text, dict.fromkeys([*BASE_COLUMNS, "n_lines"], T.LongType()), text_counts, keep_text)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def cell(value: Column, width: float) -> Column:
    """Cell of a value of at least 0 on the grid; all below 1e-6 share the lowest."""
    return F.floor(F.log(F.greatest(value, F.lit(1e-6))) / F.lit(float(np.log1p(width)))).cast("int")


def sketches(counted: DataFrame, keys: list[str], width: float = 0.02) -> DataFrame:
    """Mergeable quantile sketches: rows by key, measure and cell of the grid,
    of the measures and of the counts that they are shares of.

    Rows that fail the base rules don't shape the thresholds.
    """
    values = {m: e for m, (e, *_) in measures().items()} | {f"size_{c}": F.col(c).cast("double") for c in ("word_chars", "n_words", "n_lines")}
    named = F.array(*[F.struct(F.lit(m).alias("measure"), cell(e, width).alias("cell")) for m, e in values.items()])
    return counted.filter(~base_failed()).select(*keys, F.explode(named).alias("x")).groupBy(*keys, "x.measure", "x.cell").agg(F.count("*").alias("n"))


def merged(fine: DataFrame, lang: str, source: str, prior: float) -> DataFrame:
    """Each (language, source)'s sketch with ``prior`` rows of its language's,
    which has ``prior`` rows of the corpus's. Counts become real numbers."""
    def shares(sketch: DataFrame, keys: list[str]) -> DataFrame:
        total = sketch.groupBy(*keys, "measure").agg(F.sum("n").alias("_all"))
        return sketch.join(total, [*keys, "measure"]).select(*keys, "measure", "cell", (F.lit(prior) * F.col("n") / F.col("_all")).alias("n"))

    def added(sketch: DataFrame, keys: list[str], above: DataFrame, on: list[str]) -> DataFrame:
        more = sketch.select(*keys, "measure").distinct().join(above, [*on, "measure"])
        both = sketch.select(*keys, "measure", "cell", F.col("n").cast("double").alias("n")).unionByName(more.select(*keys, "measure", "cell", "n"))
        return both.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))

    whole = fine.groupBy("measure", "cell").agg(F.sum("n").alias("n"))
    by_lang = fine.groupBy(lang, "measure", "cell").agg(F.sum("n").alias("n"))
    by_lang = added(by_lang, [lang], shares(whole, []), [])
    return added(fine, [lang, source], shares(by_lang, [lang]), [lang])


def quantiles(sketch: DataFrame, keys: list[str], width: float = 0.02) -> DataFrame:
    """Of each sketch: ``q1``, ``q3`` and number ``n_docs`` of its values above 0,
    and ``s<k>``, the quantiles of all values at ``SHARES`` (0 at or below 1e-6).

    A quantile is the upper end of the cell that reaches it. Most texts have no
    symbol, repeat or doubled line, so quartiles of all values coincide at 0.
    """
    by = [*keys, "measure"]
    sketch = sketch.groupBy(*by, "cell").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by)
    above = F.when(F.col("cell") > cell(F.lit(0.0), width), F.col("n")).otherwise(0)
    run = sketch.withColumns({"run": F.sum("n").over(w.orderBy("cell")), "all": F.sum("n").over(w), "run_up": F.sum(above).over(w.orderBy("cell")), "all_up": F.sum(above).over(w)})
    upper = F.when(F.col("cell") > cell(F.lit(0.0), width), F.exp((F.col("cell") + 1) * F.lit(float(np.log1p(width))))).otherwise(0.0)
    reach = lambda run, whole, q: F.min(F.when((F.col(whole) > 0) & (F.col(run) >= q * F.col(whole) - 1e-9), upper))
    inner = [F.min(F.when((F.col("all_up") > 0) & (upper > 0) & (F.col("run_up") >= q * F.col("all_up") - 1e-9), upper)).alias(name) for name, q in (("q1", 0.25), ("q3", 0.75))]
    return run.groupBy(*by).agg(F.max("all_up").alias("n_docs"), *inner, *[reach("run", "all", q).alias(f"s{k}") for k, q in enumerate(SHARES)])


def jump(q: Column, noise: Column, factor: float) -> Column:
    """Where the quantiles of a share leave the bulk: the mean (geometric) of
    two neighbours, the upper one ``factor`` times the lower and more, ``noise``
    added to both; null if the tail is without a gap."""
    steps = [(q[f"s{k}"] + noise, q[f"s{k + 1}"] + noise) for k in range(len(SHARES) - 1)]
    return F.coalesce(*[F.when(high >= factor * low, F.sqrt(low * high) - noise) for low, high in steps])


def thresholds(counted: DataFrame, lang: str = "lang", source: str = "source", prior: float = 50.0, spread: float = 3.0, factor: float = 8.0) -> DataFrame:
    """Per language and source: for each measure the value beyond which a
    document is rejected.

    The limit lies ``spread`` widths of the middle half of the values above 0
    beyond it. For a share, a jump of its quantiles (``jump``) comes first where
    it is lower: if nearly all texts have none of something and the rest much,
    the rest's quartiles would only describe the outliers. What a few symbols,
    words or lines are in a text of the group's usual size counts as noise.
    Measures without a value above 0 have no limit.
    """
    # keys that join where they are null
    coded = counted.withColumns({c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (lang, source)})
    fine = merged(sketches(coded, [lang, source]), lang, source, prior)
    found = quantiles(fine, [lang, source])
    wide = found.groupBy(lang, source).agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct(*[c for c in found.columns if c not in (lang, source, "measure")])))).alias("_q"))
    limits = {}
    for m, (_, side, size, few) in measures().items():
        q = F.col("_q")[m]
        fence = q["q3"] + spread * (q["q3"] - q["q1"]) if side == "high" else q["q1"] - spread * (q["q3"] - q["q1"])
        if size:
            noise = F.lit(float(few)) / F.greatest(F.col("_q")[f"size_{size}"]["s0"], F.lit(1.0))
            fence = F.least(fence, jump(q, noise, factor))
        limits[f"limit_{m}"] = fence
    plain = lambda c: F.when(F.col(c) != "-", F.substring(c, 2, 2**31 - 1)).alias(c)
    return wide.select(plain(lang), plain(source), *[e.alias(c) for c, e in limits.items()])


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", prior: float = 50.0, spread: float = 3.0, factor: float = 8.0, keep_text: bool = False) -> DataFrame:
    """Each document's counts and verdict: columns ``base_failed``, ``kept``
    and ``failed_rules`` (names of the measures beyond their threshold).

    Null texts have no words and fail the base rules; null languages and
    sources are groups of their own; repeated rows are judged one by one; an
    empty table gives an empty result. Texts are read once, unless ``keep_text``. Other columns are kept; those named
    like a result column are replaced. The thresholds are one row for each
    language and source, joined back to the documents.
    """
    own = ("base_failed", "kept", "failed_rules")
    counted = with_counts(docs.drop(*own), text, keep_text).withColumn("base_failed", base_failed())
    counted = counted if keep_text else settle(counted)
    limits = thresholds(counted, lang, source, prior, spread, factor).withColumnsRenamed({lang: "_lang", source: "_source"})
    joined = counted.join(limits, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    rules = [F.when(e > F.col(f"limit_{m}") if side == "high" else e < F.col(f"limit_{m}"), F.lit(m)) for m, (e, side, *_) in measures().items()]
    failed = F.array_compact(F.array(*rules))
    return joined.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
