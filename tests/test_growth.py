"""Increments, sketches, sampled counts, term vectors, levels, stems, batches."""

import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusgauge.functions import lexicons as lex
from corpusgauge.functions import text as tx
from corpusgauge.operators import batching, estimates, improve, ngrams, scoring, tables, vectors
from corpusgauge.operators.incremental import IncrementalSummary
from corpusgauge.operators.stems import stems
from corpusgauge.plans import inputs
from corpusgauge.queries import scores


# ---- increments -----------------------------------------------------------------

def test_increments_equal_the_full_summary(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 1, 5, -7])) for i in range(200)] + [(None, "a", 1)]
    df = spark.createDataFrame(rows, "id long, g string, v int")
    summary = lambda: IncrementalSummary(spark, f"{tmp_path}/s", "id", "g", "string", {"v": F.col("v"), "known": F.when(F.col("v").isNotNull(), 1).otherwise(0)})
    assert summary().mark() == (None, 0) and summary().totals().count() == 0
    for top in (50, 51, 51, 150, 500):
        summary().advance(df.filter(F.col("id") <= top))
    assert summary().mark()[0] == 199
    got = {r.g: (r.n, r.v, r.known) for r in summary().totals().collect()}
    want = {}
    for g in ("a", "b", None):
        own = [v for i, x, v in rows if x == g and i is not None]
        want[g] = (len(own), sum(v for v in own if v is not None), sum(v is not None for v in own))
    assert got == want
    # nothing new: nothing changes
    summary().advance(df)
    assert {r.g: (r.n, r.v, r.known) for r in summary().totals().collect()} == want


def test_increment_reads_only_what_is_new(spark, tmp_path):
    spark.range(0, 1000).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    from corpusgauge.operators.incremental import read_since

    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,500)]" in read_since(df, "id", 500)._jdf.queryExecution().executedPlan().toString()


# ---- estimates -------------------------------------------------------------------

def test_sketches_roll_up_within_their_error(spark):
    df = spark.range(0, 60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("h"), (F.col("id") % 40_000).alias("v"))
    df = df.unionByName(spark.sql("SELECT 9L AS g, 9L AS h, CAST(NULL AS BIGINT) AS v"))
    got = {(r.g, r.h, r.level): r.estimate for r in estimates.rolled_up(estimates.distinct_sketches(df, ["g", "h"], "v"), ["g", "h"]).collect()}
    assert got[9, 9, 2] == 0 and abs(got[None, None, 0] - 40_000) <= 40_000 * 4 * estimates.SKETCH_ERROR / 64
    exact = {(r.g, r.h): r.n for r in df.groupBy("g", "h").agg(F.count_distinct("v").alias("n")).collect()}
    assert all(abs(got[g, h, 2] - n) <= max(1, n * 4 * estimates.SKETCH_ERROR / 64) for (g, h), n in exact.items())
    assert {k[2] for k in got} == {0, 1, 2} and estimates.distinct_sketches(df.limit(0), ["g", "h"], "v").count() == 0


def test_sampled_counts_cover_the_exact_ones(spark):
    df = spark.range(0, 200_000).select("id", (F.floor(F.log2(F.col("id") + 1))).alias("g"))
    exact = {r.g: r.n for r in df.groupBy("g").agg(F.count("*").alias("n")).collect()}
    got = estimates.sampled_counts(df, ["g"], F.col("id")).collect()
    assert all(r.low <= exact[r.g] <= r.high for r in got)
    top = max(got, key=lambda r: r.g)
    assert abs(top.estimate - exact[top.g]) < 0.1 * exact[top.g]
    assert got == estimates.sampled_counts(df.repartition(7), ["g"], F.col("id")).orderBy("g").collect() or sorted(map(tuple, got)) == sorted(map(tuple, estimates.sampled_counts(df.repartition(7), ["g"], F.col("id")).collect()))


# ---- vectors and levels -------------------------------------------------------------

def test_relational_overlaps_equal_the_row_form(spark):
    rng = random.Random(4)
    text = lambda: rng.choice([None, "", "12 the of", " ".join(rng.choice("red fox dog den blue sky tree 42 the".split()) for _ in range(rng.randrange(1, 60)))])
    rows = [(i, text(), text(), text()) for i in range(60)] + [(60, "word " * 30_000, "word other", "x")]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    tokens = {x: tx.content_tokens(F.col(x)) for x in "abc"}
    terms = vectors.term_rows(df, "id", tokens)
    got = {r.id: r for r in vectors.relational_overlaps(terms, [("a", "c"), ("b", "c")]).collect()}
    o = F.col("o")
    for r in df.select("id", scoring.overlaps(list(tokens.values()), [(0, 2), (1, 2)]).alias("o")).select("id", scoring.cosine(o, 0, 2).alias("ac"), scoring.cosine(o, 1, 2).alias("bc"), o["p12"]["s"].alias("s")).collect():
        own = got.get(r.id)
        assert (0, 0, 0) == (r.ac, r.bc, r.s) if own is None else (own.cos_a_c, own.cos_b_c, own.shared_b_c) == (pytest.approx(min(1, r.ac)), pytest.approx(min(1, r.bc)), r.s)
    unit = vectors.unit_vectors(terms).groupBy("id", "role").agg(F.sum(F.col("weight") ** 2).alias("w")).collect()
    assert all(math.isclose(r.w, 1.0) for r in unit)


def test_overlaps_equal_counters(spark):
    """five texts, empty ones, tokens in any number of them."""
    rng = random.Random(6)
    rows = [(i, *[[rng.choice("abcdefgh") for _ in range(rng.choice((0, 1, 3, 40)))] for _ in range(5)]) for i in range(120)]
    pairs = [(k, j) for j in (3, 4) for k in range(3)]
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"t{k} array<string>" for k in range(5)))
    made = df.select("i", scoring.overlaps([F.col(f"t{k}") for k in range(5)], pairs).alias("o"))
    # each text is sorted alone and their runs together, not all tokens as structs
    assert made._jdf.queryExecution().optimizedPlan().toString().count("sort_array") == 6
    for r in made.collect():
        own = [Counter(x) for x in rows[r.i][1:]]
        assert [(r.o[f"n{k}"], r.o[f"q{k}"]) for k in range(5)] == [(len(c), sum(n * n for n in c.values())) for c in own]
        assert [tuple(r.o[f"p{a}{b}"]) for a, b in pairs] == [(sum(n * own[b][w] for w, n in own[a].items()), len(own[a].keys() & own[b].keys()), (own[a] & own[b]).total()) for a, b in pairs]


def test_terms_are_counted_and_weighed_where_their_record_is(spark):
    """one shuffle, of records; rows of one id count together."""
    rows = [(1, "red fox red", "dog"), (1, "red", None), (2, "", "fox"), (None, "red", "red")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    terms = vectors.term_rows(df, "id", {x: tx.content_tokens(F.col(x)) for x in "ab"})
    for made in (vectors.unit_vectors(terms), vectors.relational_overlaps(terms, [("a", "b")])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    got = {(r.id, r.role, r.token): (r.tf, round(r.weight, 6)) for r in vectors.unit_vectors(terms).collect()}
    assert got == {(1, "a", "red"): (3, 0.948683), (1, "a", "fox"): (1, 0.316228), (1, "b", "dog"): (1, 1.0), (2, "b", "fox"): (1, 1.0), (None, "a", "red"): (1, 1.0), (None, "b", "red"): (1, 1.0)}


def test_neighbours_are_dealt_by_id_once(spark, tmp_path):
    """a text goes to its record and to its neighbour's, records aren't dealt again; rows as the SQL has them."""
    item = spark.createDataFrame([(0, "red fox"), (1, "blue")], "item_id long, text string")
    cases = {"gaps": [0, 1, 2, 5, 6, 9], "twice": [0, 1, 1, 2, 2, 3], "none": [None, 0, 1], "one": [0], "far": [7, 8], "empty": [], "below": [-3, -2, -1, 0, 1], "nulls": [None]}
    for name, ids in cases.items():
        at = f"{tmp_path}/{name}"
        rows = [(i, f"red {k} sky " * (k + 1) if k != 1 else None, "en", "web", 5) for k, i in enumerate(ids)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
        item.write.parquet(f"{at}/benchmark.parquet")
        got, want = inputs.pairs_by_id(spark, at, 1 << 20), inputs.frame(spark, at, "doc_pairs")
        assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())), name
    doc_terms = scores.doc_terms(spark, f"{tmp_path}/gaps")
    for made in (vectors.unit_vectors(doc_terms), vectors.relational_overlaps(doc_terms, [("q", "s")])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        # the broadcast items and their count have exchanges of their own
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 2


def test_levels_keep_empty_groups_and_equal_single_groupings(spark):
    rng = random.Random(5)
    cols = [f"{m}_{x}" for m in ("overall_score", "hallucination", "context_grounding", "faithfulness") for x in "ab"]
    rows = [(rng.choice(["technical_code", "general_qa", "own label", None]), True, rng.choice(["a", "b", "tie"]), *[rng.random() for _ in cols]) for _ in range(80)]
    schema = "task_label string, has_context boolean, winner string, " + ", ".join(f"{c} double" for c in cols)
    got = {(r.level, r.name): r for r in scoring.comparison_levels(spark.createDataFrame(rows, schema)).collect()}
    assert {n for lv, n in got if lv == "category"} == {*lex.TASKS, "own label", "no label"}
    empty = got["context", "without_context"]
    assert (empty.n, empty.wins_a, empty.winner, empty.overall_score_a) == (0, 0, None, None)
    for (level, name), r in got.items():
        own = [x for x in rows if level == "overall" or (level == "context" and name == "with_context") or (level == "category" and (x[0] or "no label") == name)]
        assert (r.n, r.wins_a, r.ties) == (len(own), sum(x[2] == "a" for x in own), sum(x[2] == "tie" for x in own))
        if own:
            assert r.overall_score_a == pytest.approx(sum(x[3] for x in own) / len(own)) and r.faithfulness_b == pytest.approx(sum(x[-1] for x in own) / len(own))
    none = scoring.comparison_levels(spark.createDataFrame([], schema)).collect()
    assert len(none) == len(lex.TASKS) + 3 and {r.n for r in none} == {0}


# ---- stems ------------------------------------------------------------------------

VOWELS = "aeiou"


class Plain:
    """The algorithm letter by letter."""

    def consonant(self, w, i):
        return w[i] not in VOWELS and (w[i] != "y" or i == 0 or not self.consonant(w, i - 1))

    def shape(self, w):
        return "".join("c" if self.consonant(w, i) else "v" for i in range(len(w)))

    def m(self, w):
        return self.shape(w).count("vc")

    def cvc(self, w):
        s = self.shape(w)
        return (s[-3:] == "cvc" and w[-1] not in "wxy") or s == "vc"

    def rules(self, w, table):
        for end, new, ok in table:
            if w.endswith(end):
                stem = w[: len(w) - len(end)]
                return stem + new if ok(stem) else w
        return w

    def stem(self, w):
        from corpusgauge.operators.stems import IRREGULAR, STEP_2, STEP_3, STEP_4

        if len(w) <= 3:
            return w
        if w in IRREGULAR:
            return IRREGULAR[w]
        yes = lambda s: True
        w = w[:-1] if w.endswith("ies") and len(w) == 4 else self.rules(w, [("sses", "ss", yes), ("ies", "i", yes), ("ss", "ss", yes), ("s", "", yes)])
        w = self.past(w)
        w = self.rules(w, [("y", "i", lambda s: len(s) > 1 and self.consonant(s, len(s) - 1))])
        if w.endswith("alli") and self.m(w[:-4]) > 0:
            w = w[:-2]
        whole = w
        w = self.rules(w, [(a, b, lambda s: self.m(s) > 0) for a, b in STEP_2] + [("logi", "log", lambda s: self.m(whole[:-3]) > 0)])
        w = self.rules(w, [(a, b, lambda s: self.m(s) > 0) for a, b in STEP_3])
        w = self.rules(w, [(a, "", (lambda s: self.m(s) > 1 and s[-1] in "st") if a == "ion" else (lambda s: self.m(s) > 1)) for a in STEP_4])
        if w.endswith("e") and (self.m(w[:-1]) > 1 or (self.m(w[:-1]) == 1 and not self.cvc(w[:-1]))):
            w = w[:-1]
        return w[:-1] if w.endswith("ll") and self.m(w[:-1]) > 1 else w

    def past(self, w):
        if w.endswith("ied"):
            return w[:-1] if len(w) == 4 else w[:-2]
        if w.endswith("eed"):
            return w[:-1] if self.m(w[:-3]) > 0 else w
        for end in ("ed", "ing"):
            cut = w[: len(w) - len(end)]
            if w.endswith(end) and "v" in self.shape(cut):
                break
        else:
            return w
        for end, new in (("at", "ate"), ("bl", "ble"), ("iz", "ize")):
            if cut.endswith(end):
                return cut[: -len(end)] + new
        if len(cut) > 1 and cut[-1] == cut[-2] and self.consonant(cut, len(cut) - 1):
            return cut if cut[-1] in "lsz" else cut[:-1]
        return cut + "e" if self.m(cut) == 1 and self.cvc(cut) else cut


KNOWN = {"caresses": "caress", "flies": "fli", "dies": "die", "mules": "mule", "denied": "deni", "died": "die", "agreed": "agre", "owned": "own", "humbled": "humbl", "sized": "size", "meeting": "meet", "stating": "state", "siezing": "siez", "itemization": "item", "sensational": "sensat", "traditional": "tradit", "reference": "refer", "colonizer": "colon", "plotted": "plot", "hopefulness": "hope", "generalizations": "gener", "oscillators": "oscil", "happy": "happi", "sky": "sky", "skies": "sky", "rational": "ration", "controlling": "control", "the": "the", "was": "was", "ties": "tie"}


def test_stems_of_known_words_and_of_random_ones(spark):
    rng = random.Random(6)
    ends = ["", "s", "es", "ies", "ed", "ied", "eed", "ing", "ational", "izer", "alli", "entli", "ization", "iveness", "fulli", "logi", "icate", "ative", "ness", "ement", "ment", "ent", "ion", "tion", "sion", "ous", "e", "ee", "ll", "y", "yy", "ate", "bl", "able", "iz"]
    words = {"".join(rng.choice("aeiouybcdlmnrstz") for _ in range(rng.randrange(1, 7))) + rng.choice(ends) + rng.choice(["", "", "", "ed", "ing", "s"]) for _ in range(5000)} | {"a1b2", "2024", "yyyy", "sayyyed"}
    tokens = sorted(words | set(KNOWN))
    got = {r.token: r.stem for r in stems(spark.createDataFrame([(t,) for t in tokens] * 2, "token string")).collect()}
    assert len(got) == len(tokens) and {w: got[w] for w in KNOWN} == KNOWN
    plain = Plain()
    assert [(w, got[w], plain.stem(w)) for w in tokens if got[w] != plain.stem(w)] == []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_stemmed_rouge(spark):
    rng = random.Random(7)
    words = list(KNOWN) + ["state", "own", "plot", "refer"]
    text = lambda: rng.choice([None, "", " ".join(rng.choice(words).title() + rng.choice(["", ",", "."]) for _ in range(rng.randrange(1, 30)))])
    rows = [(i, text(), text()) for i in range(40)] + [(40, "He owned the plotted flies", "the plot: own fly dies")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    got = {r.id: (r.rouge1, r.rougeL) for r in ngrams.rouge_stemmed(df, "a", "b").collect()}
    plain = Plain()
    for i, a, b in rows:
        x, y = ([plain.stem(t) for t in (s or "").lower().replace(",", " ").replace(".", " ").replace(":", " ").split()] for s in (a, b))
        both = len(x) + len(y)
        want = (2 * sum((Counter(x) & Counter(y)).values()) / both, 2 * lcs(x, y) / both) if both else (0, 0)
        assert got[i] == (pytest.approx(want[0]), pytest.approx(want[1]))


# ---- batches -----------------------------------------------------------------------

def test_every_row_comes_back_once_and_padding_is_saved(spark):
    rng = random.Random(8)
    rows = [(i % 900, "x" * int(rng.paretovariate(1.1) * 5) if i % 50 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(5)
    size = F.length("t")
    seen = batching.in_batches(df, lambda b: b["t"].fillna("").str.len() + b["id"] * 0, size, size=50, result="long", partitions=3)
    got = seen.collect()
    assert Counter((r.id, r.result) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    assert max(r.batch_rows for r in got) == 50 and sum(r.batch_rows < 50 for r in got) < 3 * 50
    total = sum(len(t or "") for _, t in rows)
    by_length = total + sum(r.batch_padding / r.batch_rows for r in got)
    as_is = batching.padding(df, size, [F.col("id")]).first()
    assert as_is.total == total and by_length - total < 0.3 * (as_is.padded - total)
    assert batching.in_batches(df.limit(0), lambda b: b["id"], size, result="long").count() == 0
    with pytest.raises(Exception, match="a value for each row"):
        batching.in_batches(df, lambda b: pd.Series([1]), size, result="long").collect()


def test_buckets_follow_the_data(spark):
    far = spark.range(0, 5000).select((F.col("id") * 1_000_003 + 10**12).alias("id"))
    scaled = tables.scaled(far, "id")
    assert scaled.select(F.floor(F.col("_u") * 4096)).distinct().count() == 4096
    cut = tables.exact_cut(scaled, [F.col("_u"), F.col("id")], 0.8).collect()
    assert sum(r.part == "train" for r in cut) == 4000 and {r.place for r in cut} == set(range(1, 5001))
    assert tables.scaled(far.limit(0), "id").count() == 0


# ---- exact quantiles ------------------------------------------------------------------

def test_quantiles_are_exact_however_few_values_are_kept(spark):
    from statistics import median

    rng = random.Random(9)
    rows = [(rng.lognormvariate(0, 3), rng.choice([1.0, 2.0, 2.0]) if i % 9 else None, float("nan") if i % 50 == 0 else float(i % 700), None) for i in range(6001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    cols = list(zip(*rows, strict=True))
    for few in (10, 300, 1 << 20):
        got = {r["column"]: r.value for r in improve.exact_quantiles(df, ("a", "b", "c", "d"), few=few).collect()}
        for i, c in enumerate("abc"):
            assert got[c] == pytest.approx(median(x for x in cols[i] if x is not None and x == x)), (c, few)
        assert got["d"] is None
    for q, place in ((0.0, 0), (1.0, 6000), (0.25, 1500)):
        assert improve.exact_quantiles(df, ("a",), q, few=10).first().value == pytest.approx(sorted(cols[0])[place])


def test_learning_curve_crosses_blocks_of_blocks(spark):
    keys = [*range(0, 3000, 7), 5 * 10**6, 5 * 10**6 + 1, 9 * 10**9]
    df = spark.createDataFrame([(k, float(k % 101)) for k in keys for _ in range(2)], "k long, v double")
    got = {r.k: r.v_gain for r in improve.learning_curve(df, "k", {"v": F.col("v")}).collect()}
    assert got == {k: None if i == 0 else k % 101 - keys[i - 1] % 101 for i, k in enumerate(keys)}
