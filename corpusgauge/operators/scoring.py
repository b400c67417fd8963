"""Scores of answers: two profiles of text metrics, row by row, no shuffle.

All counts that the metrics need come from sorted arrays: runs of equal tokens
give a text's term counts, and the runs of all texts are sorted together. Looking
back over at most (number of texts - 1) runs finds the same token in another
text, only where the run before has that token. That takes n log n steps a row
and no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions import lexicons as lex
from corpusgauge.functions import text as tx
from corpusgauge.functions.text import bind


def overlaps(texts: list[Column], pairs: list[tuple[int, int]]) -> Column:
    """Struct of counts over token arrays.

    ``n<i>`` distinct tokens, ``q<i>`` sum of squared counts, and for each pair
    i < j ``p<i><j>``: dot product ``d``, shared distinct tokens ``s`` and the sum of
    the smaller counts ``m``.
    """

    def starts(a: Column) -> Column:
        at = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(at, lambda k: (k == 0) | ~F.get(a, k).eqNullSafe(F.get(a, k - 1)))

    def runs(i: int, text: Column) -> Column:
        def made(a: Column) -> Column:
            return bind(starts(a), lambda s: F.transform(s, lambda k, j: F.struct(F.get(a, k).alias("t"), F.lit(i).alias("r"), (F.coalesce(F.get(s, j + 1), F.size(a)) - k).cast("long").alias("n"))))

        return bind(F.sort_array(text), made)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def pair_counts(m: Column) -> Column:
        dot, clipped = (total(F.transform(m, f)) for f in (lambda x: x["n"] * x["o"], lambda x: F.least(x["n"], x["o"])))
        return F.struct(dot.alias("d"), F.size(m).alias("s"), clipped.alias("m"))

    def matches(r: Column, j: int) -> Column:
        """For text j the counts of each token that another text has, and theirs."""
        shared = F.filter(F.when(F.size(r) > 0, F.sequence(F.lit(0), F.size(r) - 1)).otherwise(F.array().cast("array<int>")), lambda k: (F.get(r, k)["r"] == j) & (k > 0) & (F.get(r, k - 1)["t"] == F.get(r, k)["t"]))
        before = [i for i, to in pairs if to == j]

        def own(k: Column) -> Column:
            other = lambda i: F.coalesce(*[F.when((F.get(r, k - d)["r"] == i) & (F.get(r, k - d)["t"] == F.get(r, k)["t"]), F.get(r, k - d)["n"]) for d in range(1, j - i + 1)])
            return F.struct(F.get(r, k)["n"].alias("n"), *[other(i).alias(f"o{i}") for i in before])

        return F.transform(shared, own)

    def counted(j: int):
        return lambda m: F.struct(*[bind(_known(m, i), pair_counts).alias(f"p{i}{j}") for i, to in pairs if to == j])

    def summary(u: Column) -> Column:
        fields = []
        for i in range(len(texts)):
            fields += [F.size(u[f"u{i}"]).alias(f"n{i}"), total(F.transform(u[f"u{i}"], lambda x: x["n"] * x["n"])).alias(f"q{i}")]

        def paired(r: Column) -> Column:
            return F.struct(*[bind(matches(r, j), counted(j)).alias(f"j{j}") for j in dict.fromkeys(j for _, j in pairs)])

        both = bind(F.sort_array(F.concat(*[u[f"u{i}"] for i in range(len(texts))])), paired)
        return bind(both, lambda b: F.struct(*fields, *[b[f"j{j}"][f"p{i}{j}"].alias(f"p{i}{j}") for i, j in pairs]))

    return bind(F.struct(*[runs(i, t).alias(f"u{i}") for i, t in enumerate(texts)]), summary)


def _known(m: Column, i: int) -> Column:
    """The matches that text i has, with its count as ``o``."""
    return F.filter(F.transform(m, lambda x: F.struct(x["n"].alias("n"), x[f"o{i}"].alias("o"))), lambda x: x["o"].isNotNull())


def cosine(o: Column, i: int, j: int) -> Column:
    dot = o[f"p{i}{j}"]["d"].cast("double")
    return F.coalesce(F.try_divide(dot, F.sqrt(o[f"q{i}"].cast("double") * o[f"q{j}"].cast("double"))), F.lit(0.0))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


V1_SCORES = ("answer_relevancy", "contextual_precision", "contextual_recall", "contextual_relevancy", "faithfulness", "toxicity", "hallucination_rate", "overall")


def blend(student_teacher: Column, student_context: Column, teacher: Column, context: Column, beta: float) -> Column:
    """Weighted agreement with what is there of teacher and context."""
    both = clamp(F.lit(beta) * student_teacher + F.lit(1 - beta) * student_context)
    return F.when(~tx.is_missing(teacher) & ~tx.is_missing(context), both).when(~tx.is_missing(teacher), student_teacher).when(~tx.is_missing(context), student_context).otherwise(F.lit(0.0))


def score_v1(df: DataFrame, question: str = "input", teacher: str = "expected_output", context: str = "context", answer: str = "actual_output", beta: float = 0.6) -> DataFrame:
    """``df`` with the scores of profile 1, its flags and lists (H1 to H9)."""
    q, t, c, s = (F.col(x) for x in (question, teacher, context, answer))
    made = overlaps([tx.content_tokens(x) for x in (q, t, c, s)], [(0, 3), (1, 3), (2, 3)])
    df = df.withColumn("_o", made).withColumn("_tok", F.array_distinct(tx.tokens(s))).withColumn("_norm", tx.normalize(s))
    o = F.col("_o")
    words = [w for w in lex.TOXIC_TERMS if " " not in w]
    flags = F.array_intersect(F.array(*[F.lit(w) for w in words]), F.col("_tok"))
    phrases = F.array_compact(F.array(*[F.when(F.col("_norm").contains(w), F.lit(w)) for w in lex.TOXIC_TERMS if " " in w]))
    listed = lambda terms: F.array_sort(F.array_intersect(F.array(*[F.lit(w) for w in dict.fromkeys(terms)]), F.col("_tok")))
    df = df.withColumns({
        "answer_relevancy": clamp(cosine(o, 0, 3)),
        "contextual_relevancy": clamp(cosine(o, 2, 3)),
        "contextual_precision": ratio(o["p23"]["s"], o["n3"]),
        "contextual_recall": ratio(o["p23"]["s"], o["n2"]),
        "faithfulness": blend(clamp(cosine(o, 1, 3)), clamp(cosine(o, 2, 3)), t, c, beta),
        "toxicity_flags": F.array_sort(F.concat(flags, phrases)),
        "sensitive_mentions": listed(lex.SENSITIVE_TERMS),
        "negative_cues": listed(lex.NEGATIVE_TERMS),
    })
    df = df.withColumns({
        "toxicity": F.least(F.lit(1.0), F.size("toxicity_flags") / F.greatest(F.size("_tok"), F.lit(1))),
        "hallucination_rate": clamp(1 - F.col("contextual_precision")),
        "bias_flag": F.when((F.size("sensitive_mentions") > 0) & (F.size("negative_cues") > 0), "harmful").when(F.size("sensitive_mentions") > 0, "mentions_only").otherwise("clean"),
    })
    good = (F.col("answer_relevancy") + F.col("contextual_relevancy") + F.col("contextual_precision") + F.col("contextual_recall") + F.col("faithfulness")) / 5
    bad = (F.col("toxicity") + F.col("hallucination_rate")) / 2
    return df.withColumn("overall", clamp(good * (1 - bad))).drop("_o", "_tok", "_norm")


V2_SCORES = ("structured_correctness", "task_success", "instruction_following", "coverage", "faithfulness", "hallucination", "context_grounding", "conciseness")


def _any_kind(task: Column, cases: list[tuple[str, Column]], other: Column) -> Column:
    out = other
    for name, value in cases:
        out = F.when(task == name, value).otherwise(out)
    return out


SHARED = ("_i", "_t", "_c", "_te", "_twords", "_limit")
OWN = ("_s", "_se", "_words", "_refused", "_lang")


def texts_of(instruction: str, student: str, teacher: str | None, context: str) -> tuple[Column, Column, Column, Column]:
    i, s, c = (F.coalesce(F.col(x), F.lit("")) for x in (instruction, student, context))
    return i, s, F.coalesce(F.col(teacher), F.lit("")) if teacher else F.lit(""), c


def with_shared(df: DataFrame, i: Column, t: Column, c: Column) -> DataFrame:
    """What all answers to an instruction have in common, once per row."""
    df = df.withColumns({"_i": tx.content_tokens(i, 2), "_t": tx.content_tokens(t, 2), "_c": tx.content_tokens(c, 2), "_twords": tx.word_count(t), "_limit": tx.length_limit(i)})
    return df.withColumn("_te", tx.elements(F.col("_t")))


def with_own(df: DataFrame, s: Column, suffix: str, parse_code: bool) -> DataFrame:
    """Tokens and flags of one answer, named with ``suffix``."""
    parts = {"_s": tx.content_tokens(s, 2), "_words": tx.word_count(s), "_refused": tx.is_refusal(s), "_lang": tx.script_language(s)}
    parts |= {f"_{k}": v for k, v in tx.format_flags(s, parse_code).items()}
    df = df.withColumns({k + suffix: v for k, v in parts.items()})
    return df.withColumn("_se" + suffix, tx.elements(F.col("_s" + suffix)))


def score_v2(df: DataFrame, instruction: str = "input", student: str = "student_output", teacher: str | None = "teacher_output", context: str = "context", label: str = "task_label", suffix: str = "", beta: float = 0.6, threshold: float = 0.5, parse_code: bool = False) -> DataFrame:
    """``df`` with the scores of profile 2 (H10 to H20, H27), named with ``suffix``.

    Missing texts count as empty. ``success`` is the threshold rule; ``details``
    holds what the scores were made of; ``overall_60_40`` is the weighted form.
    With ``parse_code`` Python code is parsed in Arrow batches and its keywords
    are whole words, else its brackets are matched.
    """
    i, s, t, c = texts_of(instruction, student, teacher, context)
    df = with_own(with_shared(df, i, t, c), s, suffix, parse_code)
    df = df.withColumn("_o", overlaps([F.col("_i"), F.col("_t"), F.col("_c"), F.col("_s" + suffix)], [(0, 3), (1, 3), (2, 3)]))
    df = judged(df, i, s, t, c, F.coalesce(F.col(label), F.lit(lex.DEFAULT_TASK)), suffix, 3, beta, threshold, parse_code)
    return df.drop("_o", *SHARED)


def judged(df: DataFrame, i: Column, s: Column, t: Column, c: Column, task: Column, suffix: str, at: int, beta: float, threshold: float, parse_code: bool) -> DataFrame:
    """The scores of an answer whose tokens are text ``at`` of ``_o``."""
    o = F.col("_o")
    own = {x + suffix for x in OWN} | {f"_{k}{suffix}" for k in tx.FORMATS}
    col = lambda name: F.col(name + suffix if name + suffix in own else name)
    words = col("_words")

    hint = r"\b(?:def|class|function|return) |=>" if parse_code else "def |class |function |=>|return "
    code = F.when(col("_has_code"), F.when(col("_code_valid"), 1.0).otherwise(0.5)).when(s.rlike(hint), F.when(tx.code_valid(s, parse_code), 1.0).otherwise(0.3)).otherwise(0.2)
    shape = F.lit(0.5) + F.when(col("_has_list"), 0.15).otherwise(0.0) + F.when(col("_has_headers"), 0.15).otherwise(0.0) + F.when(col("_json_valid"), 0.2).otherwise(0.0)
    structured = F.when(task == "technical_code", code).otherwise(F.least(F.lit(1.0), shape))

    cos_i, cos_t, cos_c = (cosine(o, k, at) for k in range(3))
    bonus = _any_kind(task, [
        ("technical_code", F.when(s.contains("```") | s.contains("def ") | s.contains("function"), 0.1).otherwise(0.0)),
        ("math_logic", F.when(s.rlike(r"(?U)\d"), 0.05).otherwise(0.0) + F.when(s.rlike(r"[=+\-*/]"), 0.05).otherwise(0.0)),
        ("classification_analysis", F.when(col("_has_list"), 0.1).otherwise(0.0)),
        ("language_editing", F.when(words >= 20, 0.1).otherwise(0.0)),
        ("creative_generative", F.when(words >= 50, 0.1).otherwise(0.0)),
    ], F.lit(0.0))
    success = F.least(F.lit(1.0), F.lit(0.5) + 0.3 * clamp(cos_i) + F.when(t != "", 0.2 * clamp(cos_t)).otherwise(0.0) + bonus)
    task_success = F.when(tx.is_blank(s), 0.0).when(col("_refused"), 0.1).when(words < 5, 0.2).otherwise(success)

    limit = F.nullif(col("_limit"), F.lit(0))
    length_score = F.when(words > limit * 1.5, 0).when(words > limit * 1.1, 1).otherwise(2)
    shows = {
        "json": s.contains("{") | s.contains("["),
        "list": s.rlike(r"(?mdU)^\s*[\-*•\d]"),
        "table": s.contains("|"),
        "code": s.contains("```") | s.rlike("def |function |class "),
        "bullet": s.rlike(r"(?mdU)^\s*[\-*•]"),
        "numbered": s.rlike(r"(?mdU)^\s*\d+[.)]"),
    }
    low = F.lower(i)
    lacking = F.coalesce(*[F.when(low.contains(k) & ~ok, F.lit(k)) for k, ok in shows.items()])
    wrong = (col("_lang") != "english") & (col("_lang") != "unknown")
    count = lambda lead: F.concat(F.lit(lead), words.cast("string"), F.lit("/"), limit.cast("string"))
    violations = F.array_compact(F.array(
        F.when(col("_refused"), F.lit("refusal_detected")),
        F.when(wrong, F.concat(F.lit("wrong_language:"), col("_lang"))),
        F.when(length_score == 0, count("length_exceeded:")).when(length_score == 1, count("length_slightly_exceeded:")),
        F.when(lacking.isNotNull(), F.concat(F.lit("missing_format:"), lacking)),
    ))
    rubric = length_score + F.when(lacking.isNotNull(), 1).otherwise(2) + F.when(col("_refused"), 0).otherwise(2) + F.when(wrong, 0).otherwise(2)

    covered = F.size(F.array_intersect(col("_te"), col("_se")))
    coverage = F.when(t == "", 0.0).otherwise(ratio(covered, F.size(col("_te")), 1.0))
    precision = ratio(o[f"p2{at}"]["s"], o[f"n{at}"], 1.0)
    hallucination = F.when(c == "", 0.0).otherwise(1 - precision)
    grounding = F.when(c == "", 1.0).otherwise(ratio(o[f"p2{at}"]["s"], o["n2"], 1.0))
    rate = F.try_divide(words, col("_twords"))
    brevity = F.when(t == "", 1.0).when(col("_twords") == 0, F.when(words < 50, 1.0).otherwise(0.5))
    for lo, hi, value in ((0.8, 1.2, 1.0), (0.5, 2.0, 0.8), (0.3, 3.0, 0.6), (0.2, 5.0, 0.4)):
        brevity = brevity.when((rate >= lo) & (rate <= hi), value)
    brevity = brevity.otherwise(0.2)

    close = F.when(c != "", (clamp(cos_i) + clamp(cos_c)) / 2).otherwise(clamp(cos_i))
    passed = ~tx.is_blank(s) & ~col("_refused") & (words >= 5) & (clamp(cos_i) >= 0.1) & (close >= threshold)

    named = {
        "structured_correctness": structured, "task_success": task_success, "instruction_following": rubric / 8, "instruction_rubric": rubric / 4, "coverage": coverage,
        "faithfulness": clamp(blend(cos_t, cos_c, t, c, beta)), "hallucination": hallucination, "context_grounding": grounding, "conciseness": brevity, "success": passed,
    }
    details = F.struct(
        violations.alias("violations"), F.when(t != "", cos_t).otherwise(0.0).alias("teacher_similarity"), F.when(c != "", cos_c).otherwise(0.0).alias("context_similarity"),
        F.when(t != "", covered).otherwise(0).alias("elements_covered"), F.when(t != "", F.size(col("_te"))).otherwise(0).alias("elements_total"),
        F.when(t == "", 1.0).otherwise(F.coalesce(rate, F.lit(0.0))).alias("length_ratio"),
        F.slice(F.array_sort(F.array_except(col("_te"), col("_se"))), 1, 20).alias("missing_elements"),
        F.slice(F.array_sort(F.array_except(F.array_distinct(col("_s")), col("_c"))), 1, 15).alias("ungrounded_terms"),
        F.slice(F.array_sort(F.array_except(F.array_distinct(col("_c")), col("_s"))), 1, 15).alias("unused_context_terms"),
    )
    df = df.withColumns({k + suffix: v for k, v in named.items()} | {"details" + suffix: details})
    g = lambda name: F.col(name + suffix)
    positive = (g("structured_correctness") + g("task_success") + g("instruction_following") + g("coverage") + g("faithfulness") + g("context_grounding") + g("conciseness")) / 7
    core = (g("structured_correctness") + g("task_success") + g("instruction_following")) / 3
    secondary = 0.375 * g("coverage") + 0.25 * g("faithfulness") + 0.25 * (1 - g("hallucination")) + 0.125 * g("context_grounding")
    df = df.withColumns({"overall_score" + suffix: positive * (1 - g("hallucination")), "overall_60_40" + suffix: 0.6 * core + 0.4 * secondary})
    return df.drop(*own)


def error_category(teacher_ok: Column, student_ok: Column) -> Column:
    return F.when(teacher_ok & student_ok, "both_correct").when(teacher_ok, "distillation_loss").when(student_ok, "student_hallucination").otherwise("dataset_issue")


def compare_pair(df: DataFrame, student: str = "student_output", teacher: str = "teacher_output", **names: str) -> DataFrame:
    """Teacher and student of one row: both scored, category and degradation (H21)."""
    both = score_v2(df, student=student, teacher=teacher, suffix="_student", **names)
    both = score_v2(both, student=teacher, teacher=None, suffix="_teacher", **names)
    less = {f"degradation_{k}": F.col(f"{k}_teacher") - F.col(f"{k}_student") for k in ("overall_score", "task_success", "instruction_following")}
    return both.withColumns(less | {"error_category": error_category(F.col("success_teacher"), F.col("success_student")), "student_wins": F.col("overall_score_student") > F.col("overall_score_teacher")})


def compare_models(df: DataFrame, a: str, b: str, reference: str, instruction: str = "input", context: str = "context", label: str = "task_label", beta: float = 0.6, threshold: float = 0.5, parse_code: bool = False) -> DataFrame:
    """Two models against one reference: scores, winner and difference (H22).

    The texts that both share are tokenised once, and one pass over the tokens
    of all five texts gives the counts of both models.
    """
    i, sa, t, c = texts_of(instruction, a, reference, context)
    sb = F.coalesce(F.col(b), F.lit(""))
    both = with_own(with_own(with_shared(df, i, t, c), sa, "_a", parse_code), sb, "_b", parse_code)
    both = both.withColumn("_o", overlaps([F.col(x) for x in ("_i", "_t", "_c", "_s_a", "_s_b")], [(k, j) for j in (3, 4) for k in range(3)]))
    task = F.coalesce(F.col(label), F.lit(lex.DEFAULT_TASK))
    for s, suffix, at in ((sa, "_a", 3), (sb, "_b", 4)):
        both = judged(both, i, s, t, c, task, suffix, at, beta, threshold, parse_code)
    both = both.drop("_o", *SHARED)
    first, second = F.round("overall_score_a", 4), F.round("overall_score_b", 4)
    winner = F.when(first > second, "a").when(second > first, "b").otherwise("tie")
    return both.withColumns({"winner": winner, "difference": first - second, "has_context": ~tx.is_blank(F.col(context))})


LEVELS = ("category", "context", "overall")


def comparison_levels(compared: DataFrame, label: str = "task_label", categories: tuple[str, ...] = lex.TASKS) -> DataFrame:
    """D7, D8 and D9 from one pass over compared rows: ``level, name, n`` with
    wins, mean scores and winner by category, by context and in all.

    One grouping over three sets, so rows are scored and shuffled once. Groups
    that are always reported (the categories, with and without context, all)
    stand with a count of 0 and no means where no row is in them; other
    categories come out beside them.
    """
    means = ("overall_score", "hallucination", "context_grounding", "faithfulness")
    made = compared.withColumnRenamed(label, "_label").groupingSets([["_label"], ["has_context"], []], "_label", "has_context").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n"), *[F.count_if(F.col("winner") == w).alias(x) for w, x in (("a", "wins_a"), ("b", "wins_b"), ("tie", "ties"))],
        *[F.avg(f"{m}_{x}").alias(f"{m}_{x}") for m in means for x in "ab"])
    # the id of a set has a bit for each column that is rolled up
    level = F.when(F.col("_g") == 1, "category").when(F.col("_g") == 2, "context").otherwise("overall")
    name = F.when(F.col("_g") == 1, F.coalesce("_label", F.lit("no label"))).when(F.col("_g") == 2, F.when(F.col("has_context"), "with_context").otherwise("without_context")).otherwise("all")
    made = made.withColumns({"level": level, "name": name}).drop("_g", "_label", "has_context").filter((F.col("level") != "overall") | (F.col("n") > 0))
    fixed = [("category", c) for c in categories] + [("context", "with_context"), ("context", "without_context"), ("overall", "all")]
    both = compared.sparkSession.createDataFrame(fixed, "level string, name string").join(made, ["level", "name"], "full")
    a, b = F.col("overall_score_a"), F.col("overall_score_b")
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "wins_a", "wins_b", "ties")}).withColumn("winner", F.when(a > b, "a").when(b > a, "b").when(a.isNotNull(), "tie"))


def improvement_column(before: Column, after: Column) -> Column:
    return F.bround(F.coalesce(after, F.lit(0.0)) - F.coalesce(before, F.lit(0.0)), 4)
