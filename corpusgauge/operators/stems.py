"""English stems by suffix rewriting in stages, for a table of distinct tokens.

Porter's algorithm with the usual extensions (short words on -ies and -ied,
-fulli, -logi, a few irregular forms). Every stage is an expression over the
token and its pattern of vowels (v) and consonants (c); the pattern of a stem is
the start of its word's pattern, so the measure of any stem is the number of
``vc`` in it. Tokens of up to three letters keep their form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the rules of the algorithm -----------------------------------

IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}

STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

# ---------------------------------------------------------------------------------

#: Runs of the letter y are read letter by letter so far.
Y_ROUNDS = 8

#: Rules: suffix, replacement, condition on (stem, its pattern).
Rule = tuple[str, str, Callable[[Column, Column], Column] | None]


def pattern(word: Column) -> Column:
    """v for vowels, c for all else; y is a vowel behind a consonant."""
    made = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "[^aeiouy]", "c"), "[aeiou]", "v"), "^y", "c")
    for _ in range(Y_ROUNDS):
        made = F.regexp_replace(F.regexp_replace(made, "(?<=c)y", "v"), "(?<=v)y", "c")
    return F.replace(made, F.lit("y"), F.lit("c"))


def measure(shape: Column) -> Column:
    return F.regexp_count(shape, F.lit("vc"))


def without(word: Column, suffix: str) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - len(suffix)) if suffix else word


def ends_cvc(stem: Column, shape: Column) -> Column:
    return (shape.endswith("cvc") & ~stem.rlike("[wxy]$")) | (shape == "vc")


def first_rule(word: Column, shape: Column, rules: list[Rule], otherwise: Column | None = None) -> Column:
    """The first rule whose suffix the word has decides, whether it applies or not."""
    out = word if otherwise is None else otherwise
    for suffix, replacement, holds in reversed(rules):
        stem = without(word, suffix)
        made = F.concat(stem, F.lit(replacement))
        if holds is not None:
            made = F.when(holds(stem, without(shape, suffix)), made).otherwise(word)
        out = F.when(word.endswith(suffix), made).otherwise(out) if suffix else made
    return out


def positive(_: Column, shape: Column) -> Column:
    return measure(shape) > 0


def plural(w: Column, p: Column) -> Column:
    short = F.when(w.endswith("ies") & (F.length(w) == 4), without(w, "s"))
    return F.coalesce(short, first_rule(w, p, [("sses", "ss", None), ("ies", "i", None), ("ss", "ss", None), ("s", "", None)]))


def cut_past(w: Column, p: Column) -> Column:
    """The word before -ed and -ing, where that has a vowel; else null."""
    out = F.lit(None).cast("string")
    for suffix in ("ing", "ed"):
        out = F.when(w.endswith(suffix) & without(p, suffix).contains("v"), without(w, suffix)).otherwise(out)
    return out


def past(w: Column, p: Column) -> Column:
    ied = F.when(w.endswith("ied"), F.when(F.length(w) == 4, without(w, "d")).otherwise(without(w, "ed")))
    eed = F.when(w.endswith("eed"), F.when(positive(w, without(p, "eed")), without(w, "d")).otherwise(w))
    cut = cut_past(w, p)
    shape = F.substring(p, F.lit(1), F.length(cut))
    twice = (F.substring(cut, -1, 1) == F.substring(cut, -2, 1)) & (F.length(cut) >= 2) & shape.endswith("c")
    # the last two letters of a stem decide first, then its form
    tail = F.when(twice, F.when(cut.rlike("[lsz]$"), cut).otherwise(without(cut, "x"))).otherwise(first_rule(cut, shape, [("", "e", lambda s, q: (measure(q) == 1) & ends_cvc(s, q))]))
    return F.coalesce(ied, eed, first_rule(cut, shape, [("at", "ate", None), ("bl", "ble", None), ("iz", "ize", None)], tail), w)


def final_y(w: Column, p: Column) -> Column:
    return first_rule(w, p, [("y", "i", lambda s, q: (F.length(s) > 1) & q.endswith("c"))])


def step_2(w: Column, p: Column) -> Column:
    logi: Rule = ("logi", "log", lambda s, q: measure(F.substring(p, F.lit(1), F.length(w) - 3)) > 0)
    return first_rule(w, p, [*[(a, b, positive) for a, b in STEP_2], logi])


def before_step_2(w: Column, p: Column) -> Column:
    """-alli becomes -al before the other suffixes are looked at."""
    return F.when(w.endswith("alli") & positive(w, without(p, "alli")), without(w, "li")).otherwise(w)


def step_3(w: Column, p: Column) -> Column:
    return first_rule(w, p, [(a, b, positive) for a, b in STEP_3])


def step_4(w: Column, p: Column) -> Column:
    long = lambda s, q: measure(q) > 1
    ion = lambda s, q: (measure(q) > 1) & s.rlike("[st]$")
    return first_rule(w, p, [(a, "", ion if a == "ion" else long) for a in STEP_4])


def final_e(w: Column, p: Column) -> Column:
    s, q = without(w, "e"), without(p, "e")
    return F.when(w.endswith("e") & ((measure(q) > 1) | ((measure(q) == 1) & ~ends_cvc(s, q))), s).otherwise(w)


def final_ll(w: Column, p: Column) -> Column:
    return F.when(w.endswith("ll") & (measure(without(p, "l")) > 1), without(w, "l")).otherwise(w)


STAGES = (plural, past, final_y, before_step_2, step_2, step_3, step_4, final_e, final_ll)


def stems(tokens: DataFrame, token: str = "token") -> DataFrame:
    """``token, stem`` for each distinct token of lower-case letters and digits."""
    made = tokens.select(token).distinct().withColumn("stem", F.col(token))
    for stage in STAGES:
        made = made.withColumn("_p", pattern(F.col("stem"))).withColumn("stem", stage(F.col("stem"), F.col("_p"))).drop("_p")
    known = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    short = F.length(token) <= 3
    return made.withColumn("stem", F.when(short, F.col(token)).otherwise(F.coalesce(F.try_element_at(known, F.col(token)), F.col("stem"))))
