"""Whether a text is one JSON value, decided by expressions alone.

The text is rewritten to a string of marks, one for each token: ``S`` for a
string, ``V`` for any other value, and the brackets, colons and commas. Every
pattern steps over single characters, so long texts need no deep recursion. A
stack automaton then reads the marks.

What counts as JSON: the usual grammar, any depth, repeated keys, and the values
NaN, Infinity and -Infinity; no control characters or unknown escapes in
strings, nothing behind the value. White space is blank, tab, CR and LF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ESCAPE = r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})'
STRING = r'"[^"\\\x00-\x1F]*+"'
LITERAL = "true|false|null|NaN|-?Infinity"
NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"

#: Characters that values other than strings, brackets and white space consist of.
OUTSIDE = r"^[ \t\r\n{}\[\],:0-9+\-.eEtrufalsnNIity]*+\z"
ANY = r"[\s\S]"

#: States of the automaton: what may come next.
VALUE, AFTER, KEY_OR_END, KEY, COLON, VALUE_OR_END, BAD = range(7)


def marks(text: Column) -> Column:
    """The text's tokens, one character each; null if a token is none."""
    plain = F.regexp_replace(text, ESCAPE, "x")
    # what is left outside of strings has no letter S or V
    sound = F.regexp_replace(plain, STRING, "").rlike(OUTSIDE)
    made = plain
    for pattern, mark in ((STRING, "S"), (LITERAL, "V"), (NUMBER, "V"), (r"[ \t\r\n]++", "")):
        made = F.regexp_replace(made, pattern, mark)
    return F.when(sound & made.rlike(r"^[SV{}\[\],:]++\z"), made)


def accepts(made: Column) -> Column:
    """Whether marks are one value; the stack holds the open brackets."""

    def step(acc: Column, mark: Column) -> Column:
        stack, state = acc["stack"], acc["state"]
        top = F.substring(stack, -1, 1)
        to = lambda s, k: F.struct(k.alias("stack"), F.lit(s).alias("state"))
        is_value = state.isin(VALUE, VALUE_OR_END)
        pop = F.substring(stack, F.lit(1), F.length(stack) - 1)
        return (
            F.when(mark.isin("S", "V") & is_value, to(AFTER, stack))
            .when((mark == "S") & state.isin(KEY, KEY_OR_END), to(COLON, stack))
            .when((mark == ":") & (state == COLON), to(VALUE, stack))
            .when((mark == ",") & (state == AFTER) & (top == "{"), to(KEY, stack))
            .when((mark == ",") & (state == AFTER) & (top == "["), to(VALUE, stack))
            .when((mark == "{") & is_value, to(KEY_OR_END, F.concat(stack, F.lit("{"))))
            .when((mark == "[") & is_value, to(VALUE_OR_END, F.concat(stack, F.lit("["))))
            .when((mark == "}") & (top == "{") & state.isin(AFTER, KEY_OR_END), to(AFTER, pop))
            .when((mark == "]") & (top == "[") & state.isin(AFTER, VALUE_OR_END), to(AFTER, pop))
            .otherwise(to(BAD, F.lit("")))
        )

    start = F.struct(F.lit("").alias("stack"), F.lit(VALUE).alias("state"))
    return F.aggregate(F.split(made, ""), start, step, lambda acc: (acc["state"] == AFTER) & (acc["stack"] == ""))


def is_json_value(text: Column) -> Column:
    """False for null and empty texts."""
    return F.coalesce(accepts(marks(text)), F.lit(False))


def holds_json(text: Column) -> Column:
    """Whether the trimmed text is a JSON value, or else the part that the first
    matching pattern finds: a fence named json, any fence, from the first ``{``
    to the last ``}``, from the first ``[`` to the last ``]``."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+\z", "")
    parts = ((rf"(?U)```json\s*({ANY}*?)\s*```", 1), (rf"(?U)```\s*({ANY}*?)\s*```", 1), (rf"(\{{{ANY}*\}})", 1), (rf"(\[{ANY}*\])", 1))
    inner = F.lit(None).cast("string")
    for pattern, group in reversed(parts):
        inner = F.when(plain.rlike(pattern), F.regexp_extract(plain, pattern, group)).otherwise(inner)
    return is_json_value(plain) | is_json_value(inner)
