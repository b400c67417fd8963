"""Text primitives as column expressions: normalising, tokens, flags, prompts.

Two profiles differ in their stop words and in how quotes are stripped. All
expressions work on whole texts; a null counts as an empty text unless said.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgauge.functions import lexicons as lex
from corpusgauge.functions.json_check import holds_json

TOKEN = "[a-z0-9']+"
BLANKS = r"(?U)\s+"
QUOTES = "'\"“”‘’"
ANY = r"[\s\S]"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def is_missing(text: Column) -> Column:
    return F.coalesce(text == "", F.lit(True))


def normalize(text: Column, profile: int = 1) -> Column:
    """Lower case, single blanks; profile 2 also strips quotes at both ends."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if profile == 2:
        low = F.btrim(F.regexp_replace(low, r"(?U)^\s+|\s+$", ""), F.lit(QUOTES))
    return F.trim(F.regexp_replace(low, BLANKS, " "))


def tokens(text: Column) -> Column:
    """All runs of ASCII letters, digits and apostrophes of the lowered text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def stop_words(profile: int) -> tuple[str, ...]:
    return lex.STOPWORDS if profile == 1 else lex.STOPWORDS + lex.MORE_STOPWORDS


def content_pattern(profile: int) -> str:
    """One pattern for tokens but stop words and whole numbers.

    At the start of a token it looks ahead for a whole stop word, by the first
    letter, or a whole number, so a text is read once.
    """
    inside = "[a-z0-9']"
    by_letter: dict[str, list[str]] = {}
    for w in stop_words(profile):
        by_letter.setdefault(w[0], []).append(re.escape(w[1:]))
    stop = "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in by_letter.items())
    return f"(?<!{inside})(?!(?:{stop}|[0-9]++)(?!{inside})){inside}++"


def content_tokens(text: Column, profile: int = 1) -> Column:
    """Tokens but stop words and whole numbers."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(content_pattern(profile)), 0)


def token_set(text: Column, profile: int = 2) -> Column:
    return F.array_distinct(content_tokens(text, profile))


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def elements(content: Column) -> Column:
    """Distinct content tokens and pairs of neighbours, joined by ``_``.

    The tokens are bound, else each pair would make all of them anew.
    """

    def joined(a: Column) -> Column:
        pairs = F.transform(a, lambda t, i: F.concat(t, F.lit("_"), F.get(a, i + 1)))
        return F.array_distinct(F.concat(a, F.filter(pairs, lambda p: p.isNotNull())))

    return bind(content, joined)


def flatten_context(parts: Column) -> Column:
    """An array of context strings as one text; empty ones go."""
    return F.array_join(F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), " ")


def bullet_context(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.concat(F.lit("- "), x)), "\n")


def context_from_json(text: Column) -> Column:
    """``text``, or else ``context``, of each object of a JSON array, by line."""
    objects = F.from_json(text, "array<struct<text:string,context:string>>")
    named = F.transform(objects, lambda o: F.coalesce(F.nullif(o["text"], F.lit("")), o["context"]))
    return F.array_join(F.filter(named, lambda x: x.isNotNull() & (x != "")), "\n")


def any_of(words: tuple[str, ...]) -> str:
    """A pattern that finds any of the substrings, taken literally."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words)


def is_refusal(text: Column) -> Column:
    return normalize(text, 2).rlike(any_of(lex.REFUSAL_PHRASES))


def script_language(text: Column) -> Column:
    """Language by the most frequent script; on ties the first of the list."""
    of = lambda chars: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(chars))
    latin, chinese, arabic, cyrillic = of("[a-zA-Z]"), of(r"[一-鿿]"), of(r"[؀-ۿ]"), of(r"[Ѐ-ӿ]")
    counts = F.struct(latin.alias("l"), chinese.alias("c"), arabic.alias("a"), cyrillic.alias("r"))

    def name(n: Column) -> Column:
        most = F.greatest(n["l"], n["c"], n["a"], n["r"])
        return F.when(most == 0, "unknown").when(n["c"] == most, "chinese").when(n["a"] == most, "arabic").when(n["r"] == most, "russian").otherwise("english")

    return bind(counts, name)


def length_limit(instruction: Column) -> Column:
    """Number of words or sentences that an instruction asks for, else null."""
    low = F.lower(F.coalesce(instruction, F.lit("")))
    patterns = (
        (r"([0-9]+)\s*words?", 1),
        (r"(?:max|maximum|limit|under|less than)\s*([0-9]+)\s*words?", 1),
        (r"([0-9]+)\s*sentences?", 1),
        (r"in\s*([0-9]+)\s*(?:words?|sentences?)", 1),
    )
    found = [F.nullif(F.regexp_extract(low, p, g), F.lit("")) for p, g in patterns]
    return F.coalesce(*found).try_cast("int")


def brackets_match(text: Column) -> Column:
    """Whether round, square and curly brackets close in order."""
    marks = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^()\[\]{}]", ""), "")
    opens, closes = "([{", ")]}"

    def step(stack: Column, mark: Column) -> Column:
        top = F.substring(stack, -1, 1)
        closed = F.when(top == F.translate(mark, closes, opens), F.substring(stack, F.lit(1), F.length(stack) - 1)).otherwise("!")
        return F.when((mark == "") | stack.startswith("!"), stack).when(F.lit(opens).contains(mark), F.concat(stack, mark)).otherwise(closed)

    return F.aggregate(marks, F.lit(""), step) == ""


def code_part(text: Column) -> Column:
    """What stands in the first fence, else the whole text."""
    named, plain = rf"(?iU)```python\s*({ANY}*?)\s*```", rf"(?U)```\s*({ANY}*?)\s*```"
    return F.when(text.rlike(named), F.regexp_extract(text, named, 1)).when(text.rlike(plain), F.regexp_extract(text, plain, 1)).otherwise(text)


def python_parses(code: pd.Series) -> pd.Series:
    """Whether each text is Python source; null and unreadable ones aren't."""

    def parses(source: str | None) -> bool:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(source)
        except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError):
            return False
        return True

    return code.map(parses).astype(bool)


def code_valid(text: Column, parse: bool = True) -> Column:
    """Whether the code that a text shows is well formed: parsed as Python, or
    with ``parse`` off, and for other languages, its brackets match."""
    code = code_part(text)
    return F.pandas_udf(python_parses, "boolean")(code) if parse else brackets_match(code)


FORMATS = ("has_json", "json_valid", "has_code", "code_valid", "has_list", "has_headers", "has_table")


def format_flags(text: Column, parse_code: bool = False) -> dict[str, Column]:
    """Which formats a text shows, and whether JSON and code are well formed.

    Where code is parsed, its keywords are words of their own; else their letters
    count anywhere, so that a digest that ends in ``def`` shows code.
    """
    x = F.coalesce(text, F.lit(""))
    has_json = x.contains("{") | x.contains("[")
    has_code = x.rlike(r"```|\b(?:def|function) ") if parse_code else x.contains("```") | x.contains("def ") | x.contains("function ")
    return {
        "has_json": has_json,
        "json_valid": has_json & holds_json(x),
        "has_code": has_code,
        # texts without a mark of code aren't sent to be parsed
        "code_valid": has_code & code_valid(F.when(has_code, x).otherwise("("), parse_code),
        "has_list": x.rlike(r"(?mdU)^\s*[\-*•]\s+") | x.rlike(r"(?mdU)^\s*\d+[.)]\s+"),
        "has_headers": x.rlike(r"(?mdU)^#+\s+"),
        "has_table": x.rlike(r"\|.*\|"),
    }


def classify_task(instruction: Column, more: Column | None = None) -> Column:
    """First category, in order of priority, one of whose substrings occurs."""
    low = F.lower(F.concat_ws(" ", instruction, more if more is not None else F.lit("")))
    out = F.lit(lex.DEFAULT_TASK)
    for task, words in reversed(lex.TASK_RULES):
        out = F.when(low.rlike(any_of(words)), task).otherwise(out)
    return out


def key_sentences(text: Column, most: int = 4, most_words: int = 40) -> Column:
    """The first sentences of three words or more, each cut to ``most_words``."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), rf"```{ANY}*?```", ""), "`[^`]+`", "")
    parts = F.transform(F.split(plain, "[.!?]+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))

    def cut(s: Column) -> Column:
        words = F.split(s, BLANKS)
        return F.when(F.size(words) > most_words, F.array_join(F.slice(words, 1, most_words), " ")).otherwise(s)

    kept = F.filter(parts, lambda s: F.size(F.split(s, BLANKS)) >= 3)
    return F.slice(F.transform(kept, cut), 1, most)


#: Per kind of task: what its label holds, the lead of the context, how many
#: sentences follow, and the lead and length where there is no sentence.
CONTEXT_KINDS = (
    (("math", "logic"), "Mathematical approach: ", 1, "Teacher reasoning: ", 150),
    (("classification", "analysis"), "Analysis approach: ", 2, "Teacher analysis: ", 150),
    (("creative", "generative"), "Creative guidance: ", 1, "Teacher example: ", 150),
    (("language", "editing"), "Language guidance: ", 1, "Teacher example: ", 150),
    ((), "Teacher knowledge: ", 2, "Teacher reference: ", 200),
)


def derive_context(teacher: Column, label: Column) -> Column:
    """Background for an instruction, taken from the teacher's answer."""
    clean = F.regexp_replace(F.coalesce(teacher, F.lit("")), r"(?U)^\s+|\s+$", "")
    low = F.lower(F.coalesce(F.nullif(label, F.lit("")), F.lit("general")))
    of = lambda lead, sentences, n, other, size: F.when(F.size(sentences) > 0, F.concat(F.lit(lead), F.array_join(F.slice(sentences, 1, n), " "))).otherwise(F.concat(F.lit(other), F.substring(clean, 1, size)))
    found = key_sentences(teacher)
    *kinds, last = CONTEXT_KINDS
    made = of(last[1], found, last[2], last[3], last[4])
    for words, lead, n, other, size in reversed(kinds):
        made = F.when(low.rlike("|".join(words)), of(lead, found, n, other, size)).otherwise(made)
    prose = F.coalesce(teacher, F.lit(""))
    for pattern in (rf"```{ANY}*?```", r"(?U)def \w+\(.*?\):", r"(?U)function \w+\(.*?\)"):
        prose = F.regexp_replace(prose, pattern, "")
    made = F.when(low.rlike("code|technical"), of("Technical approach: ", key_sentences(prose), 2, "Teacher guidance: ", 150)).otherwise(made)
    short = F.when(F.length(clean) > 5, F.concat(F.lit("Teacher answer: "), clean))

    def fit(x: Column) -> Column:
        return F.when(F.length(x) < 15, None).when(F.length(x) > 500, F.concat(F.substring(x, 1, 497), F.lit("..."))).otherwise(x)

    whole = bind(F.trim(F.regexp_replace(made, BLANKS, " ")), fit)
    return F.when(is_missing(teacher), None).when(F.length(clean) < 20, short).otherwise(whole)


#: Prompt layouts; each names the columns that it uses.
PROMPTS = {
    "response": "### Instruction:\n{instruction}\n\n### Context:\n{context}\n\n### Response:\n",
    "question": "Context: {context}\n\nQuestion: {instruction}\n\nAnswer:",
    "chat": "Human: {instruction}\n{context}\nAssistant:",
    "plain": "{instruction}",
}


def build_prompt(layout: str, **columns: Column) -> Column:
    """A prompt with the columns in their places (null: empty)."""
    parts = re.split(r"\{(\w+)\}", PROMPTS[layout])
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(columns[p], F.lit("")) for i, p in enumerate(parts) if p])


def extract_response(text: Column, marker: str, end: str | None = None) -> Column:
    """Text after the last marker, up to the end mark, trimmed."""
    tail = F.substring_index(text, marker, -1)
    return F.regexp_replace(F.substring_index(tail, end, 1) if end else tail, r"(?U)^\s+|\s+$", "")


def cut_suffix(text: Column, old: str = " (Manual Test #", new: str = " (Question #") -> Column:
    """Rewrites a test suffix and cuts the text before it."""
    return F.substring_index(F.replace(text, F.lit(old), F.lit(new)), new, 1)
