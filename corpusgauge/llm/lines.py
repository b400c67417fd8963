"""Line deduplication by a log-template tree, in DataFrame operations only.

A line's words that hold a digit or ``@`` are masked as ``<*>``. The tree has a
fixed depth: lines with equally many words whose first three (masked) words are
the same fall into one leaf. In a leaf the most frequent masked line is the
model; lines that agree with it in most places form one template, in which the
places where any of them differs are generalised to ``<*>``. Another line is a
template of its own. A template that recurs in ``min_docs`` documents is
boilerplate: its first line stays, all others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.text import bind
from corpusgauge.session import settle

#: Blanks of a line but the space, and what a word can't hold.
BLANK = r"[ \t\r\f\x0B]"
NOT_SPACE = r"[\t\r\f\x0B]"
MASK = "<*>"


def masked(text: Column) -> Column:
    """A whole text with runs of blanks as one space and variable words masked.

    Newlines stay. Single spaces aren't matched, and words are only tried from
    their start, so both patterns are linear.
    """
    plain = F.regexp_replace(text, rf"{NOT_SPACE}{BLANK}*| {BLANK}+", " ")
    return F.regexp_replace(plain, r"(?<![^ \n])[^ \n0-9@]*[0-9@][^ \n]*", MASK)


def line_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, th, pos, masked, n_tokens, lead``: a row for each line.

    The text is masked before it is split: what a generator makes is evaluated
    once, however many columns are taken from it.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), F.col(text).alias("_text"))
    lines = keyed.select("id", "th", F.posexplode(F.transform(F.split(masked(F.col("_text")), "\n"), lambda x: F.trim(x))).alias("pos", "masked"))
    spaces = F.length("masked") - F.length(F.replace("masked", F.lit(" ")))
    return lines.filter("masked != ''").withColumns({"n_tokens": spaces + 1, "lead": F.substring_index("masked", " ", 3)})


def same_places(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def is_like(equal: Column, n: Column, percent: int, least: int) -> Column:
    return (equal == n) | ((equal >= least) & (100 * equal >= percent * n))


def templates(rows: DataFrame, percent: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Template of each distinct masked line, and the templates' spelling.

    First: ``n_tokens, lead, masked, model``, ``model`` null for a line that is
    a template of its own; second: ``n_tokens, lead, model, template``.
    """
    leaf = ["n_tokens", "lead"]
    lines = settle(rows.groupBy(*leaf, "masked").agg(F.count("*").alias("n")))
    models = lines.groupBy(*leaf).agg(F.max_by("masked", F.struct("n", "masked")).alias("model"))
    both = lines.join(models, leaf).withColumns({"_line": F.split("masked", " "), "_model": F.split("model", " ")})
    like = is_like(same_places("_line", "_model"), F.col("n_tokens"), percent, least)
    placed = both.select(*leaf, "masked", F.when(like, F.col("model")).alias("model"), "_line", "_model")
    vary = placed.filter("model is not null and masked != model").select(*leaf, "model", "_model", F.posexplode(F.zip_with("_line", "_model", lambda x, y: x != y)).alias("place", "differs")).filter("differs")
    spots = vary.groupBy(*leaf, "model").agg(F.collect_set("place").alias("places"))
    named = models.join(spots, [*leaf, "model"], "left")
    spelt = F.transform(F.split("model", " "), lambda t, i: F.when(F.array_contains(F.coalesce("places", F.array().cast("array<int>")), i), MASK).otherwise(t))
    return placed.drop("_line", "_model"), named.select(*leaf, "model", F.array_join(spelt, " ").alias("template"))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = 5, min_tokens: int = 3, percent: int = 75, least: int = 5, long_words: int | None = None) -> DataFrame:
    """``id, th, pos, n_tokens, t1, t2, n_docs, is_first`` of lines whose
    template recurs in ``min_docs`` documents.

    With ``long_words`` two documents are enough for a template whose model has
    as many words that aren't masked.
    """
    enough, least_rows = F.col("n_docs") >= min_docs, F.col("_n") >= min_docs
    if long_words is not None:
        enough |= (F.col("n_docs") >= 2) & (F.col("plain") >= long_words)
        least_rows |= (F.col("_n") >= 2) & (F.col("n_tokens") >= long_words)
    rows = line_rows(docs, id_col, text).filter(F.col("n_tokens") >= min_tokens)
    busy = rows.groupBy("n_tokens", "lead").agg(F.count("*").alias("_n")).filter(least_rows).drop("_n")
    rows = settle(rows.join(busy, ["n_tokens", "lead"], "left_semi"))
    placed, _ = templates(rows, percent, least)
    own = rows.join(placed, ["n_tokens", "lead", "masked"]).withColumn("own", F.coalesce("model", "masked"))
    # a template is its leaf and its spelling: hashed, so that texts aren't shuffled again
    plain = F.size(F.filter(F.split("own", " "), lambda x: x != MASK))
    kept = [] if long_words is None else [plain.alias("plain")]
    own = settle(own.select("id", "th", "pos", "n_tokens", *kept, F.xxhash64("n_tokens", "lead", "own").alias("t1"), F.hash("own", "lead").alias("t2")))
    alike = [F.max("plain").alias("plain")] if kept else []
    per_doc = own.groupBy("t1", "t2", "id", "th").agg(F.min("pos").alias("pos"), *alike)
    often = per_doc.groupBy("t1", "t2").agg(F.count("*").alias("n_docs"), F.min(F.struct("id", "th", "pos")).alias("first"), *alike).filter(enough).drop("plain")
    return own.drop("plain").join(often, ["t1", "t2"]).withColumn("is_first", F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")) & (F.col("pos") == F.col("first.pos")))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the lines whose template recurs, but for the first line
    of each template by (id, text hash, place).

    Adds ``n_lines``, ``n_dropped`` and ``emptied`` (it had words, and none is
    left). Lines of fewer than ``min_tokens`` words are never dropped. A null
    text stays null with no lines; an empty text has one empty line; equal rows
    are one document, so a first line stays in each; repeated ids are told apart
    by the text's hash. An empty table gives an empty result; columns named like
    a result are replaced, others are kept.
    """
    docs = docs.drop("n_lines", "n_dropped", "emptied")
    gone = recurring_lines(docs, id_col, text, **options).filter(~F.col("is_first")).groupBy("id", "th").agg(F.collect_set("pos").alias("_gone")).withColumnsRenamed({"id": "_id", "th": "_th"})
    th = F.xxhash64(F.coalesce(text, F.lit("")))
    both = docs.withColumn("_own", th).join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_th")), "left")
    lines = F.split(text, "\n")
    n = F.coalesce(F.size(lines), F.lit(0))
    # the lines are split once, not for each place
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone"))
    left = bind(lines, lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n"))
    cut = F.col("_gone").isNotNull()
    out = both.withColumns({"n_lines": F.when(F.col(text).isNull(), 0).otherwise(n), "n_dropped": F.when(cut, F.size("_gone")).otherwise(0), text: F.when(cut, left).otherwise(F.col(text))})
    out = out.withColumn("emptied", F.coalesce(cut & ~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return out.drop("_gone", "_id", "_th", "_own")
