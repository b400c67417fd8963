"""Reply trees to formatted conversations.

Messages name their parents. Self-joins with doubled steps (parent, then
grandparent, then the ancestor four up, ...) give every message its depth, its
root and the summed score of its path, in about log2(depth) joins. A leaf
stands for one root-to-leaf path; the leaves of a tree are ranked by the mean
score of their path, and the chosen paths are spelt out by the same doubled
steps, downwards in distance: each join doubles the part of the path that is
known. Each chosen path is formatted as one conversation.

Format of a turn: ``### role: text</turn>`` and a newline. Inside roles and
texts a backslash is written ``\\\\``, ``<`` is ``\\l``, ``#`` is ``\\h`` and,
in roles, ``:`` is ``\\c``; so the marks of a turn never occur within one and
the format can be read back whatever the texts hold.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.session import Rounds, settle

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
BLOCK = 64


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


_PLAIN = {"\\\\": "\\", "\\l": "<", "\\h": "#", "\\c": ":"}


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lhc]", lambda m: _PLAIN[m[0]], text) if "\\" in text else text


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for turn in formatted.split(CLOSE)[:-1]:
        role, _, text = turn[len(OPEN) :].partition(MIDDLE)
        turns.append((unescape(role), unescape(text)))
    return turns


def chain_parents(rows: DataFrame, tree: str, order: str, tie: list[str]) -> DataFrame:
    """Flat turns as a tree: ``msg`` is a row's place in its conversation by
    ``order`` (null first, then ``tie``), ``parent`` the place before it.

    Places are counted inside blocks of ``BLOCK`` order values and added to the
    sizes of earlier blocks, so that a very long conversation isn't sorted in
    one task.
    """
    block = F.coalesce(F.floor(F.col(order) / BLOCK).cast("long"), F.lit(-(2**62)))
    rows = rows.withColumn("_block", block)
    sizes = rows.groupBy(tree, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(tree).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col(tree).alias("_tree"), F.col("_block").alias("_b"), "_before")
    place = F.row_number().over(Window.partitionBy(tree, "_block").orderBy(F.col(order).asc_nulls_first(), *tie)) - 1
    placed = rows.withColumn("_place", place).join(sizes, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_block") == F.col("_b")))
    msg = F.col("_place") + F.col("_before")
    return placed.withColumn("msg", msg.cast("long")).withColumn("parent", F.when(F.col("msg") > 0, F.col("msg") - 1)).drop("_block", "_place", "_before", "_tree", "_b")


def best_paths(messages: DataFrame, n_paths: int = 1) -> DataFrame:
    """The messages of each tree's ``n_paths`` best root-to-leaf paths.

    Takes ``tree, msg, parent, score``; returns ``tree, leaf, path_rank, depth,
    msg``. A message whose parent is null or missing is a root. Paths are ranked
    by mean score (null: 0), ties by the smaller leaf. Messages on a cycle have
    no root and are on no path. A repeated (tree, msg) is one message with its
    smallest parent and largest score. A null tree is a tree.
    """
    # each message once, and a row for the one it answers, which so is no leaf
    kind = messages.schema["msg"].dataType
    nodes = messages.groupBy("tree", "msg").agg(F.min("parent").try_cast(kind).alias("up"), F.max(F.coalesce("score", F.lit(0.0))).cast("double").alias("total"))
    own = F.struct("tree", "msg", "up", "total", F.lit(True).alias("leaf"))
    answered = F.struct("tree", F.col("up").alias("msg"), F.lit(None).cast(kind).alias("up"), F.lit(None).cast("double").alias("total"), F.lit(False).alias("leaf"))
    rows = nodes.select(F.inline(F.array(own, answered))).filter("msg is not null")
    first = rows.groupBy("tree", "msg").agg(F.max("up").alias("up"), F.max("total").alias("total"), F.min("leaf").alias("leaf")).filter("total is not null")
    # up: the ancestor 2**round steps above (null: beyond the root), the number
    # of messages below it and their score; only messages as deep as that are in
    # a round, the others have reached their root. The left join ends a path
    # whose next parent is missing
    jumps = Rounds(messages.sparkSession)
    n = jumps.add(first.withColumn("n", F.lit(1).cast("long")))
    same = F.col("tree").eqNullSafe(F.col("t2"))
    live = n
    while live and jumps.n <= n.bit_length():
        now = F.col("round") == jumps.n - 1
        below = jumps.read().filter(now & F.col("up").isNotNull()).drop("round")
        above = jumps.read().filter(now | F.col("up").isNull()).select(F.col("tree").alias("t2"), F.col("msg").alias("m2"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("total").alias("sum2"))
        both = below.join(above, same & (F.col("up") == F.col("m2")), "left")
        live = jumps.add(both.select("tree", "msg", F.col("up2").alias("up"), (F.col("total") + F.coalesce("sum2", F.lit(0.0))).alias("total"), "leaf", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")), F.count("up"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy((F.col("total") / F.col("n")).desc(), "msg"))
    chosen = jumps.read().filter("leaf and up is null").withColumn("path_rank", rank).filter(F.col("path_rank") <= n_paths)
    # down: each round adds what lies 2**round steps above the part known so far
    path = Rounds(messages.sparkSession)
    found = path.add(chosen.select("tree", F.col("msg").alias("leaf"), "path_rank", (F.col("n") - 1).alias("depth"), "msg"))
    while found and path.n < jumps.n:
        k = path.n - 1
        up = jumps.read().filter((F.col("round") == k) & F.col("up").isNotNull()).select(F.col("tree").alias("t2"), F.col("msg").alias("m2"), F.col("up").alias("to"))
        deep = path.read().filter(F.col("depth") >= 2**k)
        found = path.add(deep.join(up, same & (F.col("msg") == F.col("m2"))).select("tree", "leaf", "path_rank", (F.col("depth") - 2**k).alias("depth"), F.col("to").alias("msg")))
    return path.read().drop("round")


ASSEMBLED = "formatted string, loss_spans array<struct<start:long,end:long>>"
DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def assemble(blocks: pd.Series) -> pd.DataFrame:
    """Turns, in blocks, to one text and the spans that are learnt from."""
    texts, spans = [], []
    for row in blocks:
        parts, at, found = [], 0, []
        for block in sorted(row, key=lambda b: b["block"]):
            for turn in block["turns"]:
                head = OPEN + turn["role"] + MIDDLE
                body = turn["text"]
                if turn["learn"]:
                    found.append({"start": at + len(head), "end": at + len(head) + len(body)})
                parts += [head, body, CLOSE]
                at += len(head) + len(body) + len(CLOSE)
        texts.append("".join(parts))
        spans.append(found)
    return pd.DataFrame({"formatted": texts, "loss_spans": spans})


def format_paths(path: DataFrame, messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One formatted conversation for each chosen path.

    ``messages`` has ``tree, msg, role, text``; null roles and texts are empty.
    ``loss_spans`` are the half-open code point ranges of ``formatted`` that hold
    the (escaped) texts of ``learn_role``. Turns are first gathered in blocks of
    64, so that a conversation's task reads blocks, not single rows.
    """
    one = messages.groupBy("tree", "msg").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("said"))
    right = one.withColumnsRenamed({"tree": "t2", "msg": "m2"})
    turns = path.join(right, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("msg") == F.col("m2")))
    turn = F.struct("depth", escape(F.col("said.role"), role=True).alias("role"), escape(F.col("said.text")).alias("text"), (F.col("said.role") == learn_role).alias("learn"))
    blocks = turns.groupBy("tree", "leaf", "path_rank", F.floor(F.col("depth") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = blocks.groupBy("tree", "leaf", "path_rank").agg(F.sort_array(F.collect_list(F.struct("block", "turns"))).alias("blocks"))
    return whole.withColumn("made", F.pandas_udf(assemble, ASSEMBLED)("blocks")).select("tree", "leaf", "path_rank", "made.formatted", "made.loss_spans")


def format_trees(messages: DataFrame, n_paths: int = 1, learn_role: str = "assistant") -> DataFrame:
    """Best paths of reply trees as conversations: see the parts for the rules.

    Takes ``tree, msg, parent, role, text, score``; other columns are ignored.
    An empty table gives an empty result.
    """
    return format_paths(best_paths(messages, n_paths), messages, learn_role)


def format_flat(rows: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", learn_role: str = "assistant") -> DataFrame:
    """Conversations of rows by turn: each is a tree of one path."""
    clean = rows.select(F.col(tree).alias("tree"), F.col(order).alias("_order"), F.col(role).alias("role"), F.col(text).alias("text"))
    placed = settle(chain_parents(clean, "tree", "_order", ["role", "text"])).withColumn("score", F.lit(0.0))
    return format_trees(placed, 1, learn_role)


def digests(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """What the formatted texts hold, read back from them."""
    rows = []
    for text, found in zip(formatted, spans, strict=True):
        turns = read_back(text)
        whole = "".join(f"{role}\n{said}\n" for role, said in turns)
        learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in found)
        rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
