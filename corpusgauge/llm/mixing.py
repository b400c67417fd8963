"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of the token budget by its weight, at most
``max_epochs`` times its own size; what a full source leaves is dealt again
among the others. A source's documents first enter as many whole epochs as the
target holds. The rest of the target is drawn without replacement: a document
of weight w gets the key -ln(u) / w with u a hash of its id, and the documents
of the smallest keys enter until their sizes reach the rest.

No source is sorted as a whole. Sizes are summed by source and bucket of the
key, the bucket in which the rest ends is found in these sums, documents of the
buckets before it enter, and only that bucket is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.session import settle

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a whole text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Sampling weight of a text: 1 without symbols, falling to 0.05 with them."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * F.coalesce(F.try_divide(symbols, n), F.lit(0.0)))


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from the first 52 bits of the md5 of seed and key."""
    hexes = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(hexes, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, source: str, share: float, cycle: tuple[float, ...], max_epochs: int) -> DataFrame:
    """Target of each source from ``sizes(source, source_size)``.

    Sources in code point order, null last, weigh ``cycle``, repeated. A source
    is full when the level (target by weight 1) passes max_epochs * size /
    weight, so the full ones come first in the order of that ratio, and one
    running sum over the sources' table gives the level at which the budget is
    spent. That table has one row for each source; documents are not in it.
    """
    w = Window.orderBy(F.col(source).asc_nulls_last())
    weighed = sizes.withColumn("_i", F.row_number().over(w) - 1)
    weighed = weighed.withColumn("_w", F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (F.col("_i") % len(cycle) + 1).cast("int")))
    weighed = weighed.withColumn("_cap", F.lit(float(max_epochs)) * F.col("source_size"))
    ratio = F.col("_cap") / F.col("_w")
    order = Window.orderBy(ratio.asc(), F.col("_i").asc())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    level = weighed.withColumn("_budget", F.lit(share) * F.sum("source_size").over(all_rows))
    level = level.withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    # the first source that isn't full at the level of those from it on
    level = level.withColumn("_first", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(ratio.alias("r"), "_i", "_level"))).over(all_rows))
    is_full = F.col("_first").isNull() | (ratio < F.col("_first.r")) | ((ratio == F.col("_first.r")) & (F.col("_i") < F.col("_first._i")))
    return level.select(source, "source_size", F.when(is_full, F.col("_cap")).otherwise(F.col("_first._level") * F.col("_w")).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: float = 1.5,
    cycle: tuple[float, ...] = (5.0, 2.0, 1.0),
    max_epochs: int = 2,
    seed: int = 0,
    buckets: int = 4096,
    keep_text: bool = False,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``epochs`` and ``taken``.

    Texts are read once, and what the steps need of them is written as a table
    in the shared folder; with ``keep_text`` they are read for each step instead.

    ``taken`` counts the words the mix takes of the document, repeats included
    (size times ``epochs``). A null text has size 0, a null source is a source
    of its own, repeated ids are ordered by size and text hash and taken one by
    one, an empty table gives an empty result. Columns named like a result are
    replaced, others are kept. Equal input gives equal output in every run.
    """
    own = ["size", "source_size", "target", "epochs", "taken"]
    sized = docs.drop(*own).withColumns({
        "size": word_count(F.col(text)),
        "_key": -F.log(uniform(F.col(id_col), seed)) / quality_weight(F.col(text)),
        "_tie": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
    })
    sized = sized.withColumn("_bucket", F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * buckets).cast("int"))
    sized = sized if keep_text else settle(sized.drop(text))
    return take(sized, id_col, source, share, cycle, max_epochs)


#: Goals of up to so many sources are sent to all tasks.
FEW_SOURCES = 1 << 16


def with_goal(sized: DataFrame, goal: DataFrame, source: str, few: int = FEW_SOURCES, salts: int = 64) -> DataFrame:
    """Each document with its source's row of ``goal`` (``_source``, ...).

    Few sources are broadcast; where there are more, every source's row goes to
    ``salts`` tasks and its documents are dealt over them, so no source is whole
    in one task.
    """
    same = F.col(source).eqNullSafe(F.col("_source"))
    if goal.count() <= few:
        return sized.join(F.broadcast(goal), same, "left").drop("_source")
    dealt = sized.withColumn("_salt", F.pmod(F.xxhash64("_key", "_tie"), F.lit(salts)).cast("int"))
    copies = goal.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, same & (F.col("_salt") == F.col("_copy")), "left").drop("_source", "_salt", "_copy")


def take(sized: DataFrame, id_col: str, source: str, share: float, cycle: tuple[float, ...], max_epochs: int) -> DataFrame:
    by_bucket = sized.groupBy(source, "_bucket").agg(F.sum("size").alias("_in"))
    goal = targets(by_bucket.groupBy(source).agg(F.sum("_in").alias("source_size")), source, share, cycle, max_epochs)
    goal = goal.withColumn("_whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int"))
    goal = goal.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    renamed = goal.withColumnRenamed(source, "_source")
    run = Window.partitionBy(source).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = by_bucket.withColumn("_before", F.coalesce(F.sum("_in").over(run), F.lit(0)))
    cuts = cuts.join(renamed, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    # the bucket in which the rest ends, or none if all enter
    ends = cuts.filter((F.col("_before") + F.col("_in")) > F.col("_rest")).groupBy(source).agg(F.min(F.struct("_bucket", "_before")).alias("_cut"))
    goal = renamed.join(ends.withColumnRenamed(source, "_source2"), F.col("_source").eqNullSafe(F.col("_source2")), "left").drop("_source2")
    joined = with_goal(sized, settle(goal), source)
    here = F.col("_bucket") == F.col("_cut._bucket")
    at = Window.partitionBy(source, "_bucket").orderBy("_key", id_col, "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    whole = joined.filter(~F.coalesce(here, F.lit(False))).withColumn("_in_rest", F.col("_cut").isNull() | (F.col("_bucket") < F.col("_cut._bucket")))
    cut = joined.filter(here).withColumn("_run", F.col("_cut._before") + F.coalesce(F.sum("size").over(at), F.lit(0)))
    cut = cut.withColumn("_in_rest", F.col("_run") + F.col("size") / 2 <= F.col("_rest")).drop("_run")
    mixed = whole.unionByName(cut)
    mixed = mixed.withColumn("epochs", F.col("_whole") + F.when(F.col("_in_rest") & (F.col("_rest") > 0), 1).otherwise(0))
    mixed = mixed.withColumn("taken", (F.col("size") * F.col("epochs")).cast("long"))
    return mixed.drop("_key", "_tie", "_bucket", "_whole", "_rest", "_cut", "_in_rest")
