"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.session import settle


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``links(a, b)``: the smallest node reachable.

    Each round takes the smallest root among neighbours and then the root's
    root, until nothing changes. Each round's table is written to the shared
    folder.
    """
    links = links.filter(F.col("a") != F.col("b")).select("a", "b")
    both = settle(links.union(links.select("b", "a")).distinct())
    roots = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        lower = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        up = lower.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = settle(lower.join(up, "root").select("node", "old", F.col("top").alias("root")))
        done = new.filter("old != root").limit(1).count() == 0
        roots = new.select("node", "root")
        if done:
            return roots
