"""A Merkle manifest of a data set, with octopus multiproofs.

Every row is a leaf: the SHA-256 of its fields, each told apart by its length.
The rows of a source, in the order of their ids, are the leaves of a tree of
fixed arity; the sources' roots, in the order of the sources, are the leaves of
one tree above. A node is named by its coordinate (tree, level, index), tree -1
being the one above.

A tree grows in tiers of ``span`` levels: a block of arity**span neighbouring
nodes makes its interiors alone, and the next tier gets one node of each block.
Proofs are made by leaf partition, a block or what is left of it: the union of
the coordinates that its leaves' proofs need and that it can't derive itself is
computed from positions alone (``missing``), fetched by one join, and with it
the partition derives every shared interior once and spells out the proof of
each leaf (``expand``). No tree is held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.session import settle

TOP = -1

#: Node tables of at most so many rows are sent to all tasks; others are joined by shuffles.
FEW_NODES = 1 << 18

NODE = "tree long, level int, idx long, n long, digest binary"
REQUEST = "tree long, block long, _tree long, _level int, _idx long"


def digest(*inputs: Column) -> Column:
    """SHA-256 of the concatenated texts, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*inputs), 256))


def coded(value: Column) -> Column:
    """A field's text that can't be mistaken for another: ``-`` for null, else
    the number of its UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: Column) -> Column:
    return digest(*[coded(f) for f in fields])


def placed(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their exact place in the group, and the groups.

    First: columns added are ``pos``, ``n`` (size of the group) and ``tree``
    (place of the group among the groups, nulls first). Second: ``group, n,
    tree``. Rows are dealt out by ranges of (group, order), so a large group
    spreads over many tasks; places come from sums over these ranges.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = settle(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    runs = ranged.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    by_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = settle(runs.withColumns({"_before": before, "n": F.sum("_n").over(by_group)}))
    # a row for each group: ranked by ranges as well
    groups = runs.groupBy(group).agg(F.max("n").alias("n"))
    names = groups.repartitionByRange(F.col(group).asc_nulls_first()).sortWithinPartitions(F.col(group).asc_nulls_first())
    names = settle(names.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    spans = names.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    groups = settle(names.join(spans, "_part").select(group, "n", (F.col("_at") - F.col("_first") + F.col("_before")).alias("tree")))
    tree = groups.select(F.col(group).alias("_g"), "tree")
    runs = runs.join(tree, F.col(group).eqNullSafe(F.col("_g"))).select("_part", "_g", (F.col("_before") - F.col("_first")).alias("_shift"), "n", "tree")
    at = ranged.withColumnRenamed("_part", "_p")
    both = at.join(runs, (F.col("_p") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_g")))
    return both.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_p", "_part", "_g", "_shift"), groups


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def widths(n: int, arity: int) -> list[int]:
    """Number of nodes on each level, leaves first, down to one."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def packed(nodes: DataFrame, arity: int, span: int) -> DataFrame:
    """``tree, block, n, at, digests``: a row for each block of neighbours."""
    block = F.floor(F.col("idx") / arity**span).cast("long")
    both = F.sort_array(F.collect_list(F.struct("idx", "digest")))
    made = nodes.groupBy("tree", block.alias("block")).agg(F.max("n").alias("n"), both.alias("_b"))
    return made.select("tree", "block", "n", F.col("_b.idx").alias("at"), F.col("_b.digest").alias("digests"))


def interiors(blocks: DataFrame, base: int, arity: int, span: int) -> DataFrame:
    """The nodes on the ``span`` levels above each block of level ``base``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                wide = widths(row["n"], arity)
                hexes, first = [d.hex() for d in row["digests"]], row["at"][0]
                level, idx, out = [], [], []
                for up in range(base + 1, min(base + span, len(wide) - 1) + 1):
                    hexes = [sha("".join(hexes[i : i + arity])) for i in range(0, len(hexes), arity)]
                    first //= arity
                    level += [up] * len(hexes)
                    idx += range(first, first + len(hexes))
                    out += hexes
                if out:
                    same = len(out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["tree"]] * same, pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array([row["n"]] * same, pa.int64()), pa.array([bytes.fromhex(h) for h in out], pa.binary())],
                        ["tree", "level", "idx", "n", "digest"],
                    )

    return blocks.mapInArrow(run, NODE)


def grow(leaves: DataFrame, arity: int, span: int) -> list[DataFrame]:
    """Tables of the nodes above ``leaves(tree, idx, n, digest)``, by tier."""
    tiers, base = [], 0
    widest = leaves.agg(F.max("n")).first()[0] or 0
    nodes = leaves
    while widest > arity**base:
        tiers.append(settle(interiors(packed(nodes, arity, span), base, arity, span)))
        base += span
        nodes = tiers[-1].filter((F.col("level") == base) & (F.col("n") > float(arity) ** base)).select("tree", "idx", "n", "digest")
    return tiers


def roots(leaves: DataFrame, tiers: list[DataFrame], arity: int) -> DataFrame:
    """``tree, digest`` of each tree's root; a lone leaf is its own."""
    found = leaves.filter("n = 1").select("tree", "digest")
    for t in tiers:
        found = found.unionByName(t.filter(F.col("n") <= F.pow(F.lit(float(arity)), F.col("level"))).select("tree", "digest"))
    return found


@dataclass
class Manifest:
    """leaves: the caller's key columns with ``leaf, claim, tree, pos, n``;
    tiers: interior nodes of the sources' trees; top: nodes of the tree above,
    its leaves included; n_trees: number of sources."""

    leaves: DataFrame
    tiers: list[DataFrame]
    top: DataFrame
    n_trees: int
    arity: int
    span: int


def manifest(rows: DataFrame, source: str, id_col: str, arity: int = 3, span: int = 7) -> Manifest:
    """Grow all trees over ``rows`` (source, id, ``leaf``, any others).

    Equal ids are ordered by leaf, so repeated rows may change places without
    an effect; a null source is a tree of its own, null ids come first.
    """
    rows, groups = placed(rows, source, [id_col, "leaf"])
    leaves = settle(rows)
    nodes = leaves.select("tree", F.col("pos").alias("idx"), "n", F.col("leaf").alias("digest"))
    tiers = grow(nodes, arity, span)
    n_trees = groups.count()
    subroots = settle(roots(nodes, tiers, arity).select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("n"), "digest"))
    top = subroots
    for tier in grow(subroots.drop("level"), arity, span):
        top = top.unionByName(tier)
    return Manifest(leaves, tiers, top, n_trees, arity, span)


def missing(at: np.ndarray, n: int, arity: int) -> Iterator[tuple[int, int]]:
    """(level, index) of the nodes that the proofs of leaves ``at`` (sorted,
    distinct) need and that can't be derived from these leaves and each other."""
    for level, width in enumerate(widths(n, arity)[:-1]):
        runs = np.unique(at // arity)
        family = (runs[:, None] * arity + np.arange(arity)).ravel()
        for i in np.setdiff1d(family[family < width], at, assume_unique=True).tolist():
            yield level, i
        at = runs


def requests(parts: DataFrame, arity: int, n_trees: int) -> DataFrame:
    """The union of missing coordinates of each leaf partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.unique(np.array(row["at"], np.int64))
                want = [(row["tree"], *c) for c in missing(at, row["n"], arity)]
                want += [(TOP, *c) for c in missing(np.array([row["tree"]]), n_trees, arity)]
                if want:
                    tree, level, idx = zip(*want, strict=True)
                    own = [pa.array([row[c]] * len(want), pa.int64()) for c in ("tree", "block")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(tree, pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64())], ["tree", "block", "_tree", "_level", "_idx"])

    return parts.select("tree", "block", "n", F.col("rows.pos").alias("at")).mapInArrow(run, REQUEST)


def climb(level_of: dict[int, dict[int, str]], hexes: dict[int, str], n: int, arity: int) -> tuple[list[dict[int, list[str]]], str]:
    """Runs of known and fetched nodes on each level, and the root."""
    runs = []
    for level, width in enumerate(widths(n, arity)[:-1]):
        known = {**level_of.get(level, {}), **hexes}
        here = {r: [known[i] for i in range(r * arity, min((r + 1) * arity, width))] for r in {i // arity for i in hexes}}
        runs.append(here)
        hexes = {r: sha("".join(family)) for r, family in here.items()}
    return runs, next(iter(hexes.values()))


def siblings(runs: list[dict[int, list[str]]], at: int, arity: int) -> list[tuple[str, str]]:
    """For each level the digests before and after the node's own place."""
    out = []
    for here in runs:
        family, place = here[at // arity], at % arity
        out.append(("".join(family[:place]), "".join(family[place + 1 :])))
        at //= arity
    return out


def expand(row: dict, n_trees: int, arity: int) -> Iterator[tuple[str, str, str, str, str]]:
    """Leaf, subroot, root, hash of the proof and refolded root of each row of
    a leaf partition with what was fetched for it."""
    fetched: dict[bool, dict[int, dict[int, str]]] = {True: {}, False: {}}
    for f in row["fetched"] or ():
        fetched[f["_tree"] == TOP].setdefault(f["_level"], {})[f["_idx"]] = f["digest"].hex()
    runs, subroot = climb(fetched[False], {r["pos"]: r["leaf"].hex() for r in row["rows"]}, row["n"], arity)
    above, root = climb(fetched[True], {row["tree"]: subroot}, n_trees, arity)
    top = siblings(above, row["tree"], arity)
    for r in row["rows"]:
        proof = siblings(runs, r["pos"], arity) + top
        folded = r["claim"].hex()
        for left, right in proof:
            folded = sha(left + folded + right)
        yield r["leaf"].hex(), subroot, root, sha("".join(a + b for a, b in proof)), folded


def prove(made: Manifest, keys: list[str], some: DataFrame | None = None) -> DataFrame:
    """``keys`` with ``leaf, subroot, root, proof_sha256, folded_root`` (hex)
    and ``verified``, for each leaf, or for the leaves ``some`` (rows of
    ``made.leaves``, any subset of them).

    A row's ``claim`` is folded with the siblings of its leaf, so ``verified``
    says whether the claim is the leaf that the manifest holds.
    """
    arity, span, n_trees = made.arity, made.span, made.n_trees
    block = F.floor(F.col("pos") / arity**span).cast("long")
    rows = (some if some is not None else made.leaves).groupBy("tree", block.alias("block")).agg(F.max("n").alias("n"), F.collect_list(F.struct("pos", "leaf", "claim", *keys)).alias("rows"))
    parts = settle(rows)
    want = settle(requests(parts, arity, n_trees))
    key = ["_tree", "_level", "_idx"]
    tables = [made.top, *made.tiers]
    if some is not None:  # whole blocks never ask for leaves
        tables.append(made.leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "n", F.col("leaf").alias("digest")))
    got = None
    for k, table in enumerate(tables):
        own = table.select(F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("idx").alias("_idx"), "digest")
        if some is None and k:  # and for no node within a block
            own = own.filter(F.col("_level") >= span)
        # a node near a root is asked for by many partitions; there are few such nodes
        if (k == 0 or k > 2) and table.count() <= FEW_NODES:
            own = F.broadcast(own)
        hit = want.join(own, key)
        got = hit if got is None else got.unionByName(hit)
    fetched = got.groupBy("tree", "block").agg(F.collect_list(F.struct(*key, "digest")).alias("fetched"))
    both = parts.join(fetched, ["tree", "block"], "left")
    schema = [both.schema["rows"].dataType.elementType[k] for k in keys]
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_at = batch.schema.get_field_index("rows")
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                texts = [pa.array(c, pa.string()) for c in zip(*expand(one.to_pylist()[0], n_trees, arity), strict=True)]
                struct = one.column(rows_at).flatten()
                yield pa.RecordBatch.from_arrays([*[struct.field(k) for k in keys], *texts], [*keys, *names])

    out = both.mapInArrow(run, T.StructType([*schema, *[T.StructField(c, T.StringType()) for c in names]]))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(id_col: Column) -> Column:
    """Rows whose copy is altered in the query: even CRC-32 of the id's decimals."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 2 == 0, F.lit(False))


def verify_copy(docs: DataFrame, fields: list[str], id_col: str = "doc_id", source: str = "source", copy: dict[str, Column] | None = None, arity: int = 3, span: int = 7) -> DataFrame:
    """Prove a copy of ``docs`` against the manifest of ``docs``.

    ``copy`` gives columns of the copy that may differ. Returns ``id_col,
    source`` and the columns of ``prove``, a row for each row. Null fields and
    empty texts have different leaves; repeated ids and repeated rows are leaves
    of their own; an empty table gives an empty result. Columns of ``docs``
    beyond id, source and fields play no part, whatever their names.
    """
    theirs = [copy.get(f, F.col(f)) if copy else F.col(f) for f in fields]
    rows = settle(docs.select(F.col(id_col).alias("_id"), F.col(source).alias("_source"), leaf_digest(*[F.col(f) for f in fields]).alias("leaf"), leaf_digest(*theirs).alias("claim")))
    made = manifest(rows, "_source", "_id", arity, span)
    return prove(made, ["_id", "_source"]).withColumnsRenamed({"_id": id_col, "_source": source})
