"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct five-word shingles. Two sets of sizes
a <= b with a Jaccard index of 0.8 or more differ in at most (a + b) / 9
elements, so in at most D = a // 4, as b <= 1.25 a.

*Parity sketches.* Within a size band each shingle is hashed into one of P
words, and a word is the XOR of the codes of its shingles. An element that only
one set has changes one word, so the number of differing words is a lower bound
of the symmetric difference. *Pigeonhole.* If more than D words of a set are not
empty, one of them must be the same in both; in any order of the words by what
they hold, the first D + 1 of each set suffice. Words of common shingles only
come last, then words of few shingles, so that a passage that many documents
share makes no candidates. How common a shingle is comes from a table of 2**18
hashed counters over all documents, whose size doesn't grow with them. A set
with too few filled words also enters the next level, with other hashes; as two
linked sets can only miss each other if both have too few, the levels lose
nothing, and sets that fail all levels meet in one key of their band. Bands span
a size and its double, overlap by the factor 1.25, and any two linked sets
share one.

*Verification.* Sets that share a word are candidates. Equal sets are one
class from the start. Within a key each class is first held against one class,
then components are formed, and only keys that still hold several components go
on; what is left is compared in full. So a group of copies costs a star,
not all its pairs, and no link between two components is missed. A 512-bit
parity sketch of the whole set and the sizes rule out pairs before their texts
are compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.llm.codes import NON_SPACE, Words, mix, text_slices
from corpusgauge.llm.components import connected_components
from corpusgauge.session import settle

U = np.uint64
K = 5
LEVELS = 8
SLOT_BITS = 18
SKETCH_BITS = 512


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and code of the distinct shingles, ordered by both; set sizes."""
    w = Words(buf, offs, NON_SPACE, lower=True)
    at, code = w.windows(K)
    text = w.text[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < K))
    if len(short):
        text = np.r_[text, short]
        code = np.r_[code, np.array([w.whole(i) for i in short], U)]
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (code[1:] != code[:-1])] if len(text) else np.zeros(0, bool)
    text, code = text[new], code[new]
    return text, code, np.bincount(text, minlength=len(offs) - 1)


def slot(code: np.ndarray) -> np.ndarray:
    return (mix(code + U(0x632BE59BD9B4E019)) >> U(64 - SLOT_BITS)).astype(np.int64)


def commonness(docs: DataFrame, text: str) -> np.ndarray:
    """Per hashed counter: 0 up to 4 times the mean count of its shingles' sets,
    then one more for each doubling."""
    block = 1 << 10

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for _, buf, offs in text_slices(batch.column(0)):
                table += np.bincount(slot(shingle_sets(buf, offs)[1]), minlength=len(table))
        if table.any():
            parts = [x.tobytes() for x in table.reshape(-1, block)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(parts, pa.binary())], ["block", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    parts = docs.select(text).mapInArrow(count, "block long, counts binary")
    table = np.zeros(1 << SLOT_BITS, np.int64)
    for row in parts.repartition("block").mapInArrow(add, "block long, counts binary").collect():  # 2 MB in all
        table[row["block"] * block : (row["block"] + 1) * block] = np.frombuffer(row["counts"], np.int64)
    often = table / (4 * max(1.0, table.mean()))
    return np.where(often > 1, 1 + np.floor(np.log2(np.maximum(often, 1))), 0).astype(np.uint8)


def words_of_band(text: np.ndarray, code: np.ndarray, rank_of: np.ndarray, sizes: np.ndarray, band: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the first D + 1 filled parity words of each text in its band.

    Returns text and key of each, and the texts with too few filled words.
    """
    salt = mix(band.astype(U) * U(LEVELS) + U(level + 1))
    top = np.ceil(2.5 * 2.0**band / 4).astype(np.int64)
    n_words = 3 * top // 2 + 3
    part = mix(code ^ salt[text]) % n_words[text].astype(U)
    cell = (np.cumsum(n_words) - n_words)[text] + part.astype(np.int64)
    order = np.argsort(cell, kind="stable")
    first = np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1]])
    value = np.bitwise_xor.reduceat(mix(code[order] + salt[text[order]]), first)
    held = np.diff(np.r_[first, len(order)])
    owner = text[order][first]
    key = mix(value ^ mix(salt[owner] + part[order][first]))
    common = np.minimum.reduceat(rank_of[order], first)
    rank_order = np.lexsort((key, -held, common, owner))
    owner, key = owner[rank_order], key[rank_order]
    start = np.searchsorted(owner, np.arange(len(sizes)))
    rank = np.arange(len(owner)) - start[owner]
    need = sizes // 4 + 1
    filled = np.bincount(owner, minlength=len(sizes))
    keep = rank < need[owner]
    return owner[keep], key[keep], np.flatnonzero((filled < need) & (sizes > 0))


def pigeonhole_keys(text: np.ndarray, code: np.ndarray, sizes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and key of all join keys. Sets below 4 can't be linked unless equal."""
    texts, keys = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    rank_of = common[slot(code)]
    own = np.zeros(len(sizes), np.int64)
    big = sizes >= 4
    own[big] = np.floor(np.log2(sizes[big])).astype(np.int64)
    for band, members in ((own, big), (own - 1, big & (sizes < 1.25 * 2.0**own))):
        level = 0
        while members.any() and level < LEVELS:
            inside = members[text]
            t, c = text[inside], code[inside]
            s = np.where(members, sizes, 0)
            owner, key, failed = words_of_band(t, c, rank_of[inside], s, np.maximum(band, 0), level)
            texts.append(owner)
            keys.append(key)
            members = np.zeros(len(sizes), bool)
            members[failed] = True
            level += 1
        rest = np.flatnonzero(members)
        texts.append(rest)
        keys.append(mix(band[rest].astype(U) + U(1 << 40)))
    return np.concatenate(texts), np.concatenate(keys)


SKETCHED = T.StructType([T.StructField("n", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.LongType()))])


def sketch(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Per row: id, text hash, set size, class code, 512-bit sketch, join keys.

    ``cls`` is a 64-bit code of the whole set: rows of one class have equal sets.
    """
    source = docs.select(text, F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"))
    shared = docs.sparkSession.sparkContext.broadcast(commonness(docs, text))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("th", T.LongType()), *SKETCHED.fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, offs in text_slices(batch.column(0)):
                n_texts = len(offs) - 1
                t, code, sizes = shingle_sets(buf, offs)
                first = np.cumsum(sizes) - sizes
                total = np.zeros(len(code) + 1, U)
                np.cumsum(mix(code ^ U(0xA5A5A5A5A5A5A5A5)), out=total[1:])
                cls = mix(total[first + sizes] - total[first] + mix(sizes.astype(U)))
                bits = np.bincount(t * SKETCH_BITS + (mix(code) >> U(55)).astype(np.int64), minlength=n_texts * SKETCH_BITS) & 1
                words = np.packbits(bits.astype(np.uint8)).view(np.int64)
                owner, key = pigeonhole_keys(t, code, sizes, shared.value)
                order = np.argsort(owner, kind="stable")
                offsets = np.searchsorted(owner[order], np.arange(n_texts + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(row, n_texts),
                        batch.column(2).slice(row, n_texts),
                        pa.array(sizes),
                        pa.array(cls.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n_texts + 1, dtype=np.int32) * (SKETCH_BITS // 64)), pa.array(words)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[order].view(np.int64))),
                    ],
                    schema.fieldNames(),
                )

    return source.mapInArrow(run, schema)


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    """Of ``a, b, text_a, text_b`` the pairs with 100 * shared >= percent * union."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                n = part.num_rows
                marks, sizes = [], np.zeros(n, np.int64)
                for column in (part.column(2), part.column(3)):
                    found = [np.zeros(0, U)]
                    for row, buf, offs in text_slices(column):
                        t, code, size = shingle_sets(buf, offs)
                        sizes[row : row + len(size)] += size
                        found.append(mix(code + (t + row).astype(U) * U(0x9E3779B97F4A7C15)))
                        marks.append((t + row, found[-1]))
                text = np.concatenate([m[0] for m in marks])
                key = np.concatenate([m[1] for m in marks])
                order = np.argsort(key, kind="stable")
                same = key[order][1:] == key[order][:-1]
                shared = np.bincount(text[order][1:][same], minlength=n)
                ok.append(100 * shared >= percent * (sizes - shared))
            keep = pa.array(np.concatenate(ok)) if ok else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that sizes and sketches don't rule out."""
    left = classes.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    near = pairs.join(left, "a").join(right, "b")
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    apart = sum((F.bit_count(F.col("s_a")[i].bitwiseXOR(F.col("s_b")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    # shared <= small, union >= large; differing = union - shared
    return near.filter((100 * small >= percent * large) & (apart * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b")))).select("a", "b")


def verify(near: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The linked among pairs of classes ``a, b``, by their texts."""
    with_a = near.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    return linked(with_b, percent)


BLOCK = 512


def open_pairs(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All pairs that share a key, are of different components and that sizes and
    sketches don't rule out.

    A key's rows are dealt to blocks of about 512, and each pair of blocks is
    one unit of work, so a key of m rows makes m * m / 512 rows and no task
    holds more than two blocks of it. Within a unit all pairs are compared as
    arrays, and only those that pass become rows.
    """
    counts = shared.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = shared.join(counts, "key").join(classes, "cls")
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    units = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cls", "root", F.col("n").cast("int").alias("n"), "sketch")
    dealt = units.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compare(part: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own, cls, root, n, sketches = part
        low = own == own.min()
        first, second = (np.flatnonzero(low), np.flatnonzero(~low)) if not low.all() else (np.arange(len(own)),) * 2
        found_a, found_b = [], []
        for i in first.tolist():
            j = second[root[second] != root[i]]
            if low.all():
                j = j[j > i]
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            j = j[100 * small >= percent * large]
            apart = np.bitwise_count(sketches[j] ^ sketches[i]).sum(1, dtype=np.int64)
            j = j[apart * (100 + percent) <= (100 - percent) * (n[i] + n[j])]
            found_a.append(np.minimum(cls[i], cls[j]))
            found_b.append(np.maximum(cls[i], cls[j]))
        return np.concatenate(found_a), np.concatenate(found_b)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        held_unit = None

        def flush() -> Iterator[pa.RecordBatch]:
            a, b = compare([np.concatenate(x) for x in zip(*held, strict=True)])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, lo, hi, own, cls, root, n = (batch.column(i).to_numpy() for i in range(7))
            sketches = batch.column(7).flatten().to_numpy().view(U).reshape(-1, SKETCH_BITS // 64)
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            for s, e in zip(new.tolist(), np.r_[new[1:], len(key)].tolist(), strict=True):
                unit = (key[s], lo[s], hi[s])
                if held and unit != held_unit:
                    yield from flush()
                    held = []
                held_unit = unit
                held.append([x[s:e] for x in (own, cls, root, n.astype(np.int64), sketches)])
        if held:
            yield from flush()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def with_roots(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Key rows with their component; keys of a single component go."""
    at = shared.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    spans = at.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo != _hi").select("key")
    return at.join(spans, "key", "left_semi")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80, max_star_rounds: int = 2) -> DataFrame:
    """``id, th, n_shingles, component_id, root`` for each row of ``docs``.

    ``component_id`` is the smallest id reachable by links, the own one
    included. ``root`` tells components apart, also those whose smallest id is
    null or the same. ``th`` is a hash of the text, which tells repeated ids apart. Null
    and empty texts have empty sets and are linked with nothing; null ids are
    compared like others and take the component's smallest id that isn't null
    (null if there is none). Equal rows are linked. An empty table gives an empty
    result. ``percent`` must be 80 or more, as the bound D is made for 80.
    """
    if percent < 80:
        raise ValueError("the sketches are made for a Jaccard index of 0.8 or more")
    rows = settle(sketch(docs, id_col, text))
    filled = rows.filter("n > 0")
    classes = settle(filled.groupBy("cls").agg(F.min(F.struct("id", "th")).alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    keys = rows.select(F.explode("keys").alias("key"), "cls")
    w = Window.partitionBy("key")
    shared = settle(keys.select("key", "cls", F.min("cls").over(w).alias("rep"), F.max("cls").over(w).alias("_hi")).filter("rep != _hi").select("key", "cls", "rep").distinct())
    # texts of the classes that share a key with another
    wanted = classes.join(shared.select("cls").distinct(), "cls", "left_semi").select("cls", "one.id", "one.th")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"))
    texts = settle(source.join(wanted, source["id"].eqNullSafe(wanted["id"]) & (source["th"] == wanted["th"])).select("cls", "text").dropDuplicates(["cls"]))
    classes = classes.select("cls", "n", "sketch")
    first = shared.filter("cls != rep").select(F.col("cls").alias("a"), F.col("rep").alias("b")).distinct()
    links = settle(verify(near_pairs(first, classes, percent), texts, percent))
    roots = connected_components(links)
    shared = settle(with_roots(shared.select("key", "cls"), roots))
    for turn in range(max_star_rounds):
        by_root = shared.groupBy("key", "root").agg(F.count("*").alias("n"), F.min_by("cls", F.xxhash64("key", "cls", F.lit(turn))).alias("rep"))
        per_key = by_root.groupBy("key").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("open"), F.max_by(F.struct("root", "rep"), F.struct("n", "root")).alias("main"))
        # in full: each row of a key with each of another component
        left = per_key.agg(F.sum("open").alias("open")).collect()[0]["open"] or 0
        if left <= 4 * shared.count():
            break
        star = shared.join(per_key.select("key", "main"), "key").filter("root != main.root").select(F.col("cls").alias("a"), F.col("main.rep").alias("b")).distinct()
        more = settle(verify(near_pairs(star, classes, percent), texts, percent))
        if more.limit(1).count() == 0:
            break
        links = links.unionByName(more)
        roots = connected_components(links)
        shared = settle(with_roots(shared.select("key", "cls"), roots))
    links = links.unionByName(settle(verify(open_pairs(shared, classes, percent), texts, percent)))
    roots = connected_components(links)
    found = rows.select("id", "th", "n", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = found.filter("n > 0").groupBy("root").agg(F.min("id").alias("low"))
    out = found.join(lowest, "root", "left")
    return out.select("id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("id")).alias("component_id"), "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest id.

    Of repeated ids within a component the row of the smallest text hash stays,
    and of equal rows one. Components aren't told apart by their ids, so unlinked
    documents of null or repeated ids all stay, as do documents without words.
    """
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    found = jaccard_components(docs, id_col, text, percent)
    best = found.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("th").alias("th"))).alias("one"))
    stay = best.select("one.id", "one.th").withColumn("_words", F.lit(True)).unionByName(found.filter("n_shingles = 0").select("id", "th").distinct().withColumn("_words", F.lit(False)))
    stay = stay.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "_words")
    marked = docs.withColumn("_own", th).join(stay, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_th")))
    words = marked.filter("_words").dropDuplicates(["_id", "_own"])
    return words.unionByName(marked.filter("not _words")).select(*docs.columns)
