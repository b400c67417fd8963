"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every word of a piece of text points at the suffix that starts there; three
words of it, the maximum depth, are its keys. Pointers are routed to shards by
their two leading words, so all suffixes with a common pair meet, and a shard
sorts its pointers by three-way partitions: the size of an equal partition is
the count of its phrase, and a partition that holds fewer pointers than a phrase
needs is abandoned unsorted (``equal_partitions``).

Words are 64-bit codes that include the language. Pointers are counted by tasks
first: equal suffixes of a chunk of text are one pointer with a weight. Where
both leading words are hot, a pair may be too much for a shard; such pointers are
routed by all three words, and the pair's parts are summed after the sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.llm.codes import BASE, U, Words, mix, text_slices
from corpusgauge.session import settle

DEPTH = 3
CUTS = [*b".,;:!?", *range(0x0A, 0x0E)]

#: A byte that ends a piece, and a byte that belongs to a word.
ENDS_PIECE = np.zeros(256, bool)
ENDS_PIECE[CUTS] = True
IN_WORD = ~ENDS_PIECE
IN_WORD[[0x20, 0x09]] = False

#: A hot word has more than 1 in so many of all occurrences, so there are at most as many.
HOT_SHARE = 1 << 20


class Chunk:
    """Words of many whole texts: codes (language included), their bytes, and
    whether the next word follows in the same piece."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.linked: list[np.ndarray] = []
        self.bytes: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.langs: list[np.ndarray] = []
        self.n = 0

    def add(self, buf: np.ndarray, offs: np.ndarray, lang: np.ndarray, salt: np.ndarray) -> None:
        w = Words(buf, offs, IN_WORD, lower=True)
        if not len(w.codes):
            return
        cuts = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(ENDS_PIECE[buf], out=cuts[1:])
        linked = np.zeros(len(w.codes), bool)
        linked[:-1] = (w.text[1:] == w.text[:-1]) & (cuts[w.starts[1:]] == cuts[w.ends[:-1]])
        self.codes.append(mix(w.codes + salt[lang[w.text]]))
        self.linked.append(linked)
        self.bytes.append(w.buf[IN_WORD[buf]])
        self.lengths.append(w.ends - w.starts)
        self.langs.append(lang[w.text])
        self.n += len(w.codes)

    def words(self, names: pa.Array) -> pa.RecordBatch:
        """Each distinct word once with its number of occurrences."""
        codes = np.concatenate(self.codes)
        _, first, counts = np.unique(codes, return_index=True, return_counts=True)
        ends = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(np.concatenate(self.lengths), out=ends[1:])
        raw = np.concatenate(self.bytes)
        texts = pa.LargeStringArray.from_buffers(len(codes), pa.py_buffer(ends), pa.py_buffer(raw)).take(pa.array(first))
        lang = names.take(pa.array(np.concatenate(self.langs)[first]))
        return pa.RecordBatch.from_arrays([pa.array(codes[first].view(np.int64)), lang, texts.cast(pa.string()), pa.array(counts)], ["code", "lang", "word", "f"])

    def pointers(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys (a row for each depth) of distinct suffixes of two words or
        more, 0 where the piece has ended, and how often each occurs."""
        codes, linked = np.concatenate(self.codes), np.concatenate(self.linked)
        keys = np.zeros((DEPTH, len(codes)), U)
        keys[0], inside = codes, np.ones(len(codes), bool)
        for d in range(1, DEPTH):
            inside[: len(codes) - d + 1] &= np.r_[linked[d - 1 :]][: len(codes) - d + 1]
            inside[len(codes) - d :] = False
            keys[d, :-d] = np.where(inside[:-d], codes[d:], U(0))
        keys = keys[:, keys[1] != 0]
        whole = whole_code(keys)
        _, first, counts = np.unique(whole, return_index=True, return_counts=True)
        return keys[:, first], counts


def whole_code(keys: np.ndarray) -> np.ndarray:
    code = keys[0].copy()
    for k in keys[1:]:
        code = code * U(BASE) + k
    return mix(code)


def chunks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[Chunk, pa.Array]]:
    """Chunks of about ``size`` words, and the names of the languages."""
    names: dict[str, int] = {}
    chunk = Chunk()
    salt = np.zeros(0, U)
    for batch in batches:
        own = pc.fill_null(batch.column(1).cast(pa.string()), "und").dictionary_encode()
        ids = np.array([names.setdefault(x, len(names)) for x in own.dictionary.to_pylist()], np.int64)
        lang = ids[own.indices.to_numpy()] if len(ids) else ids
        if len(names) > len(salt):
            salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in names], U)
        for row, buf, offs in text_slices(batch.column(0)):
            chunk.add(buf, offs, lang[row : row + len(offs) - 1], salt)
            if chunk.n >= size:
                yield chunk, pa.array(list(names))
                chunk = Chunk()
    if chunk.n:
        yield chunk, pa.array(list(names))


def word_counts(docs: DataFrame, size: int) -> DataFrame:
    """``code, lang, word, f``: occurrences of each word of each language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, names in chunks(batches, size):
            yield chunk.words(names)

    return docs.mapInArrow(run, "code long, lang string, word string, f long").groupBy("code", "lang", "word").agg(F.sum("f").alias("f"))


def is_hot(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether both leading words are hot (``hot`` is sorted)."""
    if not len(hot):
        return np.zeros(keys.shape[1], bool)
    return (hot[np.searchsorted(hot, keys[0]).clip(max=len(hot) - 1)] == keys[0]) & (hot[np.searchsorted(hot, keys[1]).clip(max=len(hot) - 1)] == keys[1])


def routed(docs: DataFrame, hot: np.ndarray, shards: int, size: int) -> DataFrame:
    """``shard, data``: pointers packed by shard, one row for each chunk.

    Odd shards hold pointers routed by all their words, even ones the others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # at most HOT_SHARE codes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in chunks(batches, size):
            keys, weight = chunk.pointers()
            both = is_hot(keys, shared.value)
            shard = (np.where(both, whole_code(keys), whole_code(keys[:2])) % U(shards)).astype(np.int64) * 2 + both
            order = np.argsort(shard, kind="stable")
            shard, keys, weight = shard[order], keys[:, order], weight[order]
            at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
            to = np.r_[at[1:], len(shard)]
            data = [np.concatenate([keys[:, a:b].ravel(), weight[a:b].astype(U)]).tobytes() for a, b in zip(at, to, strict=True)]
            if data:
                yield pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array(data, pa.binary())], ["shard", "data"])

    return docs.mapInArrow(run, "shard long, data binary")


def equal_partitions(keys: np.ndarray, weight: np.ndarray, least: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Three-way partitions of pointers on one key after another.

    keys[d, i]: word d of suffix i, 0 behind its end; weight[i]: how often it
    occurs; least[d]: a phrase of d + 1 words counts from this on. Returns for
    each depth a pointer of each equal partition and its weight.

    All segments are partitioned at once: less than, equal to and greater than
    the key of their middle pointer. Equal ones go one word deeper, the others
    stay, and those lighter than ``least`` are abandoned, as no phrase in them
    can be frequent.
    """
    depth_end, least = len(keys), np.array([*least, 0])
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(depth_end)]
    order = np.arange(keys.shape[1])
    sizes, depth = np.array([len(order)]), np.array([0])
    while len(order):
        starts = np.cumsum(sizes) - sizes
        seg = np.repeat(np.arange(len(sizes)), sizes)
        key = keys[depth[seg], order]
        pivot = key[starts + sizes // 2]
        side = (key > pivot[seg]).astype(np.int64) - (key < pivot[seg]) + 1
        part = seg * 3 + side
        n_parts = 3 * len(sizes)
        heavy = np.bincount(part, weight[order], n_parts).astype(np.int64)
        level = np.repeat(depth, 3)
        equal = np.arange(n_parts) % 3 == 1
        kept = heavy >= np.maximum(least[level], 1)
        kept[1::3] &= pivot != 0
        # stable placement of what is kept, by part
        live = kept[part]
        order, part = order[live], part[live]
        counts = np.bincount(part, minlength=n_parts)
        order = order[np.argsort(part, kind="stable")]
        first = np.cumsum(counts) - counts
        for d in range(depth_end):
            done = kept & equal & (level == d)
            if done.any():
                found[d].append((order[first[done]], heavy[done]))
        level = level + equal
        deeper = kept & (level < depth_end)
        if not deeper.all():
            order = order[np.repeat(deeper, counts)]
        sizes, depth = counts[deeper], level[deeper]
    return [tuple(np.concatenate(x) for x in zip(*f, strict=True)) if f else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for f in found]


def phrase_counts(packed: DataFrame, least: int) -> DataFrame:
    """``c1, c2, c3, a``: phrases of two words (c3 = 0; those of hot words in
    parts) and of three words with their counts."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = key[0].as_py() % 2 == 0
        keys, weight = [], []
        for batch in batches:
            for data in batch.column(batch.schema.get_field_index("data")):
                got = np.frombuffer(data.as_buffer(), U).reshape(DEPTH + 1, -1)
                keys.append(got[:DEPTH])
                weight.append(got[DEPTH].astype(np.int64))
        keys, weight = np.concatenate(keys, 1), np.concatenate(weight)
        found = equal_partitions(keys, weight, (least, least, least) if whole else (1, 1, least))
        for d in range(1, DEPTH):
            at, a = found[d]
            c = [keys[i][at] if i <= d else np.zeros(len(at), U) for i in range(DEPTH)]
            yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in c], pa.array(a)], ["c1", "c2", "c3", "a"])

    return packed.groupBy("shard").applyInArrow(run, "c1 long, c2 long, c3 long, a long")


def cut_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact to 38 digits."""
    whole = "CAST({} AS DECIMAL(15, 0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {whole.format(a)} * {whole.format(a)}) div ({whole.format(left)} * {whole.format(right)})")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, covered: int = 50, top: int = 2000, chunk_words: int = 1 << 19, shard_words: int = 1 << 18, hot_words: int = 1 << 20) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first
    ``top`` phrases of two and three words that occur ``least`` times.

    The score of a cut of a phrase is a * a / (l * r) in millionths; the lowest
    cut counts, of equal ones the first. A pair is dropped if a frequent triple
    that holds it occurs in ``covered`` percent of its places or more. Tasks hold
    ``chunk_words`` words of text, or a shard of about ``shard_words`` pointers
    and at most one pair's beyond that; pairs of words that both occur more than
    ``hot_words`` times are split over shards. A null
    language is ``und``, a null or empty text has no words, repeated rows count
    each, ties end by the phrase's bytes, an empty table gives an empty result,
    and no other column of ``docs`` is read. Exact up to equal 64-bit codes of
    different words.
    """
    docs = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    vocabulary = settle(word_counts(docs, chunk_words))
    totals = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    total = vocabulary.agg(F.sum("f")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    hot = vocabulary.filter(F.col("f") > max(hot_words, total // HOT_SHARE)).select("code", "f")
    hot_codes = np.sort(hot.toArrow().column("code").to_numpy().view(U))
    counts = settle(phrase_counts(routed(docs, hot_codes, shards, chunk_words), least))

    words = vocabulary.filter(F.col("f") >= least)
    pairs = settle(counts.filter("c3 = 0").groupBy("c1", "c2").agg(F.sum("a").alias("a")).filter(F.col("a") >= least))
    triples = counts.filter("c3 != 0")

    def with_word(df: DataFrame, code: str, take: dict[str, str]) -> DataFrame:
        """Counts (and language) of a word; hot words come by a broadcast of
        bounded size, so no key of the shuffled join is hot."""
        few = F.broadcast(words.join(F.broadcast(hot.select("code")), "code", "left_semi").select(F.col("code").alias("_hot"), *[F.col(c).alias(f"_h_{c}") for c in take]))
        rest = words.select(F.col("code").alias("_code"), *[F.col(c).alias(f"_w_{c}") for c in take])
        df = df.join(few, F.col(code) == F.col("_hot"), "left")
        key = F.when(F.col("_hot").isNull(), F.col(code)).otherwise(F.xxhash64("c1", "c2", "c3"))
        df = df.withColumn("_key", key).join(rest, F.col("_key") == F.col("_code"), "left")
        made = {name: F.when(F.col("_hot").isNotNull(), F.col(f"_h_{c}")).otherwise(F.col(f"_w_{c}")) for c, name in take.items()}
        return df.withColumns(made).drop("_hot", "_key", "_code", *[f"_{k}_{c}" for c in take for k in "hw"])

    # pairs that no triple covers
    inside = triples.select("c1", "c2", "a").unionByName(triples.select(F.col("c2").alias("c1"), F.col("c3").alias("c2"), "a"))
    inside = inside.groupBy("c1", "c2").agg(F.max("a").alias("_in"))
    free = pairs.join(inside, ["c1", "c2"], "left").filter(F.col("_in").isNull() | (100 * F.col("_in") < covered * F.col("a"))).drop("_in")
    two = with_word(with_word(free.withColumn("c3", F.lit(0).cast("long")), "c1", {"f": "l", "lang": "lang"}), "c2", {"f": "r"})
    two = two.withColumn("score", cut_score("a", "l", "r"))

    ahead = pairs.select("c1", "c2", F.col("a").alias("f12"))
    behind = pairs.select(F.col("c1").alias("c2"), F.col("c2").alias("c3"), F.col("a").alias("f23"))
    three = with_word(with_word(triples.join(ahead, ["c1", "c2"]).join(behind, ["c2", "c3"]), "c1", {"f": "f1", "lang": "lang"}), "c3", {"f": "f3"})
    three = three.withColumns({"_1": cut_score("a", "f1", "f23"), "_2": cut_score("a", "f12", "f3")})
    one = F.col("_1") <= F.col("_2")
    three = three.withColumns({"l": F.when(one, F.col("f1")).otherwise(F.col("f12")), "r": F.when(one, F.col("f23")).otherwise(F.col("f3")), "score": F.least("_1", "_2")})

    columns = ["lang", "c1", "c2", "c3", "a", "l", "r", "score"]
    scored = settle(two.select(*columns).unionByName(three.select(*columns)))
    # score and count of each language's last place; all phrases that tie with it stay until their words are known
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    last = scored.select("lang", "score", "a").withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= top)
    last = last.groupBy("lang").agg(F.count("*").alias("_n"), F.min(F.struct("score", "a")).alias("_last"))
    near = scored.join(last, "lang").filter((F.col("_n") < top) | (F.struct("score", "a") >= F.col("_last"))).drop("_n", "_last")
    for k in range(1, DEPTH + 1):
        near = near.join(vocabulary.select(F.col("code").alias(f"c{k}"), F.col("word").alias(f"w{k}")), f"c{k}", "left")
    spelt = near.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3")).join(totals, "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    return spelt.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
