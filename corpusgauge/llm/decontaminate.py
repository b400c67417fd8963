"""Benchmark decontamination by a prefix-filtered set join.

A window is ten consecutive words of an item (all words of a shorter one) and a
set of three-word shingles. A text contains a window only if it holds all of its
shingles, so one of them is a necessary prefix: the rarest, by counts over all
documents. Only places where a prefix shingle occurs become candidates; the
shingle's offset in its window then fixes where the window would lie, the
bounds of the text rule out what can't fit, and the rest is verified word by word.

The items are a stated query set. They are taken in blocks of bounded size
(``max_block_words``), each of which is sent to the tasks that scan the
documents; a larger benchmark means more blocks, not larger ones. The documents
are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.llm.codes import ALNUM, Words, mix, text_slices
from corpusgauge.llm.texts import per_text_rows
from corpusgauge.session import settle

U = np.uint64
SHINGLE = 3
SIEVE_BITS = 20


class CodeSet:
    """Sorted codes with a bitmap before the binary search."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = np.unique(codes)
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[(self.codes >> U(64 - SIEVE_BITS)).astype(np.int64)] = True

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``codes`` are in the set, and at which of its entries."""
        at = np.flatnonzero(self.sieve[(codes >> U(64 - SIEVE_BITS)).astype(np.int64)])
        if not len(self.codes):
            return at[:0], at[:0]
        entry = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        same = self.codes[entry] == codes[at]
        return at[same], entry[same]


@dataclass
class Windows:
    """Distinct windows of a block of items.

    words: codes of the items' words; start, size: a window's place in it;
    items, item_first: item ids of each window (compressed rows).
    """

    words: np.ndarray
    start: np.ndarray
    size: np.ndarray
    items: np.ndarray
    item_first: np.ndarray

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, offset and code of each k-word shingle of the windows of k
        words or more (k = SHINGLE) or of exactly k words (shorter)."""
        pick = np.flatnonzero(self.size >= k if k == SHINGLE else self.size == k)
        n = self.size[pick] - k + 1
        window = np.repeat(pick, n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = self.start[window] + offset
        code = np.zeros(len(at), U)
        for j in range(k):
            code = code * U(0x9E3779B97F4A7C15 | 1) + self.words[at + j]
        return window, offset, mix(code + U(k))


def make_windows(item: np.ndarray, part: np.ndarray, place: np.ndarray, code: np.ndarray, size: int) -> Windows:
    """Windows from word rows: item id, its row, place in the text, code."""
    order = np.lexsort((place, part, item))
    item, part, code = item[order], part[order], code[order]
    new = np.r_[True, (item[1:] != item[:-1]) | (part[1:] != part[:-1])] if len(item) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    n_words = np.diff(np.r_[first, len(item)])
    n = np.maximum(n_words - size + 1, 1)
    start = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    length = np.repeat(np.minimum(n_words, size), n)
    whole = np.zeros(len(start), U)
    for j in range(size):
        inside = j < length
        whole[inside] = mix(whole[inside] * U(31) + code[start[inside] + j] + U(1))
    _, pick, of = np.unique(whole, return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([of, item[start]]), axis=1) if len(start) else np.zeros((2, 0), np.int64)
    return Windows(code, start[pick], length[pick], pairs[1], np.searchsorted(pairs[0], np.arange(len(pick) + 1)))


def word_rows(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    w = Words(buf, offs, ALNUM, lower=True)
    return {"row": w.text, "place": np.arange(len(w.codes)) - w.first[w.text], "code": w.codes.view(np.int64)}


def item_blocks(items: DataFrame, item_col: str, text: str, size: int, max_block_words: int) -> Iterator[Windows]:
    """The items' windows, in blocks of about ``max_block_words`` words."""
    keyed = items.select(F.coalesce(F.col(item_col).cast("long"), F.lit(-1)).alias("item"), F.xxhash64(text).alias("part"), text).dropDuplicates(["item", "part"])
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("code", T.LongType())])
    words = per_text_rows(keyed, ["item", "part"], text, schema, word_rows)
    total = words.count()
    n_blocks = max(1, -(-total // max_block_words))
    if n_blocks > 1:
        words = settle(words)
    for k in range(n_blocks):
        block = words.filter(F.pmod(F.xxhash64("item", "part"), F.lit(n_blocks)) == k) if n_blocks > 1 else words
        got = block.toArrow()
        item, part, place, code = (got.column(c).to_numpy() for c in ("item", "part", "place", "code"))
        yield make_windows(item, part, place, code.view(U), size)


def count_shingles(docs: DataFrame, text: str, sets: dict[int, CodeSet]) -> dict[int, np.ndarray]:
    """How often each shingle of the sets occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(sets)
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("entry", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {k: np.zeros(len(s.codes), np.int64) for k, s in shared.value.items()}
        for batch in batches:
            for _, buf, offs in text_slices(batch.column(0)):
                w = Words(buf, offs, ALNUM, lower=True)
                for k, s in shared.value.items():
                    _, entry = s.find(w.windows(k)[1])
                    counts[k] += np.bincount(entry, minlength=len(s.codes))
        for k, n in counts.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k)), pa.array(seen), pa.array(n[seen])], ["k", "entry", "n"])

    sums = docs.select(text).mapInArrow(run, schema).groupBy("k", "entry").agg(F.sum("n").alias("n")).toArrow()
    out = {k: np.zeros(len(s.codes), np.int64) for k, s in sets.items()}
    for k in sets:
        here = sums.column("k").to_numpy() == k
        out[k][sums.column("entry").to_numpy()[here]] = sums.column("n").to_numpy()[here]
    return out


@dataclass
class Prefixes:
    """For each shingle length: prefix shingles and the windows behind each."""

    found: dict[int, tuple[CodeSet, np.ndarray, np.ndarray, np.ndarray]]


def prefixes(windows: Windows, docs: DataFrame, text: str) -> Prefixes:
    """Each window's rarest shingle; a window with one that occurs nowhere goes."""
    lists = {k: windows.shingles(k) for k in range(1, SHINGLE + 1)}
    lists = {k: x for k, x in lists.items() if len(x[0])}
    sets = {k: CodeSet(x[2]) for k, x in lists.items()}
    counts = count_shingles(docs, text, sets)
    out = {}
    for k, (window, offset, code) in lists.items():
        n = counts[k][np.searchsorted(sets[k].codes, code)]
        order = np.lexsort((code, n, window))
        first = order[np.r_[True, window[order][1:] != window[order][:-1]]]
        first = first[n[first] > 0]
        chosen = CodeSet(code[first])
        entry = np.searchsorted(chosen.codes, code[first])
        by = np.argsort(entry, kind="stable")
        out[k] = (chosen, window[first][by], offset[first][by], np.searchsorted(entry[by], np.arange(len(chosen.codes) + 1)))
    return Prefixes(out)


def repeat_ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, ... (n[i] of them), one after the other."""
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def hits(w: Words, windows: Windows, prefix: Prefixes) -> tuple[np.ndarray, np.ndarray]:
    """First words and windows of all verified occurrences."""
    at_all, win_all = [], []
    for k, (chosen, window, offset, first) in prefix.found.items():
        place, codes = w.windows(k)
        at, entry = chosen.find(codes)
        n = first[entry + 1] - first[entry]
        pick = repeat_ranges(first[entry], n)
        start = np.repeat(place[at], n) - offset[pick]
        win = window[pick]
        text = w.text[np.repeat(place[at], n)]
        fits = (start >= w.first[text]) & (start + windows.size[win] <= w.first[text + 1])
        start, win = start[fits], win[fits]
        for j in range(int(windows.size.max(initial=0))):
            inside = j < windows.size[win]
            same = np.ones(len(win), bool)
            same[inside] = w.codes[start[inside] + j] == windows.words[windows.start[win[inside]] + j]
            start, win = start[same], win[same]
        at_all.append(start)
        win_all.append(win)
    return np.concatenate([*at_all, np.zeros(0, np.int64)]), np.concatenate([*win_all, np.zeros(0, np.int64)])


def scan(docs: DataFrame, text: str, windows: Windows, prefix: Prefixes, last: bool) -> DataFrame:
    """One pass over the documents with one block of windows.

    ``_spans`` (pairs of word places) and ``_items`` gather what blocks find; the
    last pass turns them into ``n_words, n_hit, items``.
    """
    shared = docs.sparkSession.sparkContext.broadcast((windows, prefix))
    kept = docs.columns
    longs = T.ArrayType(T.LongType())
    more = docs.columns and "_spans" in docs.columns
    base = [c for c in kept if c not in ("_spans", "_items")]
    added = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("spans", longs), ("items", longs)] if last else [("_spans", longs), ("_items", longs)]
    schema = T.StructType([*[docs.schema[c] for c in base], *[T.StructField(c, t) for c, t in added]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win, pre = shared.value
        for batch in batches:
            names = batch.schema.names
            n_words, n_hit, spans, items = [], [], [], []
            for row, buf, offs in text_slices(batch.column(names.index(text))):
                w = Words(buf, offs, ALNUM, lower=True)
                n_words.extend(w.counts.tolist())
                start, found = hits(w, win, pre)
                where = w.text[start]
                for i in range(len(offs) - 1):
                    old_s = batch.column(names.index("_spans"))[row + i].as_py() if more else []
                    old_i = batch.column(names.index("_items"))[row + i].as_py() if more else []
                    spans.append(old_s)
                    items.append(old_i)
                for i in np.unique(where):
                    here = where == i
                    s = start[here] - w.first[i]
                    e = s + win.size[found[here]]
                    old = np.array(spans[row + i], np.int64).reshape(-1, 2)
                    spans[row + i] = union(np.r_[s, old[:, 0]], np.r_[e, old[:, 1]])
                    wins = np.unique(found[here])
                    ids = win.items[repeat_ranges(win.item_first[wins], win.item_first[wins + 1] - win.item_first[wins])]
                    items[row + i] = np.unique(np.r_[ids, np.array(items[row + i], np.int64)]).tolist()
            arrays = [batch.column(names.index(c)) for c in base]
            lists = [pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64()))]
            if last:
                n_hit = [int(np.diff(np.array(s, np.int64).reshape(-1, 2)).sum()) if s else 0 for s in spans]
                lists = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays([*arrays, *lists], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def union(start: np.ndarray, end: np.ndarray) -> list[int]:
    """Half-open ranges, overlapping ones joined, as a flat list."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]
    return np.stack([start[new], end[last]], axis=1).ravel().tolist()


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, max_block_words: int = 1 << 20) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``spans``, ``items``.

    ``spans``: word places (start, end, start, end, ...) covered by windows;
    ``items``: ids of the items with a window in the text, ascending; a null item
    id counts as -1. Null or empty texts and items have no words and are never
    hit; repeated rows are judged one by one; an empty table gives an empty
    result; columns named like a result are replaced, others are kept.
    """
    docs = docs.drop("n_words", "n_hit", "spans", "items", "_spans", "_items")
    blocks = item_blocks(items, item_col, item_text, window, max_block_words)
    block = next(blocks)
    for following in blocks:
        docs = settle(scan(docs, text, block, prefixes(block, docs, text), last=False))
        block = following
    return scan(docs, text, block, prefixes(block, docs, text), last=True)
