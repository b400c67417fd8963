"""Suffix-array deduplication of repeated byte strings.

Every byte of a document that lies in a 50-byte string which also starts in a
document of a smaller id is removed. The work is dealt out so that equal strings
meet, whatever the documents:

1. Each 50-byte window has an anchor: its 20-byte string of the smallest hash.
   Windows of one anchor lie side by side; they form a segment. Equal windows
   have equal anchors. Anchors (hash, code of the segment, document, place) go
   to buckets by hash, packed as arrays of a bounded part of the input each, in
   no more bytes than their values need.
2. An anchor of one document is done. If all segments of an anchor are equal,
   their bytes repeat the first document's as a whole. Only anchors with
   different segments need the texts: each distinct segment is cut from its
   first document.
3. Segments go to shards by anchor. A shard's segments are joined to one text,
   whose suffix array is built by induced sorting; with the permuted common
   prefixes, suffixes that share 50 bytes stand together, and the smallest
   document of each run tells which windows of a segment are repeats.
4. The ranges go back to the documents, are joined and cut out.

Documents are dealt by hash to chunks of bounded bytes for steps 2 and 4.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.codes import BASE, _powers, mix, text_slices
from corpusgauge.llm.suffixes import common_prefixes, induced_sort
from corpusgauge.session import released_shuffles, settle

U = np.uint64
GRAM = 20
INDEX_BITS = 24
NO_ID = 2**63 - 1
# anchor hashes beside their bucket; two anchors of one hash only cost work, as
# their segments differ
HASH_BITS = U(32)
PRIME, FACTOR = 2**31 - 1, 1103515245
SPAN, FETCH, USE = 0, 1, 2


def pack(*arrays: np.ndarray) -> bytes:
    """Integers in as few bytes as the largest of their array needs (negative
    ones: eight), the lowest bytes of all first, then the next ones."""
    n = len(arrays[0])
    head, planes = [np.uint32(n).tobytes()], []
    for a in arrays:
        a = np.ascontiguousarray(a, "<i8").view("<u8")
        width = (int(a.max(initial=0)).bit_length() + 7) // 8
        head.append(bytes([width]))
        planes.append(np.ascontiguousarray(a.view(np.uint8).reshape(n, 8)[:, :width].T).tobytes())
    return b"".join(head + planes)


def unpack(blob: bytes, n_arrays: int) -> tuple[list[np.ndarray], int]:
    """The arrays, and where they end in ``blob``."""
    n, at, out = int(np.frombuffer(blob, np.uint32, 1)[0]), 4 + n_arrays, []
    for width in blob[4:at]:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
        out.append(wide.view("<i8")[:, 0])
        at += n * width
    return out, at


def gather(blobs: list[bytes], n_arrays: int) -> list[np.ndarray]:
    parts = [unpack(b, n_arrays)[0] for b in blobs]
    return [np.concatenate([np.zeros(0, np.int64), *[p[i] for p in parts]]) for i in range(n_arrays)]


def by_part(part: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packed arrays for each part that has rows."""
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(n + 1))
    arrays = [a[order] for a in arrays]
    for p in np.flatnonzero(np.diff(edge)):
        yield int(p), pack(*[a[edge[p] : edge[p + 1]] for a in arrays])


def home(doc: np.ndarray, th: np.ndarray, n: int) -> np.ndarray:
    return (doc % PRIME * FACTOR + th % PRIME) % PRIME % n


def home_column(doc: Column, th: Column, n: int) -> Column:
    return ((F.pmod(doc, F.lit(PRIME)) * FACTOR + F.pmod(th, F.lit(PRIME))) % PRIME % n).cast("int")


def short_hash(keyed: DataFrame) -> tuple[DataFrame, int]:
    """``keyed`` with ``th`` cut to the bits that tell the texts of each id
    apart, none where every id has one text; and the bytes of all texts."""
    for bits in (0, 32, 64):
        short = keyed.withColumn("short", F.col("th") if bits == 64 else F.col("th").bitwiseAND(F.lit((1 << bits) - 1)))
        by_id = short.groupBy("doc", "short").agg((F.min("th") != F.max("th")).alias("clash"), F.sum(F.octet_length("text").cast("long")).alias("size"))
        clash, total = by_id.agg(F.max("clash"), F.sum("size")).collect()[0]
        if not clash:
            break
    return short.select("doc", F.col("short").alias("th"), "text"), total or 0


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m = 1
    while m * 2 <= width:
        x, m = np.minimum(x[:-m], x[m:]), m * 2
    rest = width - m
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Text, anchor hash, segment code, first byte and size of all segments."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none, none
    h = mix(buf.astype(U) + U(1))
    m = 1
    while m * 2 <= GRAM:
        h, m = mix(h[:-m] * U(BASE) + h[m:]), m * 2
    if m < GRAM:
        h = mix(h[: len(h) - (GRAM - m)] * U(BASE) + h[GRAM - m :])
    # the low bits give way to the place, so that the leftmost of equals is taken
    low = U((1 << INDEX_BITS) - 1)
    least = sliding_min((h & ~low) | np.arange(len(h), dtype=U), length - GRAM + 1) & low
    least = least.astype(np.int64)
    starts = np.arange(len(least))
    text = np.searchsorted(offs, starts, "right") - 1
    inside = starts + length <= offs[text + 1]
    q, at, text = starts[inside], least[inside], text[inside]
    if not len(q):
        return none, none, none, none, none
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    first, last = q[new], q[np.r_[new[1:] - 1, len(q) - 1]]
    end = last + length
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=sums[1:])
    code = mix((sums[end] - sums[first]) * down[first] + (end - first).astype(U))
    return text[new], h[at[new]].view(np.int64), code.view(np.int64), first - offs[text[new]], end - first


def text_anchors(buf: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of a run of texts, in pieces that place indexes can hold."""
    most = 1 << (INDEX_BITS - 1)
    if len(buf) <= most:
        yield anchors(buf, offs, length)
        return
    for i in range(len(offs) - 1):
        for at in range(int(offs[i]), max(int(offs[i + 1]) - length + 1, int(offs[i]) + 1), most):
            to = min(at + most + length - 1, int(offs[i + 1]))
            text, h, code, first, size = anchors(buf[at:to], np.array([0, to - at]), length)
            yield text + i, h, code, first + at - offs[i], size


def deal_anchors(keyed: DataFrame, n_buckets: int, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, *rest = [np.concatenate(x) for x in zip(*held, strict=True)]
            h, bucket = np.divmod(h.view(U), U(n_buckets))
            h = h & ((U(1) << HASH_BITS) - U(1))
            rows = list(by_part(bucket.view(np.int64), n_buckets, h.view(np.int64), *rest))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, buf, offs in text_slices(batch.column(2)):
                for text, h, code, first, n in text_anchors(buf, offs, length):
                    at = text + row
                    held.append((h, code, doc[at], th[at], first, n))
                    size += len(h)
                if size > 1_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return keyed.select("doc", "th", "text").mapInArrow(run, "bucket int, blob binary")


def compare_anchors(dealt: DataFrame, n_chunks: int, n_shards: int) -> DataFrame:
    """Per bucket: ranges that repeat as a whole, segments to cut, their uses.

    A bucket's segments go to one shard, under a key of anchor and segment.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blobs.setdefault(b, []).append(blob.as_py())
        for b in list(blobs):
            h, code, doc, th, first, n = gather(blobs.pop(b), 6)
            order = np.lexsort((th, doc, code, h))
            h, code, doc, th, first, n = (x[order] for x in (h, code, doc, th, first, n))
            new = np.r_[True, h[1:] != h[:-1]]
            start, group = np.flatnonzero(new), np.cumsum(new) - 1
            low, high = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
            fresh = new | np.r_[True, code[1:] != code[:-1]]
            mixed = (np.bincount(group, fresh) > 1) & (low != high)
            later = doc > low[group]
            out = []
            pick = later & ~mixed[group]
            out += [(SPAN, *x) for x in by_part(home(doc[pick], th[pick], n_chunks), n_chunks, doc[pick], th[pick], first[pick], n[pick])]
            key = pair_code(h + (b << int(HASH_BITS)), code).view(np.int64)
            pick = fresh & mixed[group]
            shard = np.full(np.count_nonzero(pick), b % n_shards)
            out += [(FETCH, *x) for x in by_part(home(doc[pick], th[pick], n_chunks), n_chunks, doc[pick], th[pick], first[pick], n[pick], shard, key[pick])]
            pick = later & mixed[group]
            if pick.any():
                out.append((USE, b % n_shards, pack(key[pick], doc[pick], th[pick], first[pick])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["kind", "part", "blob"])

    return dealt.mapInArrow(run, "kind int, part int, blob binary")


def _rows(table: pa.Table) -> dict[tuple[int, int], int]:
    docs, ths = table.column("doc").to_numpy(), table.column("th").to_numpy()
    return {k: i for i, k in reversed(list(enumerate(zip(docs.tolist(), ths.tolist(), strict=True))))}


def cut_segments(docs: pa.Table, wanted: pa.Table) -> pa.Table:
    """Segments of a chunk's documents, packed by shard."""
    doc, th, first, n, shard, key = gather(wanted.column("blob").to_pylist(), 6)
    at = _rows(docs)
    texts = docs.column("text")
    rows = np.array([at[k] for k in zip(doc.tolist(), th.tolist(), strict=True)], np.int64)
    order = np.argsort(rows, kind="stable")
    cut = [b""] * len(rows)
    last, raw = -1, b""
    for i in order.tolist():
        if rows[i] != last:
            last, raw = rows[i], texts[int(rows[i])].as_py().encode()
        cut[i] = raw[first[i] : first[i] + n[i]]
    out = []
    for s in np.unique(shard).tolist():
        pick = np.flatnonzero(shard == s)
        out.append((s, pack(key[pick], doc[pick], n[pick]) + b"".join(cut[i] for i in pick)))
    return pa.table({"shard": pa.array([r[0] for r in out], pa.int32()), "segments": pa.array([r[1] for r in out], pa.binary())})


def window_runs(texts: list[bytes], doc: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of a segment that have one smallest document: segment,
    first window, window after the last, document; ordered by segment."""
    sizes = np.array([len(t) for t in texts])
    first = np.cumsum(sizes + 1) - sizes - 1
    total = int(sizes.sum()) + len(texts)
    text = np.zeros(total, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    ends = np.repeat(first + sizes, sizes + 1)
    is_end = np.zeros(total, bool)
    is_end[first + sizes] = True
    text[~is_end] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    sa = induced_sort(text)
    # ends tell where a segment stops, so its bytes alone are compared, eight at once
    whole = common_prefixes(np.maximum(text - 1, 0), sa, length, ends) >= length
    run = np.cumsum(~whole) - 1
    lowest = np.full(run[-1] + 1, NO_ID, np.int64)
    # only suffixes with a whole window take part
    live = ends[sa] - sa >= length
    np.minimum.at(lowest, run[live], doc[owner[sa[live]]])
    source = np.empty(total, np.int64)
    source[sa] = lowest[run]
    place = np.flatnonzero(ends - np.arange(total) >= length)
    segment, source = owner[place], source[place]
    new = np.flatnonzero(np.r_[True, (segment[1:] != segment[:-1]) | (source[1:] != source[:-1])])
    segment = segment[new]
    start = place[new] - first[segment]
    return segment, start, start + np.diff(np.r_[new, len(place)]), source[new]


def pair_code(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(h.view(U) ^ mix(code.view(U)))


def repeated_ranges(length: int, n_chunks: int):
    """Per shard: the removed ranges of all uses of its segments."""

    def run(segments: pa.Table, uses: pa.Table) -> pa.Table:
        texts, keys, docs = [], [], []
        for blob in segments.column("segments").to_pylist():
            (key, doc, n), at = unpack(blob, 3)
            edge = at + np.r_[0, np.cumsum(n)]
            texts += [blob[edge[i] : edge[i + 1]] for i in range(len(n))]
            keys.append(key)
            docs.append(doc)
        if not texts or not uses.num_rows:
            return pa.table({"part": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        owner, start, end, source = window_runs(texts, np.concatenate(docs), length)
        runs = np.searchsorted(owner, np.arange(len(texts) + 1))
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        key, doc, th, first = gather(uses.column("blob").to_pylist(), 4)
        segment = order[np.searchsorted(keys[order], key)]
        # each use with each run of its segment
        n = runs[segment + 1] - runs[segment]
        use = np.repeat(np.arange(len(key)), n)
        pick = np.repeat(runs[segment], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        earlier = source[pick] < doc[use]
        use, pick = use[earlier], pick[earlier]
        cols = (doc[use], th[use], first[use] + start[pick], end[pick] - start[pick] - 1 + length)
        out = list(by_part(home(cols[0], cols[1], n_chunks), n_chunks, *cols))
        return pa.table({"part": pa.array([r[0] for r in out], pa.int32()), "blob": pa.array([r[1] for r in out], pa.binary())})

    return run


KEPT = "id long, n_bytes long, spans array<long>, kept binary"


def cut_out(docs: pa.Table, ranges: pa.Table) -> pa.Table:
    """Each document of a chunk without its ranges."""
    doc, th, first, n = gather(ranges.column("blob").to_pylist(), 4)
    order = np.lexsort((first, th, doc))
    doc, th, first, end = (x[order] for x in (doc, th, first, first + n))
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]) if len(doc) else np.zeros(0, np.int64)
    stop = np.r_[new[1:], len(doc)] if len(new) else new
    part = {(int(doc[a]), int(th[a])): (a, b) for a, b in zip(new, stop, strict=True)}
    n_bytes, spans, kept = [], [], []
    for d, t, text in zip(docs.column("doc").to_pylist(), docs.column("th").to_pylist(), docs.column("text"), strict=True):
        raw = (text.as_py() or "").encode()
        n_bytes.append(len(raw))
        a, b = part.get((d, t), (0, 0))
        joined: list[int] = []
        for s, e in zip(first[a:b].tolist(), end[a:b].tolist(), strict=True):
            if joined and s <= joined[-1]:
                joined[-1] = max(joined[-1], e)
            else:
                joined += [s, e]
        spans.append(joined)
        edges = [0, *joined, len(raw)]
        kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if joined else raw)
    ids = [None if d == NO_ID else d for d in docs.column("doc").to_pylist()]
    return pa.table({"id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 50, chunk_bytes: int = 16 << 20) -> DataFrame:
    """``id, n_bytes, spans, kept``: a row for each row of ``docs``.

    ``spans`` are the removed byte ranges (start, end, start, end, ...), joined
    where they touch; ``kept`` the remaining bytes. A null text is empty; a null
    id counts as larger than all others; rows of one id never remove each
    other's bytes; equal rows get equal results. An empty table gives an empty
    result; other columns are not used. ``chunk_bytes`` bounds the text that a
    task holds at once (a longer text is a chunk of its own).
    """
    if length < GRAM:
        raise ValueError(f"strings of fewer than {GRAM} bytes have no anchor")
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed, total = short_hash(keyed)
    n_chunks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // chunk_bytes))
    n_shards = 2 * n_chunks
    dealt = deal_anchors(keyed, 4 * n_chunks, length).repartition(n_chunks, "bucket")
    with released_shuffles(spark):  # else the anchors stay on disk beside the texts
        compared = settle(compare_anchors(dealt, n_chunks, n_shards))
    of_kind = lambda k: compared.filter(F.col("kind") == k).select("part", "blob")
    at_home = keyed.withColumn("chunk", home_column(F.col("doc"), F.col("th"), n_chunks))
    segments = at_home.groupBy("chunk").cogroup(of_kind(FETCH).groupBy("part")).applyInArrow(cut_segments, "shard int, segments binary")
    ranges = segments.groupBy("shard").cogroup(of_kind(USE).groupBy("part")).applyInArrow(repeated_ranges(length, n_chunks), "part int, blob binary")
    spans = of_kind(SPAN).unionByName(ranges)
    return at_home.groupBy("chunk").cogroup(spans.groupBy("part")).applyInArrow(cut_out, KEPT)
