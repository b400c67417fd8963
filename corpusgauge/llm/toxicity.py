"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words and the beginnings of its
longer words; a beginning that a second and a third distinct word share is a
term again each time, so that families of a word count and not only the forms
that were seen. All terms are hashed into a fixed number of slots, and every
slot has a weight and factors: no term of a text is left out. A term enters with
a value, the evidence that the labelled rows hold for its slot, so that words
of a single row can't carry a score.

The score is the logistic of a bias, the weights and, for each pair of terms,
the dot product of their factors; pairs such as an insult with a group's name
get a weight that the sum of the two words' weights can't give.

The machine is fitted on a sample of labelled rows of bounded size (``max_rows``,
``max_bytes``). Every whole text is scored, in Arrow batches, with the fitted
arrays as a broadcast of fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.llm.codes import ALNUM, U, Words, mix, text_slices
from corpusgauge.llm.mixing import uniform
from corpusgauge.llm.texts import per_row

SLOT_BITS = 18

#: Lengths in bytes of the beginnings of longer words, and how often one counts.
BEGINNINGS = (4, 5, 6, 7)
LEVELS = 3


@dataclass
class Machine:
    """By slot: value that its term enters with, weight and factors."""

    values: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def slots(codes: np.ndarray) -> np.ndarray:
    return (codes >> U(64 - SLOT_BITS)).astype(np.int64)


def beginning_code(prefix: np.ndarray, size: int, level: np.ndarray) -> np.ndarray:
    return mix(mix(prefix + U(size)) + level.astype(U))


def terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and slot of each distinct term, by text."""
    w = Words(buf, offs, ALNUM, lower=True)
    _, first = np.unique(mix(w.codes + mix(w.text.astype(U))), return_index=True)
    text, starts, ends = w.text[first].astype(np.int64), w.starts[first], w.ends[first]
    found = [(text << SLOT_BITS) | slots(w.codes[first])]
    for size in BEGINNINGS:
        long = ends - starts > size
        code, own = w.spans(starts[long], starts[long] + size), text[long]
        order = np.lexsort((code, own))
        code, own = code[order], own[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(new)
        level = np.arange(len(code)) - np.repeat(at, np.diff(np.r_[at, len(code)])) + 1
        kept = level <= LEVELS
        found.append((own[kept] << SLOT_BITS) | slots(beginning_code(code[kept], size, level[kept])))
    keys = np.unique(np.concatenate(found))
    return keys >> SLOT_BITS, keys & ((1 << SLOT_BITS) - 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, max_rows: int, max_bytes: int, seed: int) -> DataFrame:
    """About ``max_rows`` labelled documents at most, and about ``max_bytes`` of
    their texts, picked by a hash of the id; larger texts aren't learnt from."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("_label"))
    n = known.count()
    if n > max_rows:
        known = known.filter(uniform(F.col(id_col), seed) < max_rows / n)
    both = docs.join(F.broadcast(known), id_col)  # at most max_rows rows
    size = F.octet_length(F.coalesce(text, F.lit("")))
    both = both.filter(size <= max_bytes // 16)
    total = both.agg(F.sum(size)).first()[0] or 0
    return both if total <= max_bytes else both.filter(uniform(F.col(id_col), seed + 1) < max_bytes / total)


def packed_terms(sample: DataFrame, text: str) -> DataFrame:
    """``label, slots``: the slots of a document as packed numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for _, buf, offs in text_slices(batch.column(0)):
                row, slot = terms(buf, offs)
                ends = np.searchsorted(row, np.arange(len(offs)))
                packed += [slot[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int64()), pa.array(packed, pa.binary())], ["label", "slots"])

    return sample.select(text, F.col("_label").cast("long").alias("label")).mapInArrow(run, "label long, slots binary")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 12_000, max_bytes: int = 64 << 20, n_factors: int = 4, seed: int = 7) -> Machine:
    """Fit the machine to the labels of ``docs``; both may be any subset.

    Without a row of either class every score is the share of toxic rows.
    """
    sample = labelled_sample(docs.select(id_col, text), labels.select(id_col, label), id_col, text, label, max_rows, max_bytes, seed)
    got = packed_terms(sample, text).toArrow()
    # views of the Arrow buffers: the sample is held once
    rows = [np.frombuffer(x.as_buffer(), np.int32) if x.as_buffer().size else np.zeros(0, np.int32) for x in got.column("slots")]
    y = (got.column("label").to_numpy() > 0).astype(np.float32)
    # the order of rows is by the sample's content, not that of the partitions
    order = sorted(range(len(rows)), key=lambda i: (hashlib.blake2b(rows[i]).digest(), y[i]))
    return train([rows[i] for i in order], y[order], n_factors, seed)


def evidence(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Value of each slot: the squared difference of its share among toxic and
    other rows in standard errors (hundredths, bounded), and a little by how many
    toxic rows have it, for pairs of which neither term tells by itself."""
    share = y.mean()
    with_term, toxic_with = np.zeros(size), np.zeros(size)
    for row, toxic in zip(rows, y, strict=True):  # a slot is in a row once
        with_term[row] += 1
        if toxic:
            toxic_with[row] += 1
    z = np.abs(toxic_with - with_term * share) / np.sqrt(with_term * share * (1 - share) + 1.0)
    return (np.minimum(z / 10, 1.5) ** 2 + 0.3 * np.sqrt(toxic_with / max(y.sum(), 1))).astype(np.float32)


def train(rows: list[np.ndarray], y: np.ndarray, n_factors: int = 4, seed: int = 7, size: int = 1 << SLOT_BITS, batch: int = 128, rate: float = 0.1, decay: float = 1e-3) -> Machine:
    """Adagrad on the logistic loss; toxic rows weigh four times."""
    n, pos = len(y), float(y.sum())
    if not 0 < pos < n:
        share = min(max(pos / n if n else 0.0, 1e-6), 1 - 1e-6)
        return Machine(np.zeros(size, np.float32), float(np.log(share / (1 - share))), np.zeros(size, np.float32), np.zeros((size, n_factors), np.float32))
    values = evidence(rows, y, size)
    rng = np.random.default_rng(seed)
    params = np.zeros((size, 1 + n_factors), np.float32)
    params[:, 1:] = rng.normal(0, 0.02, (size, n_factors))
    squares, bias, bias_square = np.full_like(params, 1e-4), np.log(pos / (n - pos)), 1e-4
    for _ in range(int(min(max(30_000 // n, 3), 60))):
        for part in np.array_split(rng.permutation(n), max(1, n // batch)):
            who = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            used, back = np.unique(np.concatenate([rows[i] for i in part]), return_inverse=True)
            x = values[used][back]
            p = (params[used] * values[used][:, None])[back]
            raw, sums = raw_scores(p, who, len(part), bias)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) * (1 + 3 * y[part])
            grad = np.empty_like(p)
            grad[:, 0] = err[who] * x
            grad[:, 1:] = grad[:, :1] * (sums[who] - p[:, 1:])
            grad = np.stack([np.bincount(back, grad[:, k], len(used)) for k in range(1 + n_factors)], 1) / len(part) + decay * params[used]
            squares[used] += grad**2
            params[used] -= rate * grad / np.sqrt(squares[used])
            bias_square += err.mean() ** 2
            bias -= rate / 2 * err.mean() / np.sqrt(bias_square)
    return Machine(values, float(bias), params[:, 0], params[:, 1:])


def raw_scores(p: np.ndarray, who: np.ndarray, n: int, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Score before the logistic of n rows, and the sums of their factors, from
    weight and factors (times value) of each of their terms."""
    sums = np.stack([np.bincount(who, p[:, k], n) for k in range(1, p.shape[1])], 1) if p.shape[1] > 1 else np.zeros((n, 0))
    own = np.bincount(who, (p[:, 1:].astype(np.float64) ** 2).sum(1), n)
    return bias + np.bincount(who, p[:, 0], n) + 0.5 * ((sums**2).sum(1) - own), sums


def score_texts(docs: DataFrame, machine: Machine, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``score``: the chance of label 1, for every whole text.

    A null or empty text has no terms and gets the bias alone.
    """
    entering = np.column_stack([machine.weights, machine.factors]) * machine.values[:, None]
    shared = docs.sparkSession.sparkContext.broadcast((entering.astype(np.float32), machine.bias))

    def of(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
        by_slot, bias = shared.value
        row, slot = terms(buf, offs)
        raw, _ = raw_scores(by_slot[slot], row, len(offs) - 1, bias)
        return {"score": 1 / (1 + np.exp(-np.clip(raw, -30, 30)))}

    return per_row(docs, text, {"score": T.DoubleType()}, of, keep_text)


def held_out(id_col: Column) -> Column:
    """The fold that is never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", train_docs: DataFrame | None = None, keep_text: bool = False, **options) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``.

    Learns from labelled rows outside the held-out fold only, of ``train_docs``
    or else of ``docs``. Null ids are never learnt from and get a score like
    others; an id that is labelled twice counts as toxic if one label says so;
    repeated rows are scored one by one; an empty table gives an empty result.
    Columns named like a result are replaced, others are kept.
    """
    known = labels.filter(~held_out(F.col(id_col)))
    machine = fit(train_docs if train_docs is not None else docs, known, id_col, text, label, **options)
    scored = score_texts(docs.drop("held_out", "score", "predicted"), machine, text, keep_text)
    return scored.withColumn("held_out", held_out(F.col(id_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
