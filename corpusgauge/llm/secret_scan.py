"""Secrets in texts: patterns, and a character convolutional network.

The patterns' findings (``base_spans``) always stay. The network judges every
candidate, that is every run of key characters that no pattern has found and
that looks unlike a word, together with the characters around it. It is a numpy
network over one-hot characters: one convolution, rectified, its largest and
mean response over the window, and a logistic unit. A character inside the
candidate is another symbol than the same character around it.

It learns from labelled findings. Where none are given, the patterns label all
texts (``weak_findings``): values assigned to a key's name are secrets;
candidates outside all patterns, long words and plain numbers aren't.
Since the name is what the pattern saw, half of the positive windows are shown with the surroundings of
other candidates. Every value is learnt from or held back: tasks train on their
shards, and after each round the mean of their weights goes on. Scores are
calibrated on all findings held back, and each shape of candidate has its own
threshold: the highest that still finds the demanded share of the held-back
secrets, but 0.5 at least.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.session import settle

#: Patterns in the order of their kinds, with the group and least length that a match needs. A run of hex
#: digits is a match as a whole, so shorter ones needn't be matched first; a short assigned value must be.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),
}
MODEL = "model"
KINDS = (*BASE, MODEL)

RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
UNLIKE_WORD = re.compile(r"[0-9]|[a-z][A-Z]+[a-z]|[a-z][A-Z]{2}")
SHAPES = ("digits", "hex", "mixed")

#: Characters of a window: before the candidate, of it, behind it.
LEFT, INSIDE, RIGHT = 24, 48, 12
WINDOW = LEFT + INSIDE + RIGHT
N_CHARS = 100
N_SYMBOLS = 2 * N_CHARS
WIDTH = 5

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans (start, end, kind) of all patterns by start, then kind."""
    return [m[:3] for m in base_matches(text)]


def base_matches(text: str) -> list[tuple[int, int, str, tuple[int, int]]]:
    """``base_spans``, each with the span of its value."""
    found = []
    for kind, (pattern, group, least) in BASE.items():
        found += [(m.start(), m.end(), kind, m.span(group)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of 12 key characters or more, without dots and the like around
    them, that hold a digit or change case within."""
    found = []
    for m in RUN.finditer(text):
        run = m[0]
        if run.isalpha() and run[1:].islower():
            continue
        inner = run.strip("._=/+-")
        if len(inner) >= 12 and UNLIKE_WORD.search(inner):
            start = m.start() + run.index(inner)
            found.append((start, start + len(inner)))
    return found


def overlaps(spans: list[tuple[int, int]], others: list[Span]) -> list[bool]:
    """Whether each of ``spans`` (sorted, disjoint) meets one of ``others``."""
    if not others or not spans:
        return [False] * len(spans)
    begin = np.array([o[0] for o in others])
    reach = np.maximum.accumulate([o[1] for o in others])
    at = np.searchsorted(begin, [s[1] for s in spans], "left") - 1
    return [bool(i >= 0 and reach[i] > s[0]) for i, s in zip(at.tolist(), spans, strict=True)]


def shape(value: str) -> str:
    if not re.search("[A-Za-z]", value):
        return "digits"
    return "hex" if re.fullmatch("[0-9a-fA-F]+", value) else "mixed"


#: Symbols of the code points: 1 to 95 for printable ASCII, 96 beyond ASCII, 97 for line breaks, 98 for the rest.
SYMBOL = np.full(129, 98, np.uint8)
SYMBOL[32:127], SYMBOL[128], SYMBOL[[10, 13]] = np.arange(1, 96), 96, 97


def symbols(text: str) -> np.ndarray:
    return SYMBOL[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def pieces(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """Each piece of ``INSIDE`` characters of a candidate, with its surroundings:
    the string, its characters before the piece, and of it; pieces cover the whole candidate."""
    starts = [*range(start, end - INSIDE + 1, INSIDE), end - INSIDE] if end - start > INSIDE else [start]
    return [(text[max(0, a - LEFT) : min(a + INSIDE, end) + RIGHT], min(a, LEFT), min(INSIDE, end - a)) for a in starts]


#: Pieces whose columns are found at once.
BLOCK = 1 << 14


def piece_windows(cut: list[tuple[str, int, int]]) -> np.ndarray:
    """Symbols of pieces and their surroundings, one row for each."""
    out = np.zeros((len(cut), WINDOW), np.uint8)
    for k in range(0, len(cut), BLOCK):
        texts, before, inside = zip(*cut[k : k + BLOCK], strict=True)
        size, before, inside = (np.array(n).reshape(-1, 1) for n in ([len(t) for t in texts], before, inside))
        # a piece starts at column LEFT
        at, rows = np.arange(WINDOW) - LEFT + before, out[k : k + BLOCK]
        rows[(at >= 0) & (at < size)] = symbols("".join(texts))
        rows[(at >= before) & (at < before + inside)] += N_CHARS
    return out


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Symbols of a candidate and its surroundings, one row for each piece."""
    return piece_windows(pieces(text, start, end))


@dataclass
class Network:
    """kernel[o, s, f]: weight of symbol s at offset o for filter f; out: weights
    of the largest and the mean responses; slope, shift: calibration; threshold:
    least score of each shape; learned, held: values it learnt from, and those held back."""

    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: dict[str, float] | None = None
    learned: int = 0
    held: int = 0

    def responses(self, x: np.ndarray) -> np.ndarray:
        made = np.broadcast_to(self.bias, (len(x), WINDOW - WIDTH + 1, len(self.bias))).copy()
        for o in range(WIDTH):
            made += np.take(self.kernel[o], x[:, o : WINDOW - WIDTH + 1 + o], 0)
        return np.maximum(made, 0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(x), 512):
            made = self.responses(x[at : at + 512])
            parts.append(np.concatenate([made.max(1), made.mean(1)], 1) @ self.out + self.prior)
        return np.concatenate(parts) if parts else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def started(filters: int = 24, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.1, (WIDTH, N_SYMBOLS, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.3, 2 * filters).astype(np.float32), 0.0)
    net.kernel[:, 0] = 0
    return net


class Trainer:
    """Fits a network by Adam on the logistic loss, both classes weighing the same."""

    def __init__(self, net: Network, seed: int, rate: float = 0.01, batch: int = 128) -> None:
        self.net, self.rng, self.rate, self.batch, self.step = net, np.random.default_rng(seed), rate, batch, 0
        self.params = [net.kernel, net.bias, net.out, np.full(1, net.prior, np.float32)]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params]

    def batches(self, y: np.ndarray) -> Iterator[np.ndarray]:
        """All rows, with a quarter of each batch at least from the rarer class."""
        few, many = sorted((self.rng.permutation(np.flatnonzero(y > 0)), self.rng.permutation(np.flatnonzero(y == 0))), key=len)
        k = -(-len(y) // self.batch)
        if len(few):
            few = np.resize(few, max(len(few), k * self.batch // 4))
        for a, b in zip(np.array_split(few, k), np.array_split(many, k), strict=True):
            yield np.concatenate([a, b])

    def learn(self, x: np.ndarray, y: np.ndarray, epochs: int) -> None:
        for _ in range(epochs):
            for part in self.batches(y):
                self.descend(x[part].astype(np.int64), y[part])
        self.net.prior = float(self.params[3][0])

    def descend(self, xb: np.ndarray, yb: np.ndarray) -> None:
        net, filters, n_at = self.net, len(self.net.bias), WINDOW - WIDTH + 1
        made = net.responses(xb)
        top = made.argmax(1)
        pooled = np.concatenate([np.take_along_axis(made, top[:, None], 1)[:, 0], made.mean(1)], 1)
        p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + self.params[3][0], -30, 30)))
        weight = np.where(yb > 0, 0.5 / max(yb.sum(), 1), 0.5 / max((1 - yb).sum(), 1)).astype(np.float32)
        err = (p - yb) * weight / weight.sum()
        back = err[:, None] * net.out
        flow = np.repeat(back[:, None, filters:] / n_at, n_at, 1)
        rows, cols = np.arange(len(xb))[:, None], np.arange(filters)[None]
        flow[rows, top, cols] += back[:, :filters]
        flow *= made > 0
        kernel = np.zeros_like(net.kernel)
        flat = flow.reshape(-1, filters)
        for o in range(WIDTH):
            symbol = xb[:, o : n_at + o].astype(np.uint8).ravel()
            order = np.argsort(symbol, kind="stable")
            first = np.flatnonzero(np.r_[True, symbol[order][1:] != symbol[order][:-1]])
            kernel[o, symbol[order[first]]] = np.add.reduceat(np.take(flat, order, 0), first, 0)
        self.step += 1
        for q, g, (m, v) in zip(self.params, [kernel, flow.sum((0, 1)), pooled.T @ err, err.sum(keepdims=True)], self.moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= self.rate * ((m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8) + 1e-4 * q)


#: Steps of the raw score, on each side of 0, by which held-back findings are counted.
STEPS = 10_000


def calibrate(net: Network, at: np.ndarray, n: np.ndarray, y: np.ndarray, shapes: np.ndarray, scale: float, recall: float) -> None:
    """Logistic calibration of the raw score by Newton iterations, then thresholds,
    from ``n`` findings of label ``y`` and a shape at step ``at`` of the score."""
    z, good, bad = at / STEPS, float(n[y > 0].sum()), float(n[y == 0].sum())
    # smoothed targets keep the fit finite where the classes part without error
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    design, w = np.stack([z, np.ones_like(z)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        w -= np.linalg.solve(hess, design.T @ (n * (p - target)) + 1e-6 * w)
    net.slope, net.shift = float(w[0] / scale), float(w[1])
    # a step's lower end, so that all findings of the step are found
    score = 1 / (1 + np.exp(-np.clip(w[0] * (z - 0.5 / STEPS) + w[1], -30, 30)))

    def least(own: np.ndarray) -> float:
        """The highest threshold that finds the demanded share, 0.5 at least."""
        order = np.argsort(score[own], kind="stable")
        passed = np.cumsum(n[own][order])
        return max(0.5, float(score[own][order][np.searchsorted(passed, int((1 - recall) * passed[-1]), "right")]))

    overall = least(y > 0)
    net.threshold = {s: least(own) if n[own := (y > 0) & (shapes == s)].sum() >= 20 else overall for s in SHAPES}


def blank(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Windows of pieces in the surroundings of other windows."""
    out = np.where(own >= N_CHARS, own, 0)
    out[:, :LEFT] = others[:, :LEFT]
    rows, behind = np.arange(len(own))[:, None], LEFT + np.arange(RIGHT)
    out[rows, (own >= N_CHARS).sum(1)[:, None] + behind] = others[rows, (others >= N_CHARS).sum(1)[:, None] + behind]
    return out


FINDINGS = T.StructType([T.StructField("before", T.StringType()), T.StructField("value", T.StringType()), T.StructField("behind", T.StringType()), T.StructField("label", T.IntegerType())])


def weak_findings(docs: DataFrame, text: str) -> DataFrame:
    """``before, value, behind, label`` of all runs that patterns label.

    1: assigned values and access keys. 0: candidates that meet no pattern,
    words of 12 letters or more, and numbers that only pass for hex.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                matches, spots = base_matches(t), candidates(t)
                spans = [m[:3] for m in matches]
                taken = overlaps(spots, spans)
                sure = [m[3] for m in matches if m[2] == "assign"] + [m[3] for m in matches if m[2] == "access"]
                unlike = [s for s, meets in zip(spots, taken, strict=True) if not meets]
                unlike += [m.span() for m in RUN.finditer(t) if m[0].isalpha() and m[0][1:].islower()]
                numbers = [(a, b, k) for a, b, k in spans if k == "hex" and t[a:b].isdecimal()]
                unlike += [n[:2] for n, meets in zip(numbers, overlaps([n[:2] for n in numbers], sorted((a, b, "") for a, b in sure)), strict=True) if not meets]
                for label, found in ((1, sure), (0, unlike)):
                    rows += [(t[max(0, a - LEFT) : a], t[a:b], t[b : b + RIGHT], label) for a, b in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) if k < 3 else pa.array(c, pa.int32()) for k, c in enumerate(zip(*rows, strict=True))], FINDINGS.names)

    return docs.select(text).mapInArrow(run, FINDINGS)


def shown(batch: pa.RecordBatch, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """First windows of findings, their labels and shapes; a secret also stands
    in the surroundings of another finding of the batch that is none."""
    before, value, behind, label = (batch.column(c).to_pylist() for c in FINDINGS.names)
    x = piece_windows([pieces((p or "") + v + (q or ""), len(p or ""), len(p or "") + len(v))[0] for p, v, q in zip(before, value, behind, strict=True)])
    y, shapes = np.array(label, np.float32), [shape(v) for v in value]
    secret, plain = np.flatnonzero(y), x[y == 0]
    if len(plain):
        x = np.concatenate([x, blank(x[secret], plain[rng.integers(0, len(plain), len(secret))])])
        y = np.concatenate([y, np.ones(len(secret), np.float32)])
        shapes += [shapes[k] for k in secret]
    return x, y, shapes


#: Values that a task trains on in a round, up to so many tasks; beyond that tasks train on more.
SHARD, MOST_SHARDS = 20_000, 64

#: Values that a shard reads in a round, if need be some repeatedly.
ENOUGH = 16_000


def rounded(net: Network, values: DataFrame, shards: int, epochs: int, seed: int) -> Network:
    """The mean of networks that went on from ``net`` on all values of a shard each."""
    shared = values.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = shared.value
        own = Network(begin.kernel.copy(), begin.bias.copy(), begin.out.copy(), begin.prior)
        shard, n = TaskContext.get().partitionId(), 0
        trainer = Trainer(own, seed * 1009 + shard)
        for batch in batches:
            if batch.num_rows:
                x, y, _ = shown(batch, trainer.rng)
                trainer.learn(x, y, epochs)
                n += batch.num_rows
        if n:
            weights = np.concatenate([p.ravel() for p in trainer.params]).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([n]), pa.array([weights])], ["shard", "n", "weights"])

    dealt = values.repartition(shards, "value").sortWithinPartitions(F.xxhash64("value"), "value", "label")
    made = sorted(dealt.select(*FINDINGS.names).mapInArrow(run, "shard long, n long, weights binary").collect())
    mean = np.average([np.frombuffer(r.weights, np.float32) for r in made], 0, [r.n for r in made]).astype(np.float32)
    kernel, bias, out, prior = np.split(mean, np.cumsum([net.kernel.size, net.bias.size, net.out.size]))
    return Network(kernel.reshape(net.kernel.shape), bias, out, float(prior[0]))


def raw_scores(net: Network, values: DataFrame, seed: int) -> DataFrame:
    """``label, shape, z`` of the windows of all values."""
    shared = values.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y, shapes = shown(batch, np.random.default_rng(seed))
                yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(shapes), pa.array(shared.value.raw(x).astype(np.float64))], ["label", "shape", "z"])

    return values.select(*FINDINGS.names).mapInArrow(run, "label int, shape string, z double")


def fit(findings: DataFrame, recall: float = 0.95, seed: int = 5, rounds: int = 3, epochs: int | None = None) -> Network | None:
    """Train and calibrate on all findings, each value of a label once; None
    where one label has fewer than 20 different values.

    Values are split by hash: a fifth is held back for calibration, so no value
    is in both parts. A value's shard and place come from its hash too. A round
    reads each value ``epochs`` times; by default four times where shards are
    small, once where a shard alone has values enough for the steps that takes.
    """
    values = findings.groupBy("label", "value").agg(F.min(F.struct("before", "behind")).alias("x"))
    values = settle(values.select("x.before", "value", "x.behind", "label", (F.pmod(F.xxhash64("value", F.lit("held")), F.lit(5)) == 0).alias("held")))
    n = {(r.label, r.held): r.n for r in values.groupBy("label", "held").agg(F.count("*").alias("n")).collect()}
    of = lambda *keys: sum(n.get(k, 0) for k in keys)
    if min(of((c, False), (c, True)) for c in (0, 1)) < 20 or min(of((c, h)) for c in (0, 1) for h in (False, True)) < 1:
        return None
    learned = of((0, False), (1, False))
    shards = min(MOST_SHARDS, -(-learned // SHARD))
    if epochs is None:
        epochs = min(4, -(-ENOUGH * shards // learned))
    net = started(seed=seed)
    for k in range(rounds):
        net = rounded(net, values.filter("NOT held"), shards, epochs, seed + k)
    net.learned, net.held = learned, of((0, True), (1, True))
    scored = settle(raw_scores(net, values.filter("held").repartition(shards, "value").sortWithinPartitions("value", "label"), seed))
    scale = max(scored.agg(F.max(F.abs("z"))).first()[0], 1e-6)
    counted = scored.groupBy("label", "shape", F.round(F.col("z") / scale * STEPS).cast("int").alias("at")).agg(F.count("*").alias("n")).orderBy("at", "label", "shape").collect()
    at, many, y = (np.array([r[c] for r in counted], np.float64) for c in ("at", "n", "label"))
    calibrate(net, at, many, y, np.array([r["shape"] for r in counted]), scale, recall)
    return net


def model_spans(texts: list[str], spots: list[list[tuple[int, int]]], net: Network) -> list[list[Span]]:
    """Candidates of each text whose score reaches their shape's threshold."""
    cut, owner = [], []
    for t, own in enumerate(spots):
        for k, (a, b) in enumerate(own):
            found = pieces(texts[t], a, b)
            cut += found
            owner += [(t, k)] * len(found)
    out: list[list[Span]] = [[] for _ in texts]
    if cut:
        best: dict[tuple[int, int], float] = {}
        for key, s in zip(owner, net.score(piece_windows(cut)).tolist(), strict=True):
            best[key] = max(s, best.get(key, 0.0))
        for (t, k), s in best.items():
            a, b = spots[t][k]
            if s >= net.threshold[shape(texts[t][a:b])]:
                out[t].append((a, b, MODEL))
    return out


def scan(docs: DataFrame, text: str = "text", net: Network | None = None) -> DataFrame:
    """``docs`` without its text, with ``n_<kind>`` for each kind, ``spans``
    and ``base`` (kind:start:end, by start, then kind, comma-joined).

    Every whole text is searched; a null or empty text has no spans. Rows are
    judged one by one, so repeated rows and ids get equal results; columns named
    like a result are replaced, others are kept; an empty table stays empty.
    Without a network only the patterns decide.
    """
    counts = [f"n_{k}" for k in KINDS]
    added = [*counts, "base", "spans"]
    kept = [c for c in docs.columns if c != text and c not in added]
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(c, T.LongType()) for c in counts], T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    def joined(spans: list[Span]) -> str:
        return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            base = [base_spans(t) for t in texts]
            every = base
            if net is not None:
                spots = [candidates(t) for t in texts]
                spots = [[s for s, meets in zip(own, overlaps(own, b), strict=True) if not meets] for own, b in zip(spots, base, strict=True)]
                every = [sorted(b + m, key=lambda s: (s[0], KINDS.index(s[2]))) for b, m in zip(base, model_spans(texts, spots, net), strict=True)]
            numbers = [pa.array([sum(s[2] == k for s in own) for own in every], pa.int64()) for k in KINDS]
            words = [pa.array([joined(own) for own in which], pa.string()) for which in (base, every)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], *numbers, *words], [*kept, *added])

    return docs.select(text, *kept).mapInArrow(run, schema)


def find_secrets(docs: DataFrame, text: str = "text", findings: DataFrame | None = None, **options) -> DataFrame:
    """``scan`` with a network fitted to ``findings`` (before, value, behind,
    label), or else to what the patterns label in all documents."""
    return scan(docs, text, fit(weak_findings(docs, text) if findings is None else findings, **options))
