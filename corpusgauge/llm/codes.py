"""Vectorised word codes over Arrow string columns.

Python workers get texts as Arrow batches. The functions here turn runs of
whole texts into numpy arrays: positions of words and a 64-bit code for each,
from a polynomial over the word's bytes (mod 2**64, odd base, so that a power
can be divided out). Equal words get equal codes; different words collide with
a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: A byte belongs to a word: all but ASCII white space.
NON_SPACE = np.ones(256, bool)
NON_SPACE[list(SPACES)] = False
#: A byte belongs to a word: ASCII letters and digits, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(18, int(n).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=U)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_slices(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first row, bytes, offsets.

    A null is an empty text. A text longer than ``size`` is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        to = min(to, n)
        yield at, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


class Words:
    """Words of a run of texts.

    starts, ends: byte positions; codes: 64-bit codes; first[i]: index of the
    first word of text i (one more entry than texts); text: text of each word.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray, lower: bool) -> None:
        n = len(buf)
        inside = table[buf]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:n]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        if lower:
            buf = buf + (((buf >= 65) & (buf <= 90)).astype(np.uint8) << 5)
        self.buf, self.offs = buf, offs
        self.codes = mix(self.spans(self.starts, self.ends))
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offs) - 1), self.counts)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Raw codes of byte spans."""
        if not hasattr(self, "_sums"):
            up, _ = _powers(len(self.buf) + 1)
            self._sums = np.zeros(len(self.buf) + 1, U)
            np.cumsum((self.buf.astype(U) + U(1)) * up[: len(self.buf)], out=self._sums[1:])
        _, down = _powers(len(self.buf) + 1)
        return (self._sums[ends] - self._sums[starts]) * down[starts]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all k-word windows inside a text, and their codes."""
        total = len(self.codes)
        if total < k:
            return np.zeros(0, np.int64), np.zeros(0, U)
        codes = self.codes[: total - k + 1].copy()
        for j in range(1, k):
            codes = codes * U(BASE) + self.codes[j : total - k + 1 + j]
        at = np.flatnonzero(self.text[: total - k + 1] == self.text[k - 1 :])
        return at, mix(codes[at] + U(k))

    def whole(self, i: int) -> np.uint64:
        """Code of all words of text i as one sequence."""
        code = U(0)
        with np.errstate(over="ignore"):
            for c in self.codes[self.first[i] : self.first[i + 1]]:
                code = code * U(BASE) + c
            return mix(np.array([code + U(self.counts[i])], U))[0]


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of set flags between consecutive offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts keys, the starts of equal runs in it, their lengths."""
    order = np.argsort(keys, kind="stable")
    if not len(keys):
        return order, np.zeros(0, np.int64), np.zeros(0, np.int64)
    ordered = keys[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return order, starts, np.diff(np.r_[starts, len(keys)])
