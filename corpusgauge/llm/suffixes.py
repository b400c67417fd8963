"""Suffix arrays by induced sorting, and permuted common prefixes.

``induced_sort`` classifies the suffixes of a text as smaller (S) or larger (L)
than their right neighbour, sorts the leftmost-S substrings, names them, sorts
their sequence of names by recursion where names repeat, and induces the order
of all suffixes from theirs. For byte texts the two induction passes go bucket
by bucket: within a character's bucket, all suffixes whose place is already
known push their left neighbours into their buckets at once, as numpy arrays;
neighbours in the same bucket (runs of one character) make a further round. The
recursive texts have large alphabets and small buckets; they are sorted by
doubling the length that is known to agree, also as numpy arrays.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S type).

    The end of the text counts as a smallest character, so the last suffix is L.
    """
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    less, equal = text[:-1] < text[1:], text[:-1] == text[1:]
    # an equal pair takes the type to its right: the next place that isn't equal
    decided = np.where(equal, n, np.arange(n - 1))
    nxt = np.minimum.accumulate(decided[::-1])[::-1]
    known = nxt < n
    out[:-1][known] = less[nxt[known]]
    return out


def _induce_bytes(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix array from leftmost-S suffixes in order (byte alphabets)."""
    n, size = len(text), int(text.max()) + 1
    counts = np.bincount(text, minlength=size)
    tails = np.cumsum(counts)
    heads = tails - counts
    l_count = np.bincount(text[~s_type], minlength=size)
    sa = np.full(n, -1, np.int64)
    # leftmost-S suffixes of each bucket, in order
    order = np.argsort(text[lms], kind="stable")
    by_char = lms[order]
    first = np.searchsorted(text[by_char], np.arange(size + 1))
    fill = heads.copy()

    def push(places: np.ndarray, at: np.ndarray, step: int) -> None:
        """Put suffixes into their buckets, in order, from ``at`` on."""
        chars = text[places]
        ordered = np.argsort(chars, kind="stable")
        c = chars[ordered]
        new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        n_of = np.diff(np.r_[new, len(c)])
        within = np.arange(len(c)) - np.repeat(new, n_of)
        where = at[c] + within if step > 0 else at[c] - 1 - within
        sa[where] = places[ordered]
        at[c[new]] += step * n_of

    # L types, left to right; the last suffix stands before all
    if not s_type[n - 1]:
        push(np.array([n - 1]), fill, 1)
    for c in range(size):
        done = heads[c]
        while done < fill[c]:
            left = sa[done : fill[c]] - 1
            done = fill[c]
            left = left[left >= 0]
            left = left[~s_type[left]]
            if len(left):
                push(left, fill, 1)
        left = by_char[first[c] : first[c + 1]] - 1
        left = left[left >= 0]
        left = left[~s_type[left]]
        if len(left):
            push(left, fill, 1)
    # S types, right to left
    fill = tails.copy()
    for c in range(size - 1, -1, -1):
        done = tails[c]
        while done > fill[c]:
            left = sa[fill[c] : done][::-1] - 1
            done = fill[c]
            left = left[left >= 0]
            left = left[s_type[left]]
            if len(left):
                push(left, fill, -1)
        left = sa[heads[c] : heads[c] + l_count[c]][::-1] - 1
        left = left[left >= 0]
        left = left[s_type[left]]
        if len(left):
            push(left, fill, -1)
    return sa


def _double(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling (large alphabets): suffixes that agree on
    their first k characters are told apart by the ranks of the k behind those;
    a suffix that agrees with no other isn't looked at again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    live, key = np.arange(n), text[order]
    rank = np.empty(n, np.int64)
    k = 0
    while True:
        new = np.r_[True, key[1:] != key[:-1]]
        # a suffix ranks as the first place of those that it agrees with
        rank[order[live]] = live[np.flatnonzero(new)][np.cumsum(new) - 1]
        live = live[~(new & np.r_[new[1:], True])]
        if not len(live):
            return order
        k = max(1, 2 * k)
        at = order[live]
        behind = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + behind
        sort = np.argsort(key, kind="stable")
        order[live], key = at[sort], key[sort]


def induced_sort(text: np.ndarray) -> np.ndarray:
    """Suffix array of an array of small non-negative integers.

    The end counts as a smallest character of its own.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    if int(text.max()) >= 512:
        return _double(text)
    s_type = classify(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if not len(lms):
        return _induce_bytes(text, s_type, lms)
    # sort the leftmost-S substrings: induce from them in any order
    rough = _induce_bytes(text, s_type, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    # names: equal substrings get one; lengths up to the next leftmost-S place
    end = np.full(n, n, np.int64)
    end[lms[:-1]] = lms[1:]
    size = np.minimum(end[ordered] + 1, n) - ordered
    a, b = ordered[:-1], ordered[1:]
    same = (size[:-1] == size[1:]) & (end[a] < n) & (end[b] < n)
    live = np.flatnonzero(same)
    j = 0
    while len(live):
        equal = text[a[live] + j] == text[b[live] + j]
        same[live[~equal]] = False
        j += 1
        live = live[equal & (size[live] > j)]
    name_of = np.cumsum(np.r_[0, ~same])
    names = np.empty(n, np.int64)
    names[ordered] = name_of
    reduced = names[lms]
    if name_of[-1] + 1 < len(lms):
        sub = induced_sort(reduced)
        ordered = lms[sub]
    return _induce_bytes(text, s_type, ordered)


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int, ends: np.ndarray) -> np.ndarray:
    """Length, up to ``most``, that each suffix shares with the one before it in
    the array; ``ends[i]`` is where the string that holds place i ends.

    Values are made in text order (permuted), for all places at once: several
    characters are compared as one word, and places that agree on it go on.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    live = np.flatnonzero(before >= 0)
    prev = before[live]
    limit = np.zeros(n, np.int64)
    limit[live] = np.minimum(np.minimum(ends[live] - live, ends[prev] - prev), most)
    kind = np.min_scalar_type(int(text.max(initial=0)))
    per = 8 // kind.itemsize
    padded = np.zeros(n + most + per, kind)
    padded[:n] = text
    words = np.ndarray(n + most + 1, "<u8", padded.astype(kind.newbyteorder("<")).tobytes(), 0, (kind.itemsize,))
    shared = np.zeros(n, np.int64)
    j = 0
    while len(live := live[limit[live] > j]):
        apart = words[live + j] ^ words[before[live] + j]
        low = apart & -apart  # the lowest bit that differs
        same = np.where(apart == 0, per, (np.frexp(low.astype(np.float64))[1] - 1) // (8 * kind.itemsize))
        shared[live] = np.minimum(j + same, limit[live])
        live, j = live[apart == 0], j + per
    return shared[sa]
