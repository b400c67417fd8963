"""Operator 11 against counts in plain dictionaries."""

import random
import re
from collections import Counter

import numpy as np

from corpusgauge.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, covered=50, top=2000):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in (1, 2, 3):
                for k in range(len(words) - m + 1):
                    f[lang, *words[k : k + m]] += 1
    often = {k: a for k, a in f.items() if a >= least}
    best = {}
    for (lang, *w), a in often.items():
        cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        if cuts:
            score, k = min(cuts)
            best[lang, *w] = (score, a, f[lang, *w[:k]], f[lang, *w[k:]])
    inside = Counter()
    for key, (_, a, _, _) in best.items():
        if len(key) == 4:
            for part in (key[:3], (key[0], *key[2:])):
                inside[part] = max(inside[part], a)
    out = []
    for lang in n:
        own = sorted((-s, -a, " ".join(key[1:]).encode(), left, r) for key, (s, a, left, r) in best.items() if key[0] == lang and not (len(key) == 3 and 100 * inside[key] >= covered * a and inside[key]))
        out += [(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(own[:top])]
    return sorted(out)


def made(seed, n_docs=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Öl", "ÉTÉ", "x-y", "\x00z", "hot"]
    rows = []
    for i in range(n_docs):
        text = "".join(rng.choice(words[: rng.choice([6, 20, 45])]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ? "]) for _ in range(rng.randrange(0, 60)))
        if i % 3 == 0:
            text = f"very hot pair {rng.choice(words)} " * 5 + text
        rows.append((text, rng.choice(["en", "en", "de", None, "und", ""])))
    return [*rows, (None, "en"), ("", None), ("   \n\t.", "de"), *[rows[0]] * 12, ("one two three " * 30_000, "fr")]


def run(spark, rows, **options):
    docs = spark.createDataFrame([(t, lang, 1, "clash", i) for i, (t, lang) in enumerate(rows)], "text string, lang string, a int, phrase string, doc_id long").repartition(3)
    return sorted(tuple(r) for r in co.collocations(docs, **options).collect())


def test_phrases_match_brute_force(spark):
    rows = made(1)
    assert run(spark, rows) == brute(rows)


def test_many_shards_hot_words_and_short_lists(spark):
    """Small chunks and shards: hot pairs are split over shards by all words."""
    rows = made(2)
    assert run(spark, rows, chunk_words=200, shard_words=800, hot_words=100, top=7, least=4) == brute(rows, least=4, top=7)
    assert run(spark, [], top=5) == []


def test_equal_partitions_count_prefixes():
    rng = np.random.default_rng(0)
    keys = rng.integers(1, 9, (3, 4000)).astype(np.uint64)
    keys[2, rng.random(4000) < 0.2] = 0
    weight = rng.integers(1, 4, 4000)
    for least in ((10, 10, 10), (1, 1, 30), (1, 1, 1)):
        for d, (at, a) in enumerate(co.equal_partitions(keys, weight, least)):
            want = Counter()
            for i in range(4000):
                if keys[d, i]:
                    want[tuple(keys[: d + 1, i].tolist())] += int(weight[i])
            got = {tuple(keys[: d + 1, i].tolist()): int(w) for i, w in zip(at, a, strict=True)}
            assert got == {k: w for k, w in want.items() if w >= least[d]} and len(got) == len(at)


def test_score_is_exact_beyond_64_bits(spark):
    a, left, r = 123_456_789_012, 987_654_321_098, 135_791_357_913_579
    row = spark.sql(f"SELECT {a}L AS a, {left}L AS l, {r}L AS r").select(co.cut_score("a", "l", "r")).first()
    assert row[0] == 1_000_000 * a * a // (left * r)
