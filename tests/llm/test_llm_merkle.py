"""Operator 13 against a manifest made by plain recursion."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusgauge.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos long"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, at):
    for row in tree[:-1]:
        lo = at // 3 * 3
        yield "".join(row[lo:at]), "".join(row[at + 1 : lo + 3])
        at //= 3


def brute(rows):
    by = {}
    for r in rows:
        i, text, lang, source, n = r[:5]
        cut = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        by.setdefault(source, []).append(((i is not None, i or 0), leaf(i, source, lang, n, text), leaf(i, source, lang, n, cut), i))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[1] for x in sorted(by[s])]) for s in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for at, (_, own, claim, i) in enumerate(sorted(by[s])):
            proof = [*path(trees[k], at), *path(top, k)]
            folded = claim
            for a, b in proof:
                folded = h(a + folded + b)
            out.append((i, own, trees[k][-1][0], top[-1][0], h("".join(a + b for a, b in proof)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(n):
    texts = [None, "", "one line", "two\nlines", "ünï\n\ncödé", "x" * 5000 + "\n", "\n"]
    rows = [(i, texts[i % 7], None if i % 11 == 0 else "en", None if i % 13 == 0 else ("é" if i % 5 == 0 else "hot"), i % 4 or None, "clash", 5) for i in range(n)]
    return [*rows, (3, "two\nlines", "en", "hot", 3, "clash", 5), (3, "two\nlines", "en", "hot", 3, "clash", 5), (None, "no id\n", "en", "hot", 1, "clash", 5), (None, None, None, None, None, None, None), (99, "alone", "de", "zz", 1, "x", 1)]


def proved(spark, rows, span):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    cut = F.when(merkle.tampered(F.col("doc_id")), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.verify_copy(docs, FIELDS, copy={"text": cut}, span=span)
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_matches_recursion(spark):
    for n, span in ((150, 2), (150, 7), (2, 1)):
        rows = rows_of(n)
        got = proved(spark, rows, span)
        assert got == brute(rows)
        if n > 2:
            assert {r[-1] for r in got} == {True, False}
    assert proved(spark, rows_of(1)[:1], 2) == brute(rows_of(1)[:1])
    assert proved(spark, [], 2) == []


def test_subset_proofs_fetch_what_is_missing(spark):
    """A few leaves are proved without the others of their blocks."""
    rows = rows_of(120)
    docs = spark.createDataFrame(rows, SCHEMA)
    own = merkle.leaf_digest(*[F.col(f) for f in FIELDS])
    made = merkle.manifest(docs.select("doc_id", "source", own.alias("leaf"), own.alias("claim")), "source", "doc_id", span=2)
    some = made.leaves.filter("doc_id % 17 = 3")
    got = {r.doc_id: (r.subroot, r.root, r.proof_sha256, r.verified) for r in merkle.prove(made, ["doc_id", "source"], some).collect()}
    want = {r[0]: (r[2], r[3], r[4]) for r in brute(rows) if r[0] in got}
    assert got and {k: v[:3] for k, v in got.items()} == want and all(v[3] for v in got.values())


def test_missing_coordinates_are_minimal():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 28, 81, 100):
        for _ in range(10):
            at = np.unique(rng.integers(0, n, rng.integers(1, 8)))
            got = set(merkle.missing(at, n, 3))
            known, want = set(at.tolist()), set()
            for level, width in enumerate(merkle.widths(n, 3)[:-1]):
                for i in known:
                    want |= {(level, j) for j in range(i // 3 * 3, min(i // 3 * 3 + 3, width)) if j not in known}
                known = {i // 3 for i in known}
            assert got == want
