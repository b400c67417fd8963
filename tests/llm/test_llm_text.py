"""Operators that judge or change single texts: 5, 7, 8, 9, 10."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgauge.llm import decontaminate, mixing, pii, quality
from corpusgauge.llm import toxicity as tox
from corpusgauge.llm.codes import ALNUM, NON_SPACE, Words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t ", "é", "Ünï cödé \x0b ça", "a" * 5000 + " b", "word " * 3000, "x\r\ny\x00z \x1c w"]


def docs_of(spark, rows, schema="doc_id long, text string, lang string, source string, n_words string, kept int"):
    return spark.createDataFrame([(i, t, l, s, "clash", 1) for i, t, l, s in rows], schema)


def test_word_codes_agree_with_regular_expressions():
    import numpy as np

    texts = [t or "" for t in ODD] + ["AB abÄ 12-x"]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *[len(r) for r in raw]])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    for table, pattern in ((NON_SPACE, rb"[^\x20\x09-\x0D]+"), (ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Words(buf, offs, table, lower=True)
        want = [(i, m) for i, r in enumerate(raw) for m in re.findall(pattern, r.lower())]
        got = [bytes(buf[s:e]).lower() for s, e in zip(w.starts, w.ends, strict=True)]
        assert [m for _, m in want] == got
        assert [i for i, _ in want] == w.text.tolist()
        by_code = {}
        for word, code in zip(got, w.codes.tolist(), strict=True):
            assert by_code.setdefault(word, code) == code
        assert len(set(by_code.values())) == len(by_code)


# ---- 8 ----------------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {g for g in grams if grams.count(g) > 1} if len(grams) < 500 else None
    if many is None:
        from collections import Counter

        many = {g for g, n in Counter(grams).items() if n > 1}
    covered = {j for i, g in enumerate(grams) if g in many for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(1)
    texts = ODD + ["a b c d e a b c d e\nx\nx\n\n \n x", "l\nl\nl", "#$%&|<>* é"] + [" ".join(rng.choice("abc") + rng.choice(["", "\n", "#"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    df = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: tuple(r[c] for c in quality.BASE_COLUMNS) for r in quality.with_counts(df).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def clean(rng, n=60):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_quality_thresholds_adapt_and_spare_clean_texts(spark):
    rng = random.Random(2)
    rows = [(i, clean(rng), "en", "plain") for i in range(120)]
    # a source in which a third of all words carry a mark: usual there, odd elsewhere
    marked = lambda: " ".join(w + (" #" if k % 3 == 0 else "") for k, w in enumerate(clean(rng).split()))
    rows += [(1000 + i, marked(), "en", "marked") for i in range(120)]
    rows += [(5000, re.sub(r"(\w+)", r"\1##%%", clean(rng)), "en", "plain"), (5001, marked(), None, None), (5002, None, "en", "plain"), (5003, clean(rng), "en", "tiny")]
    got = {r.doc_id: r for r in quality.quality_filter(docs_of(spark, rows + rows[:1]), spread=1.5).collect()}
    assert all(got[i].kept for i in range(120))
    assert not got[5000].kept and got[5000].failed_rules == ["symbol_ratio"]
    assert sum(got[1000 + i].kept for i in range(120)) > 110
    assert got[5002].base_failed and not got[5002].kept
    assert got[5003].kept and got[5001].base_failed is False
    empty = quality.quality_filter(docs_of(spark, []))
    assert empty.count() == 0 and "kept" in empty.columns


def test_quality_limits_follow_the_values(spark):
    rng = random.Random(4)
    # a few symbols in every fifth text; lines in each, one doubled in every fifth
    text = lambda i: "\n".join([clean(rng, 5) for _ in range(20 + i % 7)]) + (" #" * (1 + i % 3) + "\nsaid twice\nsaid twice" if i % 5 == 0 else "")
    rows = [(i, text(i), "en", "plain") for i in range(600)]
    rows += [(1000, text(0) + " #" * 12, "en", "plain"), (1001, text(1) + "\nagain\n" * 9, "en", "plain"), (1002, " ".join(clean(rng).replace(" ", "")[:9] for _ in range(60)), "en", "plain")]
    got = {r.doc_id: r for r in quality.quality_filter(docs_of(spark, rows)).collect()}
    # none of the three is beyond a fixed 0.10 of its characters or words, or 14 letters a word
    assert "symbol_ratio" in got[1000].failed_rules and got[1000].n_symbols < 0.10 * got[1000].word_chars
    assert "dup_line_ratio" in got[1001].failed_rules and got[1001].n_dup_lines < 0.10 * got[1001].n_words
    assert got[1002].failed_rules == ["long_words"]
    assert sum(got[i].kept for i in range(600)) > 590
    # a corpus of 20 texts has limits of its own values too
    few = quality.quality_filter(docs_of(spark, rows[:20])).collect()
    assert len({r.limit_symbol_ratio for r in few}) == 1 and 0 < few[0].limit_symbol_ratio < 0.10


def test_quality_rules_part_bad_texts_from_clean_ones(spark):
    """Symbols in one text of twenty: quartiles of the others would be theirs."""
    rng = random.Random(11)
    rows = [(i, clean(rng, 200) if i % 20 else re.sub(r"(\w+)", r"\1##", clean(rng, 200)), "en", f"s{i % 3}") for i in range(900)]
    rows += [(2000 + i, clean(rng, 200) + " # ", "en", "s0") for i in range(5)]
    got = {r.doc_id: r for r in quality.quality_filter(docs_of(spark, rows)).collect()}
    bad = [i for i in range(900) if i % 20 == 0]
    assert all(got[i].failed_rules == ["symbol_ratio"] for i in bad)
    assert sum(got[i].kept for i in got if i not in set(bad)) >= 0.99 * (len(got) - len(bad)) and all(got[2000 + i].kept for i in range(5))


def plain_limits(rows, prior=50.0, spread=3.0, factor=8.0, width=0.02):
    """Limits of each (language, source) from dictionaries of cells."""
    import math

    step = math.log1p(width)
    cell = lambda v: math.floor(math.log(max(v, 1e-6)) / step)
    zero = cell(0.0)
    fine = {}
    for lang, source, text in rows:
        n, chars, symbols, dup, repeat = brute_counts(text)
        if n < 10 or 100 * repeat > 20 * n:
            continue
        lines = sum(bool(re.findall(r"[^ \t-\r]+", x)) for x in (text or "").split("\n"))
        letters = (chars - symbols) / n
        values = {"symbol_ratio": symbols / chars, "repeat_ratio": repeat / n, "dup_line_ratio": dup / max(lines, 1), "long_words": letters, "short_words": letters, "word_chars": chars, "n_words": n, "n_lines": lines}
        for m, v in values.items():
            cells = fine.setdefault((lang, source), {}).setdefault(m, {})
            cells[cell(v)] = cells.get(cell(v), 0) + 1

    def total(sketches):
        out = {}
        for s in sketches:
            for m, cells in s.items():
                for c, k in cells.items():
                    out.setdefault(m, {})[c] = out.get(m, {}).get(c, 0) + k
        return out

    def with_prior(own, above):
        out = {m: dict(cells) for m, cells in own.items()}
        for m, cells in out.items():
            whole = sum(above[m].values())
            for c, k in above[m].items():
                cells[c] = cells.get(c, 0) + prior * k / whole
        return out

    def reach(cells, q):
        whole, run = sum(cells.values()), 0.0
        for c in sorted(cells):
            run += cells[c]
            if run >= q * whole - 1e-9:
                return math.exp((c + 1) * step) if c > zero else 0.0

    corpus, limits = total(fine.values()), {}
    for (lang, source), own in fine.items():
        by_lang = with_prior(total(s for (x, _), s in fine.items() if x == lang), corpus)
        sketch = with_prior(own, by_lang)
        usual = {"symbol_ratio": ("word_chars", 5), "repeat_ratio": ("n_words", 5), "dup_line_ratio": ("n_lines", 2)}
        for m in ("symbol_ratio", "repeat_ratio", "dup_line_ratio", "long_words", "short_words"):
            up = {c: k for c, k in sketch[m].items() if c > zero}
            q1, q3 = (reach(up, q) for q in (0.25, 0.75)) if up else (None, None)
            limit = None if not up else q1 - spread * (q3 - q1) if m == "short_words" else q3 + spread * (q3 - q1)
            if m in usual:
                noise = usual[m][1] / max(reach(sketch[usual[m][0]], 0.5), 1.0)
                marks = [reach(sketch[m], q) + noise for q in quality.SHARES]
                gap = next((math.sqrt(a * b) - noise for a, b in zip(marks, marks[1:], strict=False) if b >= factor * a), None)
                limit = min((x for x in (limit, gap) if x is not None), default=None)
            limits[lang, source, m] = limit
    return limits


def test_quality_limits_and_verdicts_match_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        text = "\n".join(clean(rng, rng.randrange(3, 12)) for _ in range(rng.randrange(1, 9)))
        kind = rng.randrange(12)
        text = text + " #" * rng.randrange(1, 4) if kind < 3 else text.replace(" ", " ## ") if kind == 3 else text + "\n" + text.split("\n")[0] if kind < 6 else text.replace("a", "aaaa") if kind == 6 else text
        rows.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s1", None])))
    rows += [(1000 + i, t, "en", "s0") for i, t in enumerate(ODD)]
    want = plain_limits([(r[2], r[3], r[1]) for r in rows])
    for r in quality.quality_filter(docs_of(spark, rows)).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        n, chars, symbols, dup, repeat = brute_counts(text)
        lines = max(sum(bool(re.findall(r"[^ \t-\r]+", x)) for x in (text or "").split("\n")), 1)
        letters = (chars - symbols) / max(n, 1)
        failed = []
        for m, v in (("symbol_ratio", symbols / max(chars, 1)), ("repeat_ratio", repeat / max(n, 1)), ("dup_line_ratio", dup / lines), ("long_words", letters), ("short_words", letters)):
            limit = want.get((r.lang, r.source, m))
            assert limit is None and r[f"limit_{m}"] is None or r[f"limit_{m}"] == pytest.approx(limit), (r.lang, r.source, m)
            if limit is not None and (v < limit if m == "short_words" else v > limit):
                failed.append(m)
        assert r.failed_rules == failed and r.kept == (not r.base_failed and not failed)


def test_quality_sketches_merge_exactly(spark):
    rng = random.Random(3)
    df = quality.with_counts(docs_of(spark, [(i, clean(rng, 40), "en", f"s{i % 3}") for i in range(90)]))
    whole = {tuple(r) for r in quality.sketches(df, []).collect()}
    parts = quality.sketches(df.filter("doc_id < 30"), []).unionByName(quality.sketches(df.filter("doc_id >= 30"), []))
    assert {tuple(r) for r in parts.groupBy("measure", "cell").agg(F.sum("n").alias("n")).collect()} == whole
    values = sorted(r[0] for r in df.select(F.col("word_chars") / F.col("n_words")).collect())
    q = {r.measure: r for r in quality.quantiles(quality.sketches(df, []), []).collect()}["long_words"]
    assert values[22] <= q.q1 <= values[22] * 1.021 and values[67] <= q.q3 <= values[67] * 1.021


# ---- 9 ----------------------------------------------------------------------

def brute_targets(sizes, share=1.5, cycle=(5, 2, 1), most=2):
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s] + 1e-9]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mixing_targets_and_fill(spark):
    rng = random.Random(4)
    rows = []
    for s, n in (("a", 400), ("b", 30), ("c", 100), ("é", 5), ("Z", 60), (None, 20)):
        rows += [(len(rows) + k, clean(rng, rng.randrange(1, 80)), "en", s) for k in range(n)]
    rows += [(None, "x y", "en", "a"), (3, rows[3][1], "en", "a"), (9999, None, "en", "b"), (9998, "", "en", "b")]
    out = mixing.mix_sources(docs_of(spark, rows).withColumn("taken", F.lit("clash")), buckets=16)
    got = [r.asDict() for r in out.collect()]
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(r["size"] for r in mine)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    # whole epochs come first: within a source the counts differ by one at most
    assert all(len({r["epochs"] for r in got if r["source"] == s}) <= 2 for s in sizes)
    again = mixing.mix_sources(docs_of(spark, rows).repartition(7).withColumn("taken", F.lit("clash")), buckets=16)
    assert sorted(map(repr, got)) == sorted(repr(r.asDict()) for r in again.collect())
    plain = mixing.mix_sources(docs_of(spark, rows), buckets=1)
    assert sorted((r.doc_id or -1, r.taken) for r in plain.collect()) == sorted((r["doc_id"] or -1, r["taken"]) for r in got)
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0


def test_mixing_salts_sources_where_there_are_many(spark):
    rows = [(i, "w " * (i % 7), "en", None if i % 5 == 0 else f"s{i % 3}") for i in range(90)]
    sized = docs_of(spark, rows).withColumns({"_key": F.rand(1), "_tie": F.xxhash64("text")})
    goal = spark.createDataFrame([(None, 1.0), ("s0", 2.0), ("s1", 3.0)], "_source string, target double")
    few, many = (sorted((r.doc_id, r.target) for r in mixing.with_goal(sized, goal, "source", few=n).collect()) for n in (10, 0))
    want = {None: 1.0, "s0": 2.0, "s1": 3.0, "s2": None}
    assert few == many == [(i, want[r[3]]) for i, r in enumerate(rows)]


def test_mixing_prefers_quality(spark):
    rng = random.Random(5)
    rows = [(i, clean(rng, 20) + (" ####" * 20 if i % 2 else ""), "en", "ab"[i % 4 // 2]) for i in range(2000)]
    got = mixing.mix_sources(docs_of(spark, rows), share=0.3, cycle=(1.0,)).filter("epochs > 0").select("doc_id").collect()
    assert sum(r.doc_id % 2 == 0 for r in got) > 0.7 * len(got)


# ---- 5 ----------------------------------------------------------------------

def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        n = min(10, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1) if n else []:
            if tuple(words[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination_matches_brute_force(spark, block):
    rng = random.Random(6)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "Delta", "é", "x1"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 9, 10, 14, 30])))) for k in range(12)]
    items += [(100, None), (101, ""), (102, "--"), (3, "rare words here only once"), (103, items[0][1])]
    texts = list(ODD)
    for _ in range(60):
        t = [word() for _ in range(rng.randrange(40))]
        if rng.random() < 0.6:
            at = rng.randrange(len(t) + 1)
            t[at:at] = (rng.choice(items)[1] or "").upper().split()
        texts.append(rng.choice([" ", "-", ", "]).join(t))
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(5, ODD[5], "en", "s"), (None, "rare WORDS, here only once!", "en", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs_of(spark, rows), bench, max_block_words=block).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in got) == sorted((i or -1, *brute_hits(t, items)) for i, t, _, _ in rows)
    assert decontaminate.decontaminate(docs_of(spark, []), bench).count() == 0
    none = decontaminate.decontaminate(docs_of(spark, rows), bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.n_hit for r in none)


# ---- 7 ----------------------------------------------------------------------

def labelled(spark, n=600, seed=7):
    """Toxic only where an insult meets a group's name."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = clean(rng, 12).split() + ["fools"] * insult + ["martians"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(insult and group)))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_learns_the_pair_and_not_the_held_out_labels(spark):
    docs, labels, truth = labelled(spark, 1500)
    got = {r.doc_id: r for r in tox.toxicity(docs, labels).collect()}
    held = [i for i, _, _ in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in got if got[i].held_out] and {i for i in got if got[i].held_out} == set(held)
    assert sum(got[i].predicted == truth[i][2] for i in held) >= 0.93 * len(held)
    flipped = labels.withColumn("toxic", F.when(tox.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in tox.toxicity(docs, flipped).collect()} == {i: r.score for i, r in got.items()}


def test_toxicity_factors_beat_additive_weights():
    """Equal or different: no sum of two weights separates the four cases."""
    rng = np.random.default_rng(0)
    n = 800
    a, b = rng.random(n) < 0.5, rng.random(n) < 0.5
    y = (a == b).astype(np.float32)
    rows = [np.array([14 + int(a[i]), 30 + int(b[i])], np.int32) for i in range(n)]

    def accuracy(k):
        m = tox.train(rows, y, k, 1, size=64)
        p = np.column_stack([m.weights, m.factors]) * m.values[:, None]
        raw, _ = tox.raw_scores(p[np.concatenate(rows)], np.repeat(np.arange(n), 2), n, m.bias)
        return ((raw >= 0) == y).mean()

    assert accuracy(0) < 0.7 < 0.95 < accuracy(4)


def plain_terms(text):
    """Slots of a text's terms, from sets of words and their beginnings."""
    words = set(re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").translate(LOWER).encode()))
    one = lambda piece: Words(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]), ALNUM, lower=False)
    found = {int(tox.slots(one(w).codes)[0]) for w in words}
    for size in tox.BEGINNINGS:
        counts = Counter(w[:size] for w in words if len(w) > size)
        for start, n in counts.items():
            code = one(start).spans(np.array([0]), np.array([size]))
            found |= {int(tox.slots(tox.beginning_code(code, size, np.array([level])))[0]) for level in range(1, min(n, tox.LEVELS) + 1)}
    return sorted(found)


LONG = " ".join(f"word{i} Wörter{i % 7}" for i in range(40_000))


def test_toxicity_scores_match_the_formula(spark):
    """Every term's weight and every pair's product, summed one by one."""
    docs, labels, _ = labelled(spark, 300)
    machine = tox.fit(docs, labels)
    rng = random.Random(3)
    texts = [None, "", "...", "fools", "Fools MARTIANS", "abandon abandoned abandons abandoning", "a" * 50, *(clean(rng, 15) + " fools" * (i % 2) for i in range(10))]
    rows = [(i, t, "en", "s") for i, t in enumerate([*texts, LONG])]
    clash = docs_of(spark, rows).withColumns({"score": F.lit("x"), "predicted": F.lit(7), "held_out": F.lit(None).cast("string")})
    got = {r.doc_id: r.score for r in tox.score_texts(clash, machine).collect()}
    for i, t in enumerate(texts):
        terms = plain_terms(t)
        x = machine.values[terms].astype(float)
        raw = machine.bias + sum(machine.weights[terms].astype(float) * x)
        v = machine.factors[terms].astype(float) * x[:, None]
        raw += sum(float(v[a] @ v[b]) for a in range(len(terms)) for b in range(a))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-5), t
    assert 0 <= got[len(texts)] <= 1
    full = tox.toxicity(clash, labels, train_docs=docs).collect()
    assert len(full) == len(rows) and all(isinstance(r.predicted, int) and isinstance(r.held_out, bool) for r in full)


def test_toxicity_finds_unseen_forms_of_a_word(spark):
    """Words of one stem are known by their beginning; held-out ones are new forms."""
    rng = random.Random(5)
    form = lambda k: "réeux" + "".join(rng.choice("aeioulmnr") for _ in range(k))
    rows = [(i, clean(rng, 25) + (f" {form(3)} {form(4)} {form(5)}" if i % 8 == 0 else ""), "fr", "s") for i in range(1200)]
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(1200)] + [(8, 1, 0)], "doc_id long, quality int, toxic int")
    got = [r for r in tox.toxicity(docs_of(spark, rows), labels).collect() if r.held_out]
    found = [r.predicted for r in got if r.doc_id % 8 == 0]
    assert np.mean(found) >= 0.9 and np.mean([r.predicted for r in got if r.doc_id % 8]) <= 0.02


def test_toxicity_sample_is_bounded_in_bytes(spark):
    docs, labels, _ = labelled(spark, 300)
    whole = tox.labelled_sample(docs, labels, "doc_id", "text", "toxic", 10_000, 1 << 30, 7)
    part = tox.labelled_sample(docs.unionByName(docs_of(spark, [(5, LONG, "en", "s")])), labels, "doc_id", "text", "toxic", 10_000, 16_000, 7)
    assert whole.count() == 300 and 0 < part.agg(F.sum(F.length("text"))).first()[0] < 24_000


def test_toxicity_edge_cases(spark):
    docs, labels, _ = labelled(spark, 60)
    odd = docs_of(spark, [(1000 + i, t, None, None) for i, t in enumerate(ODD)] + [(None, "fools", "en", "s"), (1, "twice", "en", "s")])
    got = tox.toxicity(docs.unionByName(odd), labels.withColumn("toxic", F.when(F.col("doc_id") > 5, F.col("toxic")))).collect()
    assert len(got) == 60 + len(ODD) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.score < 0.5 for r in tox.toxicity(docs, labels.limit(0)).collect())
    assert tox.toxicity(docs.limit(0), labels).count() == 0


# ---- 10 ---------------------------------------------------------------------

KEY = b"test key"
PRIVATE = [
    ("card 4111 1111 1111 1111 and 4111111111111111.", {"card": 2}),
    ("GB82 WEST 1234 5698 7654 32", {"iban": 1}),
    ("ssn 123-45-6789, not 000-12-3456", {"ssn": 1}),
    ("call +1 (415) 555-2671 now", {"phone": 1}),
    ("from 97.51.17.173 not 999.1.1.1 or 1.2.3.4.5", {"ip": 1}),
    ("on 2024-02-29 or 1.3.1999, not 2023-02-29", {"date": 2}),
    ("mail die.55@mail4.example.com", {"email": 1}),
]


def test_pseudonyms_keep_formats_and_turn_back(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(PRIVATE)], "doc_id long, text string, n_card string")
    made = pii.pseudonymise_table(df, KEY)
    got = {r.doc_id: r for r in made.collect()}
    for i, (text, counts) in enumerate(PRIVATE):
        assert {k: got[i][f"n_{k}"] for k in pii.KINDS if got[i][f"n_{k}"]} == counts
        assert got[i].text != text and re.sub(r"[0-9A-Za-z]", "", got[i].text) in (re.sub(r"[0-9A-Za-z]", "", text), re.sub(r"[0-9A-Za-z]", "", text))
        # what was made validates again, and is found as often
        assert pii.pseudonymise(got[i].text, pii.Feistel(KEY))[1] == {k: counts.get(k, 0) for k in pii.KINDS}
    back = {r.doc_id: r.text for r in pii.pseudonymise_table(made, KEY, back=True).collect()}
    assert back == {i: t.replace("1.3.1999", "01.03.1999") for i, (t, _) in enumerate(PRIVATE)}
    a, b = re.findall(r"\d[\d ]{14,17}\d", got[0].text)
    assert a.replace(" ", "") == b
    assert pii.pseudonymise_table(df, b"other").collect()[0].text != got[0].text


def test_pseudonyms_of_values_between_other_numbers():
    rng = random.Random(12)
    f = pii.Feistel(KEY)
    made = lambda t, back=False: pii.pseudonymise(t, f, back)[0]
    for i in range(300):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        digits = body + pii.luhn_digit(body)
        spelt = (digits, " ".join(digits[k : k + 4] for k in range(0, 16, 4)), "-".join(digits[k : k + 4] for k in range(0, 16, 4)))[i % 3]
        for tail in (" 7", " 42", " 123", " 12/26", "-123"):
            assert made(spelt + tail) == made(spelt) + tail
            assert made(made(spelt + tail), back=True) == spelt + tail
        assert made("42 " + spelt) == "42 " + made(spelt)
        assert re.sub(r"\D", "", made(spelt)) == made(digits)
        long = "".join(rng.choice("0123456789") for _ in range(18))
        long += pii.luhn_digit(long)
        apart = " ".join(long[k : k + 4] for k in range(0, 19, 4))
        if not pii.is_card(long[:16]):
            assert re.sub(r"\D", "", made(apart)) == made(long) and made(made(apart), back=True) == apart
        assert made(made(long), back=True) == long
    for value in ("BE68 5390 0754 7034", "BE68539007547034", "GB82 WEST 1234 5698 7654 32"):
        for tail in (" OK", " 12", " NOTE", " 1234 AB"):
            assert made(value + tail) == made(value) + tail != value + tail
            assert made(made(value + tail), back=True) == value + tail
    assert made("AB12 BE68 5390 0754 7034") == "AB12 " + made("BE68 5390 0754 7034")
    assert made("2024-02-29T10:00:00Z") == made("2024-02-29") + "T10:00:00Z" and made("2024-02-29Tx") == "2024-02-29Tx"
    assert made("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15") == "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"


def test_pseudonyms_permute():
    f = pii.Feistel(KEY)
    assert sorted(f.number(v, 1000, "t") for v in range(1000)) == list(range(1000))
    assert len({f.symbols(f"{v:04d}", "t") for v in range(10000)}) == 10000
    assert all(f.symbols(f.symbols(s, "t"), "t", back=True) == s for s in ("a", "Ab9", "x.y-Z_42", "", "é"))


def test_pseudonyms_edge_cases(spark):
    rows = [(i, t, None) for i, t in enumerate(ODD)] + [(50, "1234567890123456 2023-13-01 no", "x")] * 2
    got = pii.pseudonymise_table(spark.createDataFrame(rows, "doc_id long, text string, other string"), KEY).collect()
    assert [r.text for r in got] == [t for _, t, _ in rows]
    assert all(r[f"n_{k}"] == 0 for r in got for k in pii.KINDS)
    assert pii.pseudonymise_table(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0
