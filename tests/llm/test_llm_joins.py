"""Operators that compare documents, hosts and messages: 1, 2, 3, 4, 6."""

import hashlib
import os
import random
import re
import sys
import time

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from corpusgauge.llm import chat, hosts, jaccard, lines, repeats
from corpusgauge.llm.registry import URL_RULES
from corpusgauge.llm.suffixes import common_prefixes, induced_sort

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t ", "é", "Ünï cödé \x0b ça", "a" * 3000 + " b", "word " * 500, "x\r\ny\x00z \x1c w"]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, n long, cls string")


# ---- 1 ----------------------------------------------------------------------

def brute_rule(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


URLS = [None, "", "no scheme", "http://", "http://A.Example.com/en/1", "https://www.example.com/en/2?q#f", "http://x.www.example.com/en/", "http://example.com/en", "http://com/", "http://com", "http://net/es/1", "http://b.net/fr/", "http://b.net/de/", "http://c.org/es/", "http://xcom/", "http://a.com?x=/", "ftp://é.com/ü\nq", "http://b.net/fr/", "x://y://z.com/"]


def test_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, None, "clash", "clash") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string, verdict string")
    got = {r.page_id: r for r in hosts.judge_urls(pages, URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")
    assert got[0].verdict == got[2].verdict == "allow"
    assert hosts.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_trust_and_distrust_flow(spark):
    """Who links to blocked hosts is blocked; who good hosts link to is not."""
    link = lambda *to: "".join(f'<a href="http://{t}/x">' for t in to)
    pages = [(1, "http://good.com/", link("friend.org", "other.org")), (2, "http://bad.net/es/", ""), (3, "http://shady.org/", link("bad.net", "bad.net", "spam.net")), (4, "http://spam.net/fr/", link("bad.net")), (5, "http://friend.org/", link("good.com")), (6, "http://other.org/", ""), (7, "http://lonely.org/", None)]
    got = {r.page_id: r for r in hosts.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES, threshold=0.2).collect()}
    assert got[3].verdict == "block" and got[3].distrust > 0.2 > got[3].trust
    assert [got[i].verdict for i in (5, 6, 7)] == ["allow"] * 3 and got[5].trust > 0


def dense_rank(edges, start, n):
    """Shares of personalised PageRank, by solving its linear system."""
    out = np.zeros((n, n))
    for a, b, w in edges:
        out[b, a] += w
    sums = out.sum(0)
    step = np.divide(out, sums, out=np.zeros_like(out), where=sums > 0)
    rank = np.linalg.solve(np.eye(n) - 0.85 * step, 0.15 * start / max(start.sum(), 1))
    return rank / max(rank.sum(), 1e-300)


@pytest.mark.parametrize("seed", range(3))
def test_host_masses_match_a_dense_solution(spark, seed):
    rng = np.random.default_rng(seed)
    n = 12
    edges = [(int(a), int(b), int(rng.integers(1, 5))) for a, b in rng.integers(0, n - 2, (30, 2)) if a != b]  # two hosts have no edge
    edges = [(a, b, sum(w for x, y, w in edges if (x, y) == (a, b))) for a, b in {(a, b) for a, b, _ in edges}]
    pages = rng.integers(1, 9, n)
    allowed, blocked = (np.where(rng.random(n) < 0.3, pages, 0) for _ in range(2))
    name = lambda i: f"h{i}.org"
    hosts_df = spark.createDataFrame([(name(i), int(allowed[i]), int(blocked[i]), int(pages[i])) for i in range(n)], "host string, n_allowed long, n_blocked long, n_pages long")
    edges_df = spark.createDataFrame([(name(a), name(b), w) for a, b, w in edges], "src string, dst string, weight long")
    got = {r.host: r for r in hosts.host_verdicts(hosts_df, edges_df).collect()}
    back = [(b, a, w) for a, b, w in edges]
    good, bad = dense_rank(edges, allowed.astype(float), n), dense_rank(back, blocked.astype(float), n)
    trust, distrust = good / dense_rank(edges, pages.astype(float), n), bad / dense_rank(back, pages.astype(float), n)
    for i in range(n):
        r = got[name(i)]
        assert (r.trust, r.distrust) == (pytest.approx(trust[i], rel=0.03, abs=0.03), pytest.approx(distrust[i], rel=0.03, abs=0.03))
        block = distrust[i] - trust[i] > 0.2 * (distrust[i] + trust[i]) and distrust[i] > 0.85
        assert r.verdict == ("block" if block else "allow") or abs(distrust[i] - 0.85) < 0.05 or abs(distrust[i] - 1.5 * trust[i]) < 0.05
    assert {r.verdict for r in got.values()} == {"allow", "block"} or not blocked.any()


def test_pages_with_odd_html_and_hosts(spark):
    """Null hosts give no edge; a very long page gives all its links, once each
    place; clashing columns don't matter."""
    long = "<p>" * 50_000 + "".join(f'<a href="http://t{i % 50}.org/">' for i in range(20_000))
    rows = [(1, "http://a.org/", long, "x", "y"), (2, None, '<a href="http://b.org/">', "x", "y"), (3, "http://a.org/", "<a href=http://T0.ORG:80/q>", "x", "y"), (4, "http://t1.org/", None, "x", "y"), (4, "http://t1.org/", None, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, trust string, host string")
    parsed = pages.withColumn("host", hosts.host_and_path(F.col("url"))[0])
    edges = {(r.src, r.dst): r.weight for r in hosts.page_edges(parsed).collect()}
    assert edges["a.org", "t7.org"] == 400 and len(edges) == 51 and all(src == "a.org" for src, _ in edges)
    got = hosts.judge_urls(pages, URL_RULES).collect()
    assert sorted(r.page_id for r in got) == [1, 2, 3, 4, 4] and all(r.verdict == "allow" for r in got)


# ---- 2 ----------------------------------------------------------------------

def brute_turns(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        mine = [((r[2] or ""), (r[3] or "")) for r in mine]
        learnt = "".join(t for role, t in mine if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(mine), sha("".join(f"{a}\n{b}\n" for a, b in mine)), len(learnt), sha(learnt))
    return out


def test_flat_conversations_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\", "\\\\l\\h", "<", "#", "é\n\n", "", None, ": c \\c"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "a: #<\\", None]), rng.choice(nasty)) for c in range(12) for t in range(rng.randrange(1, 9))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"long {t}") for t in range(300)]
    rows += [(51, 1, "user", "tie"), (51, 1, "user", "tie"), (51, None, "assistant", "no turn"), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    digests = F.pandas_udf(chat.digests, chat.DIGESTS)
    made = chat.format_flat(df).select(F.col("tree").alias("c"), digests("formatted", "loss_spans").alias("d"), "formatted").collect()
    assert {r.c: (r.d.n_turns, r.d.turns_sha256, r.d.loss_chars, r.d.loss_sha256) for r in made} == brute_turns(rows)
    assert all(r.d.formatted_chars == len(r.formatted) for r in made)
    assert chat.format_flat(df.limit(0)).count() == 0


def brute_best(nodes):
    """nodes: msg -> (parent, score); the best root-to-leaf path."""
    parent = {m: (p if p in nodes else None) for m, (p, _) in nodes.items()}
    leaves = set(nodes) - set(parent.values())
    paths = []
    for leaf in leaves:
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = parent[at]
        if at is None:
            paths.append((-sum(nodes[m][1] or 0 for m in path) / len(path), leaf, path[::-1]))
    return min(paths)[2] if paths else None


def test_reply_trees_pick_the_best_path(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for tree in range(15):
        nodes = {m: (rng.randrange(m) if m and rng.random() < 0.95 else None, rng.choice([None, 0.25, 0.5, 1.0, 2.0])) for m in range(rng.randrange(1, 25))}
        if tree == 3:
            nodes |= {100: (101, 9.0), 101: (100, 9.0), 102: (999, 0.5)}  # a cycle, and a missing parent
        want[tree] = brute_best(nodes)
        rows += [(tree, m, p, "user", f"{tree}.{m}", s) for m, (p, s) in nodes.items()]
    rows += rows[:4]
    df = spark.createDataFrame(rows, "tree long, msg long, parent long, role string, text string, score double")
    got = {}
    for r in sorted(chat.best_paths(df).collect(), key=lambda r: r.depth):
        got.setdefault(r.tree, []).append(r.msg)
    assert got == {t: p for t, p in want.items() if p}
    made = {r.tree: [t for _, t in chat.read_back(r.formatted)] for r in chat.format_trees(df).collect()}
    assert made == {t: [f"{t}.{m}" for m in p] for t, p in want.items() if p}


def test_reply_trees_take_small_plans_however_deep(spark, monkeypatch):
    """op2: each round reads the tables before it in one scan and joins once, so
    that the driver doesn't hold plans that grow with the number of rounds."""
    scans = []

    def leaves(df):
        return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()

    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (scans.append(leaves(self._df)), write(self, *a, **b))[1])
    rows = [(1, m, m - 1 if m else None, "user", f"turn {m}", 0.5) for m in range(150)] + [(2, 0, None, "user", "x", 1.0)]
    df = spark.createDataFrame(rows, "tree long, msg long, parent long, role string, text string, score double")
    made = chat.format_trees(df)
    assert leaves(made) <= 2 and max(scans) <= 2 and len(scans) <= 2 * (1 + (150).bit_length())
    assert {r.tree: chat.read_back(r.formatted) for r in made.collect()} == {1: [("user", f"turn {m}") for m in range(150)], 2: [("user", "x")]}


def test_reply_trees_with_odd_parents(spark):
    """A missing parent at any height ends the path there; a message repeated
    with another parent is answered only by what counts."""
    rows = [(None, m, m - 1, 1.0) for m in range(10)]  # the first one's parent is missing
    rows += [(4, 1, None, 1.0), (4, 2, 1, 5.0), (4, 3, 1, 1.0), (4, 3, 2, 2.0)]  # 3 answers 1, so 2 is a leaf
    rows += [(5, 1, 1, 1.0)]  # answers itself
    df = spark.createDataFrame(rows, "tree long, msg long, parent long, score double")
    got = {}
    for r in sorted(chat.best_paths(df, 2).collect(), key=lambda r: r.depth):
        got.setdefault((r.tree, r.path_rank), []).append((r.leaf, r.depth, r.msg))
    assert got == {(None, 1): [(9, d, d) for d in range(10)], (4, 1): [(2, 0, 1), (2, 1, 2)], (4, 2): [(3, 0, 1), (3, 1, 3)]}


# ---- 3 ----------------------------------------------------------------------

def test_sorting_takes_array_steps_however_long_the_text():
    """op3: names aren't scanned one by one, and prefixes are compared by words."""
    rng = np.random.default_rng(5)
    own = rng.integers(600, 5000, 3000)
    text = np.concatenate([own, own[::-1], own, rng.integers(600, 5000, 12_000)])
    lines = [0]

    def count(frame, event, _):
        lines[0] += event == "line"
        return count if frame.f_code.co_filename.endswith("suffixes.py") else None

    before = sys.gettrace()
    sys.settrace(count)
    try:
        sa = induced_sort(text)
        sorting = lines[0]
        got = common_prefixes(text, sa, 48, np.full(len(text), len(text)))
    finally:
        sys.settrace(before)
    assert sorting < 500 and lines[0] - sorting < 150
    places = [tuple(text[i : i + 48].tolist()) for i in sa]
    assert places == sorted(places)
    assert got.tolist() == [0] + [next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(places, places[1:])]


def test_induced_sort_and_prefixes_match_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 60)).astype(np.int64)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert induced_sort(t).tolist() == want and induced_sort(t + 600).tolist() == want
        got = common_prefixes(t, np.array(want), 6, np.full(len(t), len(t)))
        for k in range(1, len(t)):
            a, b, n = want[k - 1], want[k], 0
            while n < 6 and max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert got[k] == n


def brute_repeats(rows, length=50):
    first = {}
    big = 2**63 - 1
    for i, t in rows:
        b = (t or "").encode()
        i = big if i is None else i
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            first[w] = min(first.get(w, big), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for a in range(len(b) - length + 1):
            if first[b[a : a + length]] < (big if i is None else i):
                gone[a : a + length] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone])).tolist()
        out.append((i, len(b), edges, bytes(c for c, g in zip(b, gone, strict=False) if not g)))
    return sorted(out, key=repr)


def random_copies(rng, n):
    word = lambda: rng.choice(["ab", "ba", "é", "abcab", "zz", "longer word"])
    base = [" ".join(word() for _ in range(rng.randrange(80))) for _ in range(n)]
    out = []
    for k in range(n):
        t = base[k]
        for _ in range(rng.randrange(3)):
            other = rng.choice(base)
            a = rng.randrange(len(other) + 1)
            at = rng.randrange(len(t) + 1)
            t = t[:at] + other[a : a + rng.randrange(45, 200)] + t[at:]
        out.append(t)
    return out


@pytest.mark.parametrize("small_index", [False, True])
def test_repeats_match_brute_force(spark, monkeypatch, small_index):
    rng = random.Random(4)
    texts = ODD + random_copies(rng, 40) + ["ab" * 60, "ab" * 60, "x" * 120, "x" * 49, "x" * 50]
    rows = list(enumerate(texts)) + [(3, texts[20]), (20, texts[20]), (20, texts[21]), (None, texts[22]), (None, texts[22])]
    if small_index:  # pieces of long texts
        buf = np.frombuffer((texts[20] * 3).encode(), np.uint8)
        offs = np.array([0, len(buf)])
        whole = [np.concatenate(x) for x in zip(*repeats.text_anchors(buf, offs, 50), strict=True)]
        covered = {(s, e) for s, e in zip(whole[3].tolist(), (whole[3] + whole[4]).tolist(), strict=True)}
        monkeypatch.setattr(repeats, "INDEX_BITS", 8)
        parts = [np.concatenate(x) for x in zip(*repeats.text_anchors(buf, offs, 50), strict=True)]
        starts = lambda c: {k for s, e in c for k in range(s, e - 49)}
        assert starts(covered) == starts({(s, e) for s, e in zip(parts[3].tolist(), (parts[3] + parts[4]).tolist(), strict=True)}) == set(range(len(buf) - 49))
        return
    got = repeats.remove_repeats(docs_of(spark, rows), chunk_bytes=1000).collect()
    assert sorted(((r.id, r.n_bytes, list(r.spans), bytes(r.kept)) for r in got), key=repr) == brute_repeats(rows)
    assert repeats.remove_repeats(docs_of(spark, [])).count() == 0


def test_repeats_of_single_ids_match_brute_force(spark):
    rows = list(enumerate([*ODD, *random_copies(random.Random(5), 40)], -3))
    got = repeats.remove_repeats(docs_of(spark, rows), chunk_bytes=1000).collect()
    assert sorted(((r.id, r.n_bytes, list(r.spans), bytes(r.kept)) for r in got), key=repr) == brute_repeats(rows)


def test_repeats_pack_keeps_values():
    odd = [np.array(x, np.int64) for x in ([0, 0, 0], [255, 0, 7], [256, 1, 2], [2**63 - 1, -(2**63), -1], [2**40, 5, 6])]
    for arrays in (odd, [x[:0] for x in odd]):
        blob = repeats.pack(*arrays) + b"text"
        got, end = repeats.unpack(blob, len(arrays))
        assert [x.tolist() for x in got] == [x.tolist() for x in arrays] and blob[end:] == b"text"
    assert len(repeats.pack(np.zeros(1000, np.int64), np.full(1000, 200))) < 1100


def keyed_of(spark, rows):
    return docs_of(spark, rows).select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), "text")


def test_repeats_hash_texts_only_where_ids_clash(spark):
    short = lambda rows: [r.th for r in repeats.short_hash(keyed_of(spark, rows))[0].orderBy("doc", "text").collect()]
    assert short([(1, "a"), (2, "b"), (2, "b")]) == [0, 0, 0]
    one, other, third = short([(1, "a"), (1, "b"), (2, "c")])
    assert one != other and max(one, other, third) < 2**32
    assert repeats.short_hash(keyed_of(spark, [(1, "ab"), (1, "é")]))[1] == 4
    assert repeats.short_hash(keyed_of(spark, []))[1] == 0


def random_texts(n):
    rng = random.Random(6)
    return [(i, "".join(rng.choices("abcdefgh ", k=2000))) for i in range(n)]


def test_repeats_anchors_take_few_bytes(spark):
    rows = random_texts(100)
    buf = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    n = sum(len(x[0]) for x in repeats.text_anchors(buf, np.arange(101) * 2000, 50))
    dealt = repeats.deal_anchors(keyed_of(spark, rows).withColumn("th", F.lit(0).cast("long")), 8, 50)
    # 48 bytes each when all were whole words
    assert dealt.agg(F.sum(F.octet_length("blob"))).collect()[0][0] < 17 * n


def test_repeats_anchors_leave_the_disk(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f: os.path.getsize(f) for f in files if re.search(r"/shuffle_\d+_\d+_\d+\.data$", f) and os.path.exists(f)}

    rows, before = random_texts(200), shuffled()
    repeats.remove_repeats(docs_of(spark, rows))
    for _ in range(50):
        if (left := sum(n for f, n in shuffled().items() if f not in before)) < 40_000:
            return
        time.sleep(0.1)
    raise AssertionError(f"{left} bytes are left of the shuffles of 400000 bytes of text")


# ---- 4 ----------------------------------------------------------------------

def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted((repr(i), len(s), repr(low.get(find(k)) if s else i)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def edited(rng, t, n):
    w = t.split()
    for _ in range(n):
        if w:
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard_components_match_brute_force(spark, monkeypatch, block):
    rng = random.Random(5)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    word = lambda: f"w{rng.randrange(400)}"
    common = " ".join(f"common{k}" for k in range(30))
    texts = list(ODD)
    for n in (4, 5, 6, 8, 12, 20, 40, 100, 300):
        base = " ".join(word() for _ in range(n))
        texts += [base, base.upper(), base + " tail", common + " " + base]
        chain = base
        for _ in range(6):
            chain = edited(rng, chain, max(1, n // 60))
            texts.append(chain)
        texts += [edited(rng, base, k) for k in (1, 2, 3, 5)] + [base + "\n" + common]
    texts += ["a b", "A  b", "a b c d", "a b c d e", common, common]
    rows = list(enumerate(texts))
    rows += [(3, texts[30]), (None, texts[40]), (None, texts[12]), rows[9]]
    got = jaccard.jaccard_components(docs_of(spark, rows)).collect()
    assert sorted((repr(r.id), r.n_shingles, repr(r.component_id)) for r in got) == brute_components(rows)


def test_jaccard_keeps_one_of_each_group(spark):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(60)) for _ in range(6)]
    rows = [(10 * k + j, edited(rng, t, j > 0)) for k, t in enumerate(base) for j in range(3)] + [(0, base[0]), (100, ""), (101, None), (101, None)]
    kept = jaccard.keep_one(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "n", "cls"]
    got = sorted(r.doc_id for r in kept.collect())
    components = {r.id: r.component_id for r in jaccard.jaccard_components(docs_of(spark, rows)).collect()}
    assert got == sorted([*{c for i, c in components.items() if i < 100}, 100, 101, 101])
    assert jaccard.keep_one(docs_of(spark, [])).count() == 0
    assert jaccard.jaccard_components(docs_of(spark, [(1, ""), (2, None)])).count() == 2


def test_jaccard_keeps_unlinked_documents_of_null_and_repeated_ids(spark):
    rng = random.Random(8)
    text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(6)]
    rows = [(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (None, text[4]), (None, text[4] + " tail"), (7, text[5]), (8, text[5])]
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(docs_of(spark, rows)).collect()), key=repr)
    copies = [r for r in kept if r[0] is None and r[1].startswith(text[4])]
    assert len(copies) == 1
    assert kept == sorted([*rows[:4], copies[0], rows[6]], key=repr)


def test_parity_keys_never_miss_a_pair():
    """Any two sets of Jaccard 0.8 or more share a key, also tiny ones."""
    rng = np.random.default_rng(7)
    common = np.zeros(1 << jaccard.SLOT_BITS, np.uint8)
    for _ in range(300):
        n = int(rng.integers(4, 60))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        cut = int(rng.integers(0, n // 5 + 1))
        b = np.r_[a[cut:], rng.integers(0, 2**63, int(rng.integers(0, 3))).astype(np.uint64)]
        inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * inter < 80 * union or inter == union:
            continue
        text = np.repeat([0, 1], [len(a), len(b)])
        owner, key = jaccard.pigeonhole_keys(text, np.r_[a, b], np.array([len(a), len(b)]), common)
        assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())


# ---- 6 ----------------------------------------------------------------------

def brute_lines(rows, min_docs=3, min_tokens=3, percent=75, least=5):
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=repr)
    seen = []
    for i, t in docs:
        for pos, line in enumerate(t.split("\n")):
            w = [re.sub(r".*[0-9@].*", "<*>", x, flags=re.S) for x in re.split(r"[ \t\r\f\x0B]+", line) if x]
            if len(w) >= min_tokens:
                seen.append(((i, t), pos, w))
    leaves = {}
    for d, pos, w in seen:
        leaves.setdefault((len(w), *w[:3]), []).append((d, pos, w))
    found = {}
    for leaf, members in leaves.items():
        if len(members) < min_docs:
            continue
        count = {}
        for _, _, w in members:
            count[" ".join(w)] = count.get(" ".join(w), 0) + 1
        model = max((n, m.encode()) for m, n in count.items())[1].decode().split(" ")
        for d, pos, w in members:
            equal = sum(a == b for a, b in zip(w, model, strict=True))
            own = model if equal == len(w) or (equal >= least and 100 * equal >= percent * len(w)) else w
            found.setdefault((leaf, tuple(own)), []).append((d, pos))
    return {k: v for k, v in found.items() if len({d for d, _ in v}) >= min_docs}


def test_template_lines_match_brute_force(spark):
    rng = random.Random(8)
    forms = ["posted by user{n} on day {n} of the year", "page {n} of {n}", "all rights reserved by the {w} company of town", "See also", "one two three {w} five six seven {w}"]
    rows = list(enumerate(ODD))
    for i in range(30):
        ls = [rng.choice(forms).replace("{n}", str(rng.randrange(99))).replace("{w}", rng.choice(["x", "y", "z"])) if rng.random() < 0.5 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 7))]
        rows.append((100 + i, rng.choice(["\n", "\n\n", " \t\n"]).join(ls)))
    rows += [rows[10], (100, "page 5 of 6"), (None, "page 7 of 8")]
    want = brute_lines(rows)
    drop = {}
    for places in want.values():
        low = {}
        th = {t: h for t, h in spark.createDataFrame([(t,) for _, t in {d for d, _ in places}], "t string").select("t", F.xxhash64("t")).collect()}
        first = min(places, key=lambda p: (p[0][0] is not None, p[0][0] or 0, th[p[0][1]], p[1]))
        for d, pos in places:
            if (d, pos) != first:
                drop.setdefault(d, set()).add(pos)
        del low
    got = lines.drop_recurring_lines(docs_of(spark, rows).withColumnRenamed("n", "n_lines"), min_docs=3).collect()
    assert len(got) == len(rows)
    want_rows = []
    for i, t in rows:
        gone = drop.get((i, t), set())
        left = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        want_rows.append((repr(i), repr(left), 0 if t is None else len(t.split("\n")), len(gone), bool(gone) and not re.search(r"[^\x20\x09-\x0D]", left)))
    assert sorted((repr(r.doc_id), repr(r.text), r.n_lines, r.n_dropped, r.emptied) for r in got) == sorted(want_rows)
    assert any(n for _, _, _, n, _ in want_rows)
    assert lines.drop_recurring_lines(docs_of(spark, [])).count() == 0


def test_long_lines_go_from_their_second_document_on(spark):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    long, short, numbers = words(60), words(8), " ".join(str(k) for k in range(30))
    rows = [(i, "\n".join([words(30), long, short, numbers.replace("1", str(i))])) for i in (1, 2)]
    left = {r.doc_id: r.text.split("\n") for r in lines.drop_recurring_lines(docs_of(spark, rows), long_words=20).collect()}
    first, second = (t.split("\n") for _, t in rows)
    assert left == {1: first, 2: [second[0], second[2], second[3]]}


def test_templates_spell_out_variable_fields(spark):
    rows = [(i, f"status of the job number {i} is {w} and all went well today") for i, w in enumerate(["good", "bad", "good", "fine"])]
    _, spelt = lines.templates(lines.line_rows(docs_of(spark, rows), "doc_id", "text"), 75, 5)
    assert [r.template for r in spelt.collect()] == ["status of the job number <*> is <*> and all went well today"]


def test_native_operator_runs_no_python(spark):
    plan = lines.drop_recurring_lines(docs_of(spark, [(1, "a b c")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
