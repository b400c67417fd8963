"""The pipeline's stages on planted documents, and the registered queries."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from corpusgauge.llm import registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean documents, toxic ones, copies, boilerplate and a leaked item."""
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    item = prose(14)
    rows, labels = [], []
    for i in range(200):
        toxic = i % 4 == 0
        body = prose(30) + "\n" + prose(25) + (" idiot scum" if toxic else "")
        rows.append((i, body))
        labels.append((i, 1, int(toxic)))
    base = prose(60)
    words = base.split()
    rows += [(1000, base), (1001, base), (1002, " ".join(words[:-1] + ["edited"])), (1003, base + "\n" + prose(5))]
    rows += [(2000 + k, prose(20) + "\nshared notice of the great common site owner\n" + prose(20)) for k in range(8)]
    rows += [(3000, prose(20) + " " + item.upper() + " " + prose(20)), (4000, None), (4001, "")]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_takes_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, tables))
        kept.append({r.doc_id: r for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
    toxic, lined, unique, clean, mixed = kept
    assert not {i for i in toxic if i < 200 and i % 4 == 0} and {i for i in range(200) if i % 4} <= set(toxic)
    notices = [i for i in range(2000, 2008) if "shared notice" in lined[i].text]
    assert notices == [2000] and all(lined[i].n_chars == len(lined[i].text) for i in range(2000, 2008))
    assert {1000, 1001, 1002, 1003} & set(unique) == {1000} and {i for i in range(200) if i % 4} <= set(unique)
    assert 3000 in unique and 3000 not in clean and set(unique) - set(clean) == {3000}
    assert set(mixed) == set(clean) and {4000, 4001} <= set(mixed)
    total = sum(r["size"] for r in mixed.values())
    assert abs(sum(r.taken for r in mixed.values()) - 1.5 * total) < 0.1 * total
    assert [tuple(r) for r in sorted(corpus_pipeline.run(spark, tables).collect(), key=lambda r: r.doc_id)] == [tuple(mixed[i]) for i in sorted(mixed)]


def test_empty_documents_pass_all_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, tables))
    assert docs.count() == 0


def test_odd_documents_pass_all_stages(spark, tables, tmp_path):
    """Null and repeated ids, clashing columns, a very long text; no labels and
    no benchmark items: nothing crashes and clean documents stay."""
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    long, twice = prose(60_000), prose(40)
    rows = [(None, prose(30)), (None, prose(30)), (7, twice), (7, twice), (7, prose(50)), (8, None), (9, ""), (10, " \n\t"), (11, long), (None, None), (12, "Ünï " * 30), (13, "one two")]
    docs = spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 2 else "s", None, "clash", 0.5, 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, cls string, score double, n_hit int")
    folder = str(tmp_path)
    spark.read.parquet(f"{tables}/labels.parquet").limit(0).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, " . ")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, folder))
        kept.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS, name
    sizes = [len(k) for k in kept]
    # one of the two equal rows goes, and nothing else
    assert sizes == [12, 12, 11, 11, 11] and sorted(r.text or "" for r in kept[3]) == sorted([t or "" for k, (_, t) in enumerate(rows) if k != 3])
    assert {r.doc_id: r["size"] for r in kept[4]}[11] == 60_000


def test_queries_are_registered():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} <= {n.split("_")[0] + "_" for n in names}
    assert "pipeline" in names and set(registry.oracle_sql()) <= set(names)
