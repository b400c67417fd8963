"""Settled tables, the shared folder, small tables, and the library on workers."""

import os
from types import SimpleNamespace

import pytest

from corpusgauge import session


def test_settled_tables_survive_until_cleared(spark):
    session.clear_tables(spark)
    made = session.settle(spark.range(5))
    paths = list(session.WRITTEN[spark.sparkContext.applicationId])
    assert made.count() == 5 and len(paths) == 1 and os.path.isdir(paths[0].removeprefix("file:"))
    assert session.clear_tables(spark) == 1 and not os.path.exists(paths[0].removeprefix("file:"))
    assert session.clear_tables(spark) == 0


def test_a_cluster_needs_a_shared_folder():
    def fake(master, folder=None):
        known = {"spark.checkpoint.dir": folder} if folder else {}
        conf = SimpleNamespace(get=lambda k, d=None: known.get(k, d), set=known.__setitem__)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            session.shared_dir(fake(master))
        assert session.shared_dir(fake(master, "hdfs://x/y/")) == "hdfs://x/y"
    own = fake("local[4]")
    assert session.shared_dir(own) == session.shared_dir(own)


def test_small_tables_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(df).rdd.getNumPartitions() == cores and session.spread(df).count() == 1000
    assert "Exchange" not in session.spread(df, below=10)._jdf.queryExecution().executedPlan().toString()


def test_the_library_can_be_sent_to_workers(spark):
    session.ship(spark)
    assert any(name.endswith("corpusgauge.zip") for name in spark.sparkContext.listFiles)
