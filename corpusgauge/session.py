"""Session-level helpers that every part of the library may use."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: what ``spark.checkpoint.dir`` names.

    Only where the setting is missing and all tasks run in one process (tests)
    a temporary folder is chosen and remembered in the session; on a cluster it
    would be another folder on each machine, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("corpusgauge.scratch", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="corpusgauge-")
        spark.conf.set("corpusgauge.scratch", root)
    return root.rstrip("/")


#: Tables that ``settle`` has written, by application.
WRITTEN: dict[str, list[str]] = {}


def clear_tables(spark: SparkSession) -> int:
    """Remove the tables that this application has settled so far; results that
    are still to be read from them must be written first. Returns their number."""
    paths = WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def ship(spark: SparkSession) -> None:
    """Send the library to the executors, where it isn't installed there."""
    root = Path(__file__).resolve().parent
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='corpusgauge-')}/corpusgauge", "zip", root.parent, root.name)
    spark.addArtifacts(made, pyfile=True)


def settle(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage and survives the loss of executors, as the files lie in
    storage that all of them reach.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """A table in the shared folder that a loop adds to, a part for each round.

    It is read in one scan however many rounds there are, with the column
    ``round`` (from 0), by which parts that a filter rules out aren't read.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.schema, self.n = spark, None, 0
        self.path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
        WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(self.path)

    def add(self, df: DataFrame, seen: Column | None = None) -> int:
        """Write ``df`` as the next round; returns ``seen``, an aggregate over its
        rows (their number by default), from the same pass."""
        observed = Observation()
        df.observe(observed, (F.count(F.lit(1)) if seen is None else seen).alias("seen")).write.parquet(f"{self.path}/round={self.n}")
        self.schema, self.n = df.schema, self.n + 1
        return observed.get["seen"]

    def read(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema, T.StructField("round", T.IntegerType())])).parquet(self.path)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside drops its shuffle files as soon as it is written;
    otherwise they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def spread(df: DataFrame, below: int = 64 << 20) -> DataFrame:
    """A small table dealt to all cores, for work that costs much more than its
    bytes: its file may be one row group, hence one task. Tables of ``below``
    bytes or more have enough splits and stay as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < below else df


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` is made from, as Spark estimates them;
    tables of unknown size, which Spark takes for endless, don't count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
