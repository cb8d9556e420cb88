"""Materialised intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: str | None = None
_owned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a temporary folder serves, but in local mode only."""
    global _local
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="memspark-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return f"file://{_local}"


def _clean() -> None:
    """Deletes the tables of this application from the shared folder as the driver ends."""
    sc = SparkContext._active_spark_context
    for root in _owned if sc is not None and sc._jvm is not None else ():
        at = sc._jvm.org.apache.hadoop.fs.Path(root)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


class Work:
    """Tables of one operator run. ``cut`` writes a table once and reads it back: lineage ends in replicated files, so a
    lost executor costs the tasks that ran on it and no earlier step. They stand under the application's id and go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        own = f"{shared_dir(spark).rstrip('/')}/memspark/{spark.sparkContext.applicationId}"
        if own not in _owned:
            if not _owned:
                atexit.register(_clean)
            _owned.add(own)
        self.root = f"{own}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.read(df, name)

    def read(self, like: DataFrame, *names: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*[self.path(n) for n in names])

    def drop(self, *names: str) -> None:
        """Deletes tables that no returned DataFrame reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for n in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(n))
            at.getFileSystem(conf).delete(at, True)


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A broadcast hint only where the table, counted now, has at most that many rows; else the plan shuffles it.
    Give it tables that are cheap to count: written ones, or those of a few columns."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
