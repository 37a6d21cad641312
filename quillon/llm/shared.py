"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Where it is unset a temporary folder is made and set, but only if driver and
    executors are one process: executors elsewhere would each write to a disk of their own."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if at.isDefined():
            return at.get()
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{_SETTING} must name a folder that driver and executors share (master {master})")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set(_SETTING, found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/quillon-{what}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends inside go at once: its result is in storage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """df, computed once and read back from a table in the shared folder: a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = new_path(spark, what)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables by name in a folder of their own, each dropped once what was made of it is written."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.folder, self.held = spark, new_path(spark, what), {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        with _shuffles_removed(self.spark):
            df.write.parquet(path)
        self.held[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            drop(self.spark, self.held.pop(name))

    def close(self) -> None:
        self.held.clear()
        drop(self.spark, self.folder)
