"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder, if driver and executors are one process."""
    context = spark.sparkContext
    found = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING)
    if not found:
        at = context._jsc.sc().getCheckpointDir()
        if at.isDefined():
            return at.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"{_SETTING} must name a folder that driver and executors share (master {context.master})")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
