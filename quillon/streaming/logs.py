"""Append logs as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillon.operators.ranking import completion


def append_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines as files of them come in."""
    return spark.readStream.schema(schema).json(path)


def completed_once(log: DataFrame, key: str, failed: Column) -> DataFrame:
    """A stream's completed rows, the first of each key; the keys seen are the state."""
    return log.where(~failed).dropDuplicates([key])


def index_batches(log: DataFrame, path: str, checkpoint: str, key: str, failed: Column, order: str) -> StreamingQuery:
    """After each batch a table path/batch=<n> with one row for each key of the batch (as D2 picks it), written whole again if the batch
    is run again, so that a lost driver leaves no row twice."""

    def put(batch: DataFrame, n: int) -> None:
        completion(batch, key, failed, F.col(order)).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return log.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_diagnostics(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows of a stream added to a table of JSON lines, each once."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def to_recompute(inputs: DataFrame, cache: DataFrame, key: str, content: Column) -> tuple[DataFrame, DataFrame]:
    """Cached results whose input still has the hash that they were made from, and the inputs that have none."""
    marked = inputs.withColumn("input_sha256", F.sha2(content, 256))
    hits = cache.join(marked.select(key, "input_sha256"), [key, "input_sha256"], "left_semi")
    return hits, marked.join(cache.select(key, "input_sha256"), [key, "input_sha256"], "left_anti")
