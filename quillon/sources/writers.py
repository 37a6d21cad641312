"""Sinks (K1 to K6, K8's data).  Spark's commit makes a folder appear whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, force: bool = False) -> None:
    """K1: df as JSON lines; a path that is there is an error unless force."""
    df.write.mode("overwrite" if force else "errorifexists").json(path)


def _put(spark: SparkSession, path: str, data: bytes, replace: bool) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target) and not replace:
        raise FileExistsError(path)
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} can't be put in place")


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found):
        return None
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def json_text(value: object) -> bytes:
    return (json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n").encode()


def json_object(spark: SparkSession, value: object, path: str, force: bool = False) -> None:
    """K2: a summary as JSON with sorted keys, under another name first and then renamed."""
    _put(spark, path, json_text(value), force)


def append(df: DataFrame, path: str) -> None:
    """K3: rows added to a table of JSON lines as files of their own; written ones are never touched."""
    df.write.mode("append").json(path)


def ordered_parquet(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """K4: a table of these columns in global order, in files that follow one another by name."""
    df.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)


def fan_out(df: DataFrame, path: str, targets: Column) -> None:
    """K5: every row under each of its targets (array<struct<arm,split>>), a folder for each arm and split."""
    df.withColumn("target", F.explode(targets)).select(*df.columns, "target.arm", "target.split").write.partitionBy("arm", "split").mode("errorifexists").json(path)


def if_identical(spark: SparkSession, value: object, path: str) -> bool:
    """K6: writes value as JSON; whether it was written.  The same bytes already there are left, others are an error."""
    data, held = json_text(value), read_bytes(spark, path)
    if held is None:
        _put(spark, path, data, False)
        return True
    if held != data:
        raise ValueError(f"{path} holds something else")
    return False


def search_index(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """K7: postings by bucket of their term, so that a query reads the buckets of its terms."""
    postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("term", "id").write.partitionBy("bucket").mode("errorifexists").parquet(path)


def report(spark: SparkSession, template: str, value: object, path: str) -> None:
    """K8: a page of HTML with value as JSON at the template's mark __DATA__."""
    held = json.dumps(value, ensure_ascii=False, sort_keys=True).replace("</", "<\\/")
    _put(spark, path, template.replace("__DATA__", held).encode(), True)
