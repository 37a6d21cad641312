"""Scans (S1 to S9, S11, S12).  A row that can't be read is an error or goes to a column of its own, never away unseen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_BAD = "_corrupt"


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines, gzip by the file's ending; blank lines are passed over and a line that is no object is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_checked(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad lines with their files."""
    kind = StructType([*schema.fields, StructField(_BAD, StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    parsed = lines.withColumn("row", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}))
    bad = F.col("row").isNull() | F.col(f"row.{_BAD}").isNotNull() | ~F.ltrim("value").startswith("{")
    return parsed.where(~bad).select("row.*").drop(_BAD), parsed.where(bad).select("file", "value")


def json_object(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The one object of each file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def keyed(df: DataFrame, key: str, allowed: DataFrame | None = None) -> DataFrame:
    """S3: df, if every row has a key, no two the same, and none that isn't allowed; the first fault found is an error."""
    n = df.groupBy(key).agg(F.count("*").alias("__n"))
    if allowed is not None:
        n = n.join(allowed.select(key).distinct().withColumn("__ok", F.lit(True)), key, "left")
    else:
        n = n.withColumn("__ok", F.lit(True))
    fault = F.when(F.col(key).isNull(), "a row without a key").when(F.col("__n") > 1, F.concat(F.lit("key twice: "), F.col(key).cast("string"))).when(F.col("__ok").isNull(), F.concat(F.lit("key not allowed: "), F.col(key).cast("string")))
    checked = n.select(F.col(key).alias("__key"), F.coalesce(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")), F.lit(True)).alias("__fine"))
    return df.join(checked, F.col(key).eqNullSafe(F.col("__key"))).where("__fine").drop("__key", "__fine")


def task_facts(spark: SparkSession, path: str, schema: StructType, key: str, declared: int | None = None) -> DataFrame:
    """Keyed rows of JSON lines; no rows, or another number than declared, is an error."""
    df = keyed(json_lines(spark, path, schema), key)
    n = df.count()
    if n == 0 or (declared is not None and n != declared):
        raise ValueError(f"{path} has {n} rows" + ("" if declared is None else f", {declared} declared"))
    return df


def task_ids(spark: SparkSession, path: str) -> DataFrame:
    """Pos and task_id, from a JSON array, an object with task_ids, lines of objects (task_id at the top or in extra_info) or
    lines of numbers; an id twice is an error."""
    text = spark.read.text(path, wholetext=path.endswith(".json"))
    listed = F.coalesce(F.from_json(F.get_json_object("value", "$.task_ids"), "array<string>"), F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")))
    one = F.array(F.coalesce(F.get_json_object("value", "$.task_id"), F.get_json_object("value", "$.extra_info.task_id"), F.trim("value")))
    lines = text.where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("line"), F.posexplode(F.coalesce(listed, one)).alias("k", "id"))
    return keyed(lines.select(F.struct("line", "k").alias("pos"), F.col("id").cast("bigint").alias("task_id")), "task_id")


def catalog(spark: SparkSession, path: str, schema: StructType | str, key: str = "asin") -> DataFrame:
    """Products of JSON arrays, a file a task and row by row inside it; of rows with a key the first counts; the key nan, no key and
    keys of more than 20 characters are left out."""
    df = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("__pos", F.monotonically_increasing_id())
    good = df.where(F.col(key).isNotNull() & ~F.lower(key).isin("nan", "") & (F.length(key) <= 20))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "__pos"])
    return good.groupBy(key).agg(F.min_by(row, "__pos").alias("r")).select("r.*")


def pinned(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The lines of a file whose bytes have this sha256, told without the file passing through the driver; another is an error."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha"), "path")
    bad = found.where(F.col("sha") != sha256).select("path", "sha").first()
    if bad:
        raise ValueError(f"{bad.path} has sha256 {bad.sha}")
    return spark.read.text(path)


def task_id(df: DataFrame, *paths: str) -> Column:
    """The first of several places of the id that df has a value at."""
    return F.coalesce(*[F.col(p) for p in paths])


def runs(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Rows of trajectories.jsonl in every folder beside a summary.json, with run, the folder's name."""
    both = lambda name: spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run"))
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "trajectories.jsonl").json(folder)
    named = rows.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    return named.join(F.broadcast(both("summary.json").distinct()), "run", "left_semi")  # a row a run
