"""Joins with their checks and set operations (J1 to J3, J8 to J11, J15, J17, U1 to U6, D2's resume)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_all(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left with right's columns; a key of left that right doesn't have is an error, as is a second row of right's key."""
    once = right.groupBy(key).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in right.columns if c != key])
    out = left.join(once, key, "left")
    refuse = F.when(F.col("__n").isNull(), F.raise_error(F.concat(F.lit(f"no row of {key} "), F.col(key).cast("string")))).when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"several rows of {key} "), F.col(key).cast("string"))))
    return out.withColumn("__n", F.coalesce(refuse.cast("bigint"), F.col("__n"))).where("__n = 1").drop("__n")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that both have, each once."""
    return left.select(key).intersect(right.select(key))


def leaked(train: DataFrame, others: dict[str, DataFrame], key: str) -> DataFrame:
    """Split and key of every training key that another split has."""
    each = [train.select(key).distinct().join(df.select(key).distinct(), key, "left_semi").select(F.lit(name).alias("split"), key) for name, df in others.items()]
    return reduce(DataFrame.unionByName, each)


def remaining(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without a finished row."""
    return jobs.join(done.select(*keys), keys, "left_anti")


def without_known(df: DataFrame, known: DataFrame, content: Column, only: Column) -> DataFrame:
    """Df without those rows of the sources told by only whose content's hash known (content_sha256) has."""
    marked = df.withColumn("content_sha256", F.sha2(content, 256))
    return marked.where(~only).unionByName(marked.where(only).join(known.select("content_sha256"), "content_sha256", "left_anti").select(*marked.columns))


def missing_and_extra(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Key and side, missing or extra; no rows for equal sets."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def tagged_union(sources: dict[str, DataFrame]) -> DataFrame:
    """The rows of all sources with the source's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source", F.lit(name)) for name, df in sources.items()])


def any_of(*sets: DataFrame) -> DataFrame:
    """The ids that any of the sets has, each once."""
    return reduce(DataFrame.union, sets).distinct()


def contained(texts: DataFrame, text: str, needles: DataFrame, needle: str, least: int = 4, most: int = 10_000) -> DataFrame:
    """Texts with the needles that they hold, as pairs.  Needles shorter than least are passed over; all others are tried
    on every text, so more than most of them are refused."""
    wanted = needles.select(F.col(needle).alias("needle")).where(F.length(needle) >= least).distinct()
    many = wanted.count()
    if many > most:
        raise ValueError(f"{many} needles; {most} at most are tried on every text")
    return texts.join(F.broadcast(wanted), F.contains(F.col(text), F.col("needle")))  # most needles
