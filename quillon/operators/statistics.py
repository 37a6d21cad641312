"""Paired statistics."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mcnemar(b: Column, c: Column) -> Column:
    """The exact two-sided p of b against c discordant pairs, 1 without any.  The terms of the binomial tail follow from one
    another in logs, starting from 2**-n, so that no count overflows."""
    n, m = b + c, F.least(b, c)
    zero = F.struct((-n * math.log(2)).alias("term"), F.exp(-n * math.log(2)).alias("sum"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] + F.log((n - k + 1) / k)
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    tail = F.aggregate(F.when(m > 0, F.sequence(F.lit(1).cast("bigint"), m.cast("bigint"))).otherwise(F.array().cast("array<bigint>")), zero, step, lambda s: s["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(df: DataFrame, family: str, p: str, *order: Column) -> DataFrame:
    """Df with p_holm, the step-down adjustment within each family; equal p keep the given order."""
    ranked = Window.partitionBy(family).orderBy(p, *order)
    m = F.count("*").over(Window.partitionBy(family))
    scaled = F.least(F.lit(1.0), (m - F.row_number().over(ranked) + 1) * F.col(p))
    return df.withColumn("__scaled", scaled).withColumn("p_holm", F.max("__scaled").over(ranked.rowsBetween(Window.unboundedPreceding, 0))).drop("__scaled")


def seed_of(*parts: object) -> int:
    """The first 32 hex digits of the parts' stable hash."""
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:32], 16)


def bootstrap_interval(deltas: list[float], seed: int, resamples: int = 2000, alpha: float = 0.05) -> tuple[float, float]:
    """The percentile interval of the mean of deltas."""
    draw, n = random.Random(seed).randrange, len(deltas)
    means = sorted(sum(deltas[draw(n)] for _ in range(n)) / n for _ in range(resamples))
    return means[math.floor(alpha / 2 * resamples)], means[math.ceil((1 - alpha / 2) * resamples) - 1]


def bootstrap(pairs: DataFrame, family: str, endpoint: str, key: str, delta: str, seed: int, resamples: int = 2000, alpha: float = 0.05) -> DataFrame:
    """Family, endpoint, low and high.  An endpoint's deltas are one task's: a family has as many as there are tasks in an
    evaluation, which were paired before; sorted by key, so that draws repeat."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        names = (table["family"][0].as_py(), table["endpoint"][0].as_py())
        low, high = bootstrap_interval(table["delta"].to_pylist(), seed_of(seed, *names), resamples, alpha)
        return pa.table({"family": [names[0]], "endpoint": [names[1]], "low": [low], "high": [high]})

    own = pairs.select(F.col(family).cast("string").alias("family"), F.col(endpoint).cast("string").alias("endpoint"), F.col(key).alias("key"), F.col(delta).cast("double").alias("delta")).where("delta is not null")
    return own.groupBy("family", "endpoint").applyInArrow(run, "family string, endpoint string, low double, high double")


def hash_bootstrap(pairs: DataFrame, family: str, key: str, delta: Column, resamples: int, seed: int) -> DataFrame:
    """X3 without a group in one task: every pair gets a Poisson(1) weight a resample from a hash, and resampled means are plain
    aggregates.  family, resample and mean."""
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("resample"), F.col("key")), 256), 1, 13), 16, 10).cast("double") / float(16**13)
    bounds, total = [], 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        bounds.append(total)
    weight = sum((u > b).cast("int") for b in bounds)
    each = pairs.select(F.col(family).alias("family"), F.col(key).cast("string").alias("key"), delta.cast("double").alias("delta")).withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    return each.withColumn("w", weight).groupBy("family", "resample").agg(F.try_divide(F.sum(F.col("w") * F.col("delta")), F.sum("w")).alias("mean"))


def paired_report(pairs: DataFrame, binary: list[str], continuous: list[str]) -> DataFrame:
    """For every pair of runs and endpoint n, the means, their difference, and for binary ones the discordant counts, the exact p
    and its Holm adjustment within the pair of runs.  Pairs with a null leave the endpoint alone."""
    one = lambda c, kind: F.struct(F.lit(c).alias("endpoint"), F.lit(kind).alias("kind"), F.col(f"left_{c}").cast("double").alias("l"), F.col(f"right_{c}").cast("double").alias("r"))
    stacked = F.array(*[one(c, "binary") for c in binary], *[one(c, "continuous") for c in continuous])
    long = pairs.select("left_run", "right_run", F.explode(stacked).alias("e")).select("left_run", "right_run", "e.*").where("l is not null and r is not null")
    out = long.groupBy("left_run", "right_run", "endpoint", "kind").agg(
        F.count("*").alias("n"), F.avg("l").alias("left_mean"), F.avg("r").alias("right_mean"), F.avg(F.col("r") - F.col("l")).alias("difference"),
        F.count_if(F.col("l") > F.col("r")).alias("b"), F.count_if(F.col("l") < F.col("r")).alias("c"),
    )
    out = out.withColumn("p", F.when(F.col("kind") == "binary", mcnemar(F.col("b"), F.col("c"))))
    family = F.concat_ws("/", "left_run", "right_run", "kind")
    return holm(out.withColumn("family", family), "family", "p", F.col("endpoint")).withColumn("p_holm", F.when(F.col("kind") == "binary", F.col("p_holm"))).drop("family")


def adjacent_families(runs: DataFrame, label: str) -> DataFrame:
    """The pairs of labels next to each other in order of name, as left_run and right_run."""
    after = F.lead(label).over(Window.orderBy(label))  # labels are few
    return runs.select(label).distinct().select(F.col(label).alias("left_run"), after.alias("right_run")).where("right_run is not null")
