"""Tasks of a catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import budget
from quillon.operators.sets import join_all
from quillon.storage import checkpointed


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with each row's number, from 0, in global order.  Rows are sorted in ranges; what the driver gets is each range's size."""
    sorted_ = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted(sorted_.groupBy("__part").agg(F.count("*").alias("n")).collect())  # one row a partition
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __start bigint")
    return sorted_.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__start") + F.col("__k")).drop("__part", "__k", "__start")


def goals(products: DataFrame, key: str, pos: str, instructions: str) -> DataFrame:
    """task_id, the product's key, instruction, attributes, options and price_upper (N13) of every instruction with attributes,
    numbered by product and place.  instructions: array<struct<instruction,attributes,options>>."""
    each = products.select(F.col(key), F.col(pos).alias("__pos"), F.posexplode(instructions).alias("__i", "g")).where(F.size("g.attributes") > 0)
    made = each.select(key, "__pos", "__i", "g.instruction", "g.attributes", "g.options", budget(F.col("g.instruction")).alias("price_upper"))
    return numbered(made, "task_id", F.col("__pos"), F.col("__i")).drop("__pos", "__i")


def product_summary(products: DataFrame, allowed: list[str], attributes: str, ranks: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The allowed fields, the first attributes and the rank among the results, null if the product isn't among them."""
    return products.select(key, *allowed, F.slice(attributes, 1, most).alias(attributes)).join(ranks.select(key, "rank"), key, "left")


def assembled(base: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Base with a struct of every part's row; a key that a part lacks or has twice is an error."""
    packed = {n: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(n)) for n, df in parts.items()}
    return reduce(lambda out, df: join_all(out, df, key), packed.values(), base)


def products_by(products: DataFrame, mode: str, value: str | None = None, seed: int = 0, most: int = 150) -> DataFrame:
    """The products of a category (c), with an attribute (a), with a query (q), or so many at random (r), the same for a seed."""
    if mode == "r":
        return products.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "asin"), 256)).limit(most)
    wanted = {"c": F.col("category") == value, "a": F.array_contains("attribute", value), "q": F.col("query") == value}
    return products.where(wanted[mode])
