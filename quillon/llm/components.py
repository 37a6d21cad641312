"""Connected components of an edge table: smallest labels spread along edges, with jumps to the label's own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import Scratch


def components(edges: DataFrame, a: str = "a", b: str = "b", held: Scratch | None = None) -> DataFrame:
    """v and label, the smallest vertex that v reaches, for every vertex of an edge.

    Each round takes the smallest label among the neighbours' and then follows it one step, so that a path of length n
    takes about log n rounds.  Rounds are written to the shared folder, and dropped when the next one is there; only the count of
    changes reaches the driver.  Neighbours' labels come by a join that splits where a vertex has many edges, and a minimum that is
    combined before its shuffle.  Edges may repeat, run either way, or join a vertex to itself; no edges give no rows.
    The result is a table, in held if that is given.
    """
    held = held or Scratch(edges.sparkSession, "components")
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = held.written(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels, old = held.written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels0"), "labels0"
    for n in range(1, 1000):
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").select(F.col("a").alias("v"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("old"))
        step = near.unionByName(labels.withColumn("old", F.col("label"))).groupBy("v").agg(F.min("label").alias("label"), F.min("old").alias("old"))
        onward = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        jumped = step.join(onward, "label").select("v", "old", F.least("label", "further").alias("label"))
        new = held.written(jumped, f"labels{n}")
        held.drop(old)
        old = f"labels{n}"
        labels = new.select("v", "label")
        if new.where("label <> old").isEmpty():
            break
    held.drop("edges")
    return labels
