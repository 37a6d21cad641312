"""Leakage between splits: keys, components, audit, allocation of whole components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import stable_hash
from quillon.storage import checkpointed


def leakage_keys(tasks: DataFrame, task: str, kinds: dict[str, Column]) -> DataFrame:
    """G1: task and key, a row for each distinct key of a task.  kinds: a string or an array of strings by kind of key; a key
    is its kind, a colon and the value.  Null and empty values make no key."""
    kind_of = dict(zip(kinds, tasks.select(*kinds.values()).schema.fields, strict=True))

    def named(kind: str):
        return lambda v: F.when(v != "", F.concat(F.lit(f"{kind}:"), v))

    arrays = [F.transform(c if kind_of[k].dataType.typeName() == "array" else F.array(c), named(k)) for k, c in kinds.items()]
    return tasks.select(F.col(task).alias("task"), F.explode(F.array_compact(F.array_distinct(F.concat(*arrays)))).alias("key"))


def leakage_components(keys: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Task and root, the smallest task that shared keys reach.  Labels go from tasks to their keys and back, smallest first,
    and then one step along the label's own label, so that a chain takes about log n rounds.  Minima are combined before
    the shuffle, so a key that many tasks hold is no group anywhere.  Keys of one task join nothing and are left out."""
    shared = keys.groupBy("key").agg(F.count_distinct(F.col("task")).alias("n")).where("n > 1").select("key")
    links = checkpointed(keys.join(shared, "key").distinct())
    labels = checkpointed(links.select("task").distinct().withColumn("root", F.col("task")))
    for _ in range(most_rounds):
        of_key = links.join(labels, "task").groupBy("key").agg(F.min("root").alias("root"))
        near = links.join(of_key, "key").groupBy("task").agg(F.min("root").alias("near"))
        onward = labels.select(F.col("task").alias("near"), F.col("root").alias("further"))
        moved = labels.join(near, "task").join(onward, "near").select("task", F.col("root").alias("old"), F.least("root", "near", "further").alias("root"))
        moved = checkpointed(moved)
        labels = moved.select("task", "root")
        if moved.where("root <> old").isEmpty():
            alone = keys.select("task").distinct().join(labels, "task", "left_anti")
            return labels.unionByName(alone.select("task", F.col("task").alias("root")))
    raise ValueError(f"components didn't settle in {most_rounds} rounds")


def audit(owners: DataFrame) -> DataFrame:
    """Violations among owners (split, task, key): an id in two splits (kind task_id) or a key in two splits (kind: what
    stands before the key's colon), as kind, evidence_sha256 of the id or key, and the sorted splits.  No value leaves it."""
    splits = F.array_sort(F.collect_set("split")).alias("splits")  # splits are few
    ids = owners.groupBy("task").agg(splits).where(F.size("splits") > 1).select(F.lit("task_id").alias("kind"), F.sha2(F.col("task").cast("string"), 256).alias("evidence_sha256"), "splits")
    keys = owners.groupBy("key").agg(splits).where(F.size("splits") > 1).select(F.substring_index("key", ":", 1).alias("kind"), F.sha2("key", 256).alias("evidence_sha256"), "splits")
    return ids.unionByName(keys)


def isolate(components: DataFrame, final: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components (task, root) that no final task is in, and those members of the others that aren't final themselves."""
    held = components.join(final.select("task"), "task", "left_semi").select("root").distinct()
    return components.join(held, "root", "left_anti"), components.join(held, "root", "left_semi").join(final.select("task"), "task", "left_anti")


def interleaved(tasks: DataFrame, stratum: str, *hashed: Column) -> DataFrame:
    """Tasks with turn (from 1, their place by the stable hash within their stratum); in order of (turn, stratum) the
    strata take turns."""
    return tasks.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(stable_hash(*hashed))))


def allocate(pool: DataFrame, splits: list[tuple[str, int]], seed: int) -> DataFrame:
    """Split and task.  pool: task, root, difficulty.  For each split in turn, difficulties alternate in order of stable
    hashes; a task's component is taken whole, its members in order of another hash, up to the quota.  What a component has
    beyond it is lost to all later splits.  Components are claimed in the order of their first task, so their sizes' running sum tells
    what each gives.  ValueError if a quota can't be filled.

    Of each difficulty only the first turns are ranked, which a group limit keeps small, and more of them if the components that these reach don't
    fill the quota.  The running sum goes over quota components at most."""
    out = None
    for split, quota in splits:
        sizes = pool.groupBy("root").agg(F.count("*").alias("size"))
        most = pool.count()
        turns = 2 * quota
        while True:
            early = interleaved(pool, "difficulty", F.lit(seed), F.lit(split), F.col("difficulty"), F.col("task")).where(F.col("turn") <= turns)
            claims = checkpointed(early.groupBy("root").agg(F.min(F.struct("turn", "difficulty")).alias("at")).join(sizes, "root"))
            if turns >= most or (claims.agg(F.sum("size")).first()[0] or 0) >= quota:
                break
            turns *= 8
        first = claims.orderBy("at").limit(quota)  # each gives one task at least
        before = F.coalesce(F.sum("size").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        taken = first.withColumn("before", before).where(F.col("before") < quota).select("root", "before")
        taken = checkpointed(taken)
        place = F.row_number().over(Window.partitionBy("root").orderBy(stable_hash(F.lit(seed), F.lit(split), F.lit("component"), F.col("task"))))
        chosen = pool.join(taken, "root").withColumn("place", place + F.col("before")).where(F.col("place") <= quota).select(F.lit(split).alias("split"), "task")
        chosen = checkpointed(chosen)
        if chosen.count() < quota:
            raise ValueError(f"split {split} needs {quota} tasks")
        out = chosen if out is None else out.unionByName(chosen)
        pool = pool.join(taken.select("root"), "root", "left_anti")
    return out


def split_records(assigned: DataFrame, tasks: DataFrame) -> DataFrame:
    """Split, difficulty and n, with ids_sha256 of the split's sorted ids as a JSON list, which is one value: splits are
    as large as their quotas."""
    ids = assigned.groupBy("split").agg(F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("task")), lambda x: x.cast("string")), ","), F.lit("]")), 256).alias("ids_sha256"))
    return assigned.join(tasks.select("task", "difficulty"), "task").groupBy("split", "difficulty").agg(F.count("*").alias("n")).join(ids, "split")


def manifest_problems(assigned: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """split and problem: a count that isn't the quota, an id that a split holds twice."""
    counts = assigned.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct(F.col("task")).alias("ids"))
    wanted = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    found = F.array_compact(F.array(F.when(~F.col("n").eqNullSafe(F.element_at(wanted, F.col("split")).cast("bigint")), "count"), F.when(F.col("ids") != F.col("n"), "duplicate_id")))
    return counts.select("split", F.explode(found).alias("problem"))


def distinct_content(df: DataFrame, content: Column, *order: Column) -> DataFrame:
    """One row of each content, told by its sha256, the first by order."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(F.sha2(content, 256).alias("content_sha256")).agg(F.min_by(row, F.struct(*order)).alias("row")).select("content_sha256", "row.*")
