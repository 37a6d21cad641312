"""Aggregations over evaluations and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed_denominator(expected: DataFrame, rows: DataFrame, key: str, success: Column, value: Column, order: list[str] | None = None) -> DataFrame:
    """A1: one row; rates over all expected keys, means over those that have a row.  Rows of other keys are passed over.  Of a
    key's rows the last by order counts; without an order, any success and the sum of the values."""
    if order:
        last = F.max(F.struct(F.struct(*order), success.cast("int").alias("ok"), value.alias("v")))
        found = rows.groupBy(key).agg(last.alias("last")).select(key, "last.ok", "last.v")
    else:
        found = rows.groupBy(key).agg(F.max(success.cast("int")).alias("ok"), F.sum(value).alias("v"))
    return expected.join(found, key, "left").agg(
        F.count("*").alias("n_expected"), F.count("ok").alias("n_completed"), F.coalesce(F.sum("ok"), F.lit(0)).alias("n_success"),
        (F.coalesce(F.sum("ok"), F.lit(0)) / F.count("*")).alias("success_rate"), F.avg("v").alias("mean_value"),
    )


def panels(expected: DataFrame, rows: DataFrame, key: str, rates: dict[str, Column], means: dict[str, Column]) -> DataFrame:
    """A2: one row; every rate and mean over all expected keys, missing rows counting as 0.  Rows of other keys and second rows
    of a key are an error."""
    own = rows.select(key, *[c.cast("int").alias(n) for n, c in rates.items()], *[c.cast("double").alias(n) for n, c in means.items()], F.lit(1).alias("__row"))
    odd = own.groupBy(key).agg(F.count("*").alias("n")).join(expected.withColumn("__expected", F.lit(True)), key, "left").agg(F.count_if(F.expr("n > 1 or __expected is null")).alias("bad"))
    joined = expected.join(own, key, "left").agg(
        F.count("*").alias("n_expected"), F.count("__row").alias("n_rows"),
        *[(F.coalesce(F.sum(n), F.lit(0)) / F.count("*")).alias(n) for n in [*rates, *means]],
    )
    checked = joined.crossJoin(odd)  # one row each
    refuse = F.when(F.col("bad") > 0, F.raise_error(F.lit("rows of unexpected or repeated keys")).cast("bigint"))
    return checked.withColumn("n_rows", F.coalesce(refuse, F.col("n_rows"))).drop("bad")


def trajectory_metrics(events: DataFrame, part: str, order: list[str], kind: str, signature: str, guard: Column, search: Column, opens: Column, product: Column, size: Column) -> DataFrame:
    """Per trajectory the counts of events, executed steps, guard rejections, searches, opened and distinct products,
    duplicate and consecutive actions over all attempts, distinct searches over executed ones, and the sum and maximum of size."""
    w = Window.partitionBy(part).orderBy(*order)
    marked = events.select(part, F.col(signature).alias("sig"), (F.lag(signature).over(w) == F.col(signature)).alias("again"), guard.alias("guard"), search.alias("search"), opens.alias("opens"), product.alias("product"), size.alias("size"))
    return marked.groupBy(part).agg(
        F.count("*").alias("n_events"), F.count_if(~F.col("guard")).alias("n_steps"), F.count_if("guard").alias("n_guards"),
        F.count_if(F.col("search") & ~F.col("guard")).alias("n_searches"), F.count_if(F.col("opens") & ~F.col("guard")).alias("n_opens"),
        F.count_distinct(F.when(F.col("opens") & ~F.col("guard"), F.col("product"))).alias("n_products"),
        (F.count("*") - F.count_distinct(F.col("sig"))).alias("n_duplicates"), F.count_if("again").alias("n_consecutive"),
        F.sum("size").alias("total_size"), F.max("size").alias("largest"),
    )


def repeats(events: DataFrame, part: str, order: list[str], signature: str) -> DataFrame:
    """A4: for each part, duplicates (not the first of their signature) and consecutive ones (as the one before)."""
    before = F.lag(signature).over(Window.partitionBy(part).orderBy(*order))
    marked = events.select(part, signature, (before == F.col(signature)).alias("again"))
    return marked.groupBy(part).agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct(F.col(signature))).alias("duplicates"), F.count_if("again").alias("consecutive"))


def counters(df: DataFrame, part: str, kind: str) -> DataFrame:
    """A5: part and counts, its kinds with their numbers as a map with sorted keys.  Kinds are few."""
    counted = df.groupBy(part, kind).agg(F.count("*").alias("n"))
    return counted.groupBy(part).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("counts"))


def collection_quality(rows: DataFrame, task: str, gold: Column, eligible: Column) -> DataFrame:
    """Attempts, gold attempts and their rate over all rows (raw) and over eligible ones, tasks and the rate of eligible tasks with
    any gold attempt; rates to four places, null without rows."""
    marked = rows.select(F.col(task).alias("task"), gold.cast("int").alias("gold"), eligible.alias("eligible"))
    by_task = marked.groupBy("task", "eligible").agg(F.count("*").alias("n"), F.sum("gold").alias("gold"), F.max("gold").alias("any"))
    rate = lambda a, b: F.round(F.try_divide(a, b), 4)
    when = lambda c: F.coalesce(F.sum(F.when(F.col("eligible"), c)), F.lit(0))
    return by_task.agg(
        F.sum("n").alias("raw_attempts"), F.sum("gold").alias("raw_gold"), rate(F.sum("gold"), F.sum("n")).alias("raw_rate"),
        when(F.col("n")).alias("eligible_attempts"), when(F.col("gold")).alias("eligible_gold"), rate(when(F.col("gold")), when(F.col("n"))).alias("eligible_rate"),
        F.count_if("eligible").alias("eligible_tasks"), rate(when(F.col("any")), F.count_if("eligible")).alias("any_gold_rate"),
    )


def reachability_summary(classified: DataFrame, split: str, task: str, status: Column, reasons: Column) -> DataFrame:
    """Split, tasks, eligible ones, and counts by reason code as a map with sorted keys."""
    base = classified.groupBy(split).agg(F.count("*").alias("n_tasks"), F.count_if(status).alias("n_eligible"))
    why = classified.select(split, F.explode(reasons).alias("reason"))
    return base.join(counters(why, split, "reason").withColumnRenamed("counts", "reasons"), split, "left")


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Nearest-rank p50, p90, p95 and p99, interpolated quartiles and median, mean, population deviation, extremes, count.
    Exact: a group's distinct values with their counts are one task's; for continuous values of huge groups, bin them first."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"),
        rank(0.5).alias("p50"), rank(0.9).alias("p90"), rank(0.95).alias("p95"), rank(0.99).alias("p99"),
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"),
        F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.75).alias("q3"),
    )


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts of half-open bins, from 0, empty ones included; values outside the edges count nowhere."""
    bins = [F.count_if((F.col(value) >= a) & (F.col(value) < b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return df.agg(F.array(*bins).alias("n")).select(F.posexplode("n").alias("bin", "n"))


def step_buckets(df: DataFrame, steps: str, most: int, strict: Column, reward: Column) -> DataFrame:
    """Bucket, n, strict rate in percent to two places and mean reward to four, by steps 1-5, 6-10, 11-20 and 21-most; rows
    with other steps are in none."""
    s = F.col(steps)
    bucket = F.when(s.between(1, 5), "1-5").when(s.between(6, 10), "6-10").when(s.between(11, 20), "11-20").when(s.between(21, most), f"21-{most}")
    marked = df.select(bucket.alias("bucket"), strict.cast("int").alias("strict"), reward.alias("reward")).where("bucket is not null")
    return marked.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("strict").alias("n_strict"), F.round(100 * F.avg("strict"), 2).alias("strict_percent"), F.round(F.avg("reward"), 4).alias("mean_reward"))


def most_common(df: DataFrame, kind: str, task: str) -> DataFrame:
    """Kinds with their rows and distinct tasks, the commonest first, ties by name; rank from 1."""
    counted = df.groupBy(kind).agg(F.count("*").alias("n"), F.count_distinct(F.col(task)).alias("n_tasks"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), kind)))  # kinds are few


def agreement(df: DataFrame, tasks: DataFrame, key: str, run: str, success: Column, runs: int | None = None) -> DataFrame:
    """How many tasks were solved in 0, 1, 2 ... runs; with runs given, every k up to it has a row."""
    solved = df.where(success).groupBy(key).agg(F.count_distinct(F.col(run)).alias("k"))
    counted = tasks.select(key).distinct().join(solved, key, "left").select(F.coalesce("k", F.lit(0)).alias("k")).groupBy("k").agg(F.count("*").alias("n_tasks"))
    if runs is None:
        return counted
    every = df.sparkSession.range(runs + 1).withColumnRenamed("id", "k")
    return every.join(counted, "k", "left").select("k", F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"))


def unanimous(df: DataFrame, tasks: DataFrame, key: str, run: str, success: Column) -> DataFrame:
    """The tasks that no run solved (succeeded false) and those that every run of df solved (true)."""
    solved = df.where(success).groupBy(key).agg(F.count_distinct(F.col(run)).alias("k"))
    runs = df.agg(F.count_distinct(F.col(run)).alias("n"))  # one row
    counted = tasks.select(key).distinct().join(solved, key, "left").crossJoin(F.broadcast(runs))
    return counted.where("k is null or k = n").select(key, F.col("k").isNotNull().alias("succeeded"))


def paired(rows: DataFrame, key: str, run: str, columns: list[str]) -> DataFrame:
    """left_run, right_run and, for every key that both have, the columns of either with left_ and right_ before their names;
    each pair of runs once, the smaller name on the left."""
    side = lambda s: rows.select(key, F.col(run).alias(f"{s}_run"), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    return side("left").join(side("right"), key).where("left_run < right_run")


def fully_paired(left: DataFrame, right: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Key and problem (missing_left, missing_right, unexpected) wherever either run's keys aren't those expected."""
    seen = lambda df, n: df.select(key).distinct().withColumn(n, F.lit(True))
    every = seen(expected, "e").join(seen(left, "l"), key, "full").join(seen(right, "r"), key, "full")
    problems = F.array_compact(F.array(F.when(F.col("e").isNull(), "unexpected"), F.when(F.col("e") & F.col("l").isNull(), "missing_left"), F.when(F.col("e") & F.col("r").isNull(), "missing_right")))
    return every.select(key, F.explode(problems).alias("problem"))


def paired_deltas(pairs: DataFrame, columns: list[str], lower_is_better: set[str]) -> DataFrame:
    """For every pair of runs and column the means of both, the mean delta (right less left), and how often it is better, equal
    and worse, over the keys where both have a value."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"left_{c}").cast("double").alias("l"), F.col(f"right_{c}").cast("double").alias("r"), F.lit(-1 if c in lower_is_better else 1).alias("sign")) for c in columns]))
    long = pairs.select("left_run", "right_run", stacked.alias("m")).select("left_run", "right_run", "m.*").where("l is not null and r is not null")
    gain = (F.col("r") - F.col("l")) * F.col("sign")
    return long.groupBy("left_run", "right_run", "measure").agg(
        F.count("*").alias("n"), F.avg("l").alias("left_mean"), F.avg("r").alias("right_mean"), F.avg(F.col("r") - F.col("l")).alias("mean_delta"),
        F.count_if(gain > 0).alias("better"), F.count_if(gain == 0).alias("equal"), F.count_if(gain < 0).alias("worse"),
    )


def transition_matrix(pairs: DataFrame, column: str) -> DataFrame:
    """For every pair of runs how often the left one's state became the right one's on the same key."""
    change = F.concat_ws("_to_", F.col(f"left_{column}").cast("string"), F.col(f"right_{column}").cast("string"))
    return pairs.groupBy("left_run", "right_run", change.alias("change")).agg(F.count("*").alias("n"))


def successions(events: DataFrame, part: str, order: list[str], state: str) -> DataFrame:
    """Counts of a state and the one that follows it in its part."""
    after = F.lead(state).over(Window.partitionBy(part).orderBy(*order))
    return events.select(F.col(state).alias("left"), after.alias("right")).where("right is not null").groupBy("left", "right").agg(F.count("*").alias("n"))


def truncation(steps: DataFrame, part: str, order: list[str], truncated: Column, guard: Column, success: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A18 and A19.  First: truncated (whether any step of the trajectory was), trajectories, successes (success: part, ok) and
    their rate.  Second, one row: executed and guard events whose step before was truncated, and the guards' share."""
    marked = steps.select(part, *order, truncated.alias("truncated"), guard.alias("guard"))
    any_ = marked.groupBy(part).agg(F.max("truncated").alias("truncated")).join(success, part, "left")
    buckets = any_.groupBy("truncated").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_success"), F.avg(F.coalesce(F.col("ok"), F.lit(False)).cast("int")).alias("rate"))
    after = marked.withColumn("after", F.lag("truncated").over(Window.partitionBy(part).orderBy(*order))).where("after")
    rate = after.agg(F.count_if(~F.col("guard")).alias("executed"), F.count_if("guard").alias("guards"), F.try_divide(F.count_if("guard"), F.count("*")).alias("guard_rate"))
    return buckets, rate


def rollout_metrics(rows: DataFrame, measures: dict[str, Column], flags: dict[str, Column]) -> DataFrame:
    """One row with the mean, least and most of every measure and the rate of every flag; a value that isn't finite is an error."""
    own = rows.select(*[c.cast("double").alias(n) for n, c in measures.items()], *[c.alias(n) for n, c in flags.items()])
    finite = lambda n: F.when(F.isnan(n) | (F.abs(F.col(n)) == float("inf")), F.raise_error(F.lit(f"{n} isn't finite")).cast("double")).otherwise(F.col(n))
    out = [f(finite(n)).alias(f"{n}_{s}") for n in measures for s, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return own.agg(F.count("*").alias("n"), *out, *[F.avg(F.col(n).cast("int")).alias(f"{n}_rate") for n in flags])


def varying_groups(rows: DataFrame, group: str, index: str, utility: Column, invalid: Column, tolerance: float = 1e-8) -> DataFrame:
    """Group, first (its smallest index), n and verdict: sampling_invalid if any row is, else constant_reward if its utilities
    spread no more than tolerance (all_zero tells whether all of them are about 0), else kept."""
    own = rows.select(F.col(group).alias("group"), F.col(index).alias("i"), utility.alias("u"), invalid.alias("bad"))
    found = own.groupBy("group").agg(F.min("i").alias("first"), F.count("*").alias("n"), F.max("bad").alias("bad"), (F.max("u") - F.min("u")).alias("spread"), F.max(F.abs("u")).alias("top"))
    verdict = F.when(F.col("bad"), "sampling_invalid").when(F.col("spread") > tolerance, "kept").otherwise("constant_reward")
    return found.select("group", "first", "n", verdict.alias("verdict"), (F.col("top") <= tolerance).alias("all_zero"))


def accepted_groups(groups: DataFrame, remaining: int) -> DataFrame:
    """The first kept groups in order of first occurrence, remaining at most; place from 1."""
    top = groups.where("verdict = 'kept'").orderBy("first", "group").limit(remaining)
    return top.withColumn("place", F.row_number().over(Window.orderBy("first", "group")))  # remaining rows


def accept_in_batches(batches: list[DataFrame], wanted: int, most_batches: int = 3, most_skips: int = 10) -> tuple[list[list], int]:
    """A22 over generation batches (groups with verdicts): the accepted groups of each and the skips in a row at the end.  No more than
    most_batches batches give groups; most_skips batches in a row without a kept group are an error."""
    out, skips, used = [], 0, 0
    for batch in batches:
        if wanted <= 0 or used == most_batches:
            break
        got = [r.group for r in accepted_groups(batch, wanted).collect()]  # wanted at most
        skips = 0 if got else skips + 1
        if skips > most_skips:
            raise ValueError(f"{skips} batches in a row without a varying group")
        used += bool(got)
        wanted -= len(got)
        out.append(got)
    return out, skips


def collection_summary(rows: DataFrame, status: str, reward_type: Column, gold: Column, infra: Column) -> DataFrame:
    """One row: rows, counts by status and by reward type as sorted maps, rates of gold and of infrastructure failures
    over the rows there are."""
    own = rows.select(F.lit(1).alias("one"), F.col(status).alias("status"), reward_type.alias("reward_type"), gold.cast("int").alias("gold"), infra.cast("int").alias("infra"))
    base = own.agg(F.count("*").alias("n"), F.avg("gold").alias("gold_rate"), F.avg("infra").alias("infra_rate"))
    by = lambda c: counters(own, "one", c).select(F.col("counts").alias(f"{c}_counts"))
    return base.crossJoin(by("status")).crossJoin(by("reward_type"))  # one row each


def merge_report(rows: DataFrame, source: str, content: Column, kept: Column) -> DataFrame:
    """By source the rows, those kept and discarded, and the groups of equal content that it has rows in."""
    size = rows.select(F.col(source).alias("source"), F.sha2(content, 256).alias("h"), kept.alias("kept"))
    groups = size.groupBy("h").agg(F.count("*").alias("members")).where("members > 1").select("h").withColumn("again", F.lit(True))
    return size.join(groups, "h", "left").groupBy("source").agg(
        F.count("*").alias("n"), F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_dropped"), F.count_distinct(F.when(F.col("again"), F.col("h"))).alias("duplicate_groups"),
    )


def id_hashes(ids: DataFrame, key: str, position: Column) -> DataFrame:
    """sha256 of the ids as a JSON list, in order of position (ordered_sha256) and as a sorted set (set_sha256).  The list is one value by
    its definition: for the ids of a manifest, not of a corpus."""
    listed = lambda a: F.sha2(F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]")), 256)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), F.col(key).alias("k")))), lambda x: x["k"])
    return ids.agg(listed(ordered).alias("ordered_sha256"), listed(F.array_sort(F.collect_set(key))).alias("set_sha256"))


def running_projection(steps: DataFrame, part: str, order: list[str], size: str) -> DataFrame:
    """Steps with the sum and maximum of size so far in its part."""
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("size_so_far", F.sum(size).over(w)).withColumn("largest_so_far", F.max(size).over(w))


def evaluation_facts(ids: DataFrame, facts: DataFrame, key: str, held_out: DataFrame) -> DataFrame:
    """Facts of the ids (key, pos) in their order, with missing (no fact) and overlaps (the id is held out)."""
    known = facts.withColumn("__known", F.lit(True))
    out = ids.join(known, key, "left").join(held_out.select(key).distinct().withColumn("__held", F.lit(True)), key, "left")
    return out.withColumn("missing", F.col("__known").isNull()).withColumn("overlaps", F.col("__held").isNotNull()).drop("__known", "__held").orderBy("pos")
