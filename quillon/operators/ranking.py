"""Selection, order and sampling that repeat exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import stable_hash


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key by order, as one aggregation that is combined before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The smallest row of each key by order; D4's order is the eight measures and then the request."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def completion(log: DataFrame, key: str, failed: Column, *order: Column) -> DataFrame:
    """A row a key: the completed row if there is one, else the last failure; n_completed tells conflicts (more than 1)."""
    row = F.struct(*[F.col(c) for c in log.columns])
    rank = F.struct(~failed, *order)
    return log.groupBy(F.col(key).alias("__key")).agg(F.max_by(row, rank).alias("r"), F.count_if(~failed).alias("n_completed")).select("r.*", "n_completed")


def best_candidate(df: DataFrame, key: str, no_guard: Column, gold: Column, steps: Column, tie: Column) -> DataFrame:
    """A row a key: without a guard before with one, gold before not, fewer steps, then the largest tie."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(row, F.struct(no_guard, gold, -steps, tie)).alias("r")).select("r.*")


def first_accepted(df: DataFrame, key: str, accepted: Column, held_out: Column, *order: Column) -> DataFrame:
    """Df with verdict: held_out, rejected, duplicate_task (a task's later accepted row) or accepted."""
    candidate = accepted & ~held_out
    first = df.where(candidate).groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    found = df.join(first, key, "left")
    verdict = F.when(held_out, "held_out").when(~accepted, "rejected").when(F.struct(*order) == F.col("__first"), "accepted").otherwise("duplicate_task")
    return found.withColumn("verdict", verdict).drop("__first")


def quotas(sizes: DataFrame, stratum: str, total: int) -> DataFrame:
    """Total shared out among strata in proportion to n, largest remainders first, ties to the smaller stratum, none above its
    size.  sizes: a row a stratum.  An error if total is beyond all rows; nothing to share gives zeros."""
    whole = sizes.crossJoin(sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("of")))  # one row
    refuse = F.when(F.col("of") < total, F.raise_error(F.format_string("%d of %d rows asked for", F.lit(total), F.col("of"))).cast("bigint"))
    whole = whole.withColumn("of", F.coalesce(refuse, F.col("of")))
    whole = whole.withColumn("floor", F.expr(f"if(of = 0, 0L, ({total} * n) div greatest(of, 1))")).withColumn("rest", F.expr(f"if(of = 0, 0L, ({total} * n) % greatest(of, 1))"))
    spare = whole.crossJoin(whole.agg((F.lit(total) - F.sum("floor")).alias("spare")))  # one row
    place = F.row_number().over(Window.orderBy(F.desc("rest"), stratum))  # over strata only; a rest above 0 leaves room below n
    return spare.withColumn("quota", F.least("n", F.col("floor") + (place <= F.col("spare")).cast("bigint"))).select(stratum, "quota")


def stratified_split(df: DataFrame, key: str, stratum: str, train: int, dev: int, seed: int) -> DataFrame:
    """Split (train, dev or reserve) for every row: quotas by stratum, filled in order of the stable hash.  Only the rows
    that a group limit lets through are ranked: all others are reserve."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n"))
    for_train = quotas(sizes, stratum, train).withColumnRenamed("quota", "train_quota")
    left = sizes.join(for_train, stratum).select(stratum, (F.col("n") - F.col("train_quota")).alias("n"))
    for_dev = quotas(left, stratum, dev).withColumnRenamed("quota", "dev_quota")
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(stable_hash(F.lit(seed), F.col(stratum), F.col(key)), key))
    top = df.select(key, stratum).withColumn("place", place).where(F.col("place") <= train + dev)
    top = top.join(for_train, stratum).join(for_dev, stratum)
    split = F.when(F.col("place") <= F.col("train_quota"), "train").when(F.col("place") <= F.col("train_quota") + F.col("dev_quota"), "dev")
    named = top.select(key, split.alias("split")).where("split is not null")
    return df.join(named, key, "left").withColumn("split", F.coalesce("split", F.lit("reserve")))


def subset(df: DataFrame, key: str, seed: int, count: int | None = None, ratio: float | None = None) -> DataFrame:
    """The count rows, or the share of all (rounded half to even, one at least), with the smallest stable hashes."""
    if count is None:
        count = max(1, round(df.count() * ratio))
    return df.orderBy(stable_hash(F.lit(seed), F.col(key)), key).limit(count)


def taskwise_split(df: DataFrame, task: str, ratio: float, seed: int) -> DataFrame:
    """Df with is_validation: all rows of a share of the tasks, one at least and all but one at most."""
    tasks = df.select(task).distinct()
    n = tasks.count()
    wanted = min(max(1, round(n * ratio)), max(0, n - 1))
    chosen = tasks.orderBy(stable_hash(F.lit(seed), F.col(task)), task).limit(wanted).withColumn("is_validation", F.lit(True))
    return df.join(chosen, task, "left").withColumn("is_validation", F.coalesce("is_validation", F.lit(False)))


def refill(source: DataFrame, reserve: DataFrame, invalid: DataFrame, key: str, stratum: str, split: str, seed: int) -> DataFrame:
    """Split, task and replaces: invalid rows of source (dev before train) take the first reserve row of their stratum, in order
    of the stable hash, and what is left over any reserve row.  Slots and reserve rows are matched by their numbers."""
    order = F.struct((F.col(split) != "dev").alias("late"), F.col(key).alias("id"))
    slots = source.join(invalid.select(key), key, "left_semi").select(F.col(key).alias("replaces"), split, stratum, order.alias("o"))
    spare = reserve.select(F.col(key).alias("task"), stratum, stable_hash(F.lit(seed), F.lit("reserve"), F.col(key)).alias("h"))
    by = Window.partitionBy(stratum)
    slots = slots.withColumn("k", F.row_number().over(by.orderBy("o")))
    wanted = slots.count()
    spare = spare.withColumn("k", F.row_number().over(by.orderBy("h", "task"))).where(F.col("k") <= 2 * wanted)  # a group limit
    matched = slots.join(spare.select(stratum, "k", "task", "h"), [stratum, "k"])
    rest = slots.join(matched.select("replaces"), "replaces", "left_anti").withColumn("k", F.row_number().over(Window.orderBy("o")))  # invalid rows are few
    left = spare.join(matched.select("task"), "task", "left_anti").orderBy("h", "task").limit(wanted).withColumn("k", F.row_number().over(Window.orderBy("h", "task")))
    more = rest.join(left.select("k", "task"), "k")
    return matched.select(split, "task", "replaces").unionByName(more.select(split, "task", "replaces"))


def curriculum(df: DataFrame, difficulty: Column, rewrites: Column, compares: Column) -> DataFrame:
    """Df with bucket (simple rows are foundation, medium ones that neither rewrite nor compare are constraints, the rest is
    strategy) and stages, the cumulative stages that train on it."""
    plain = (difficulty == "medium") & ~F.coalesce(rewrites, F.lit(False)) & ~F.coalesce(compares, F.lit(False))
    out = df.withColumn("bucket", F.when(difficulty == "simple", "foundation").when(plain, "constraints").otherwise("strategy"))
    stages = F.expr("case bucket when 'foundation' then array('a', 'b', 'c') when 'constraints' then array('b', 'c') else array('c') end")
    return out.withColumn("stages", stages)


def review_flags(difficulty: Column, compares: Column, opened: Column, consecutive: Column, searches: Column, steps: Column) -> Column:
    """The sorted flags of a row: too little compared, an action twice in a row, more searches or steps than its
    difficulty allows."""
    # Searches and steps by difficulty.
    most_searches = F.when(difficulty == "simple", 2).when(difficulty == "medium", 4).when(difficulty == "hard", 6)
    most_steps = F.when(difficulty == "simple", 10).when(difficulty == "medium", 16).when(difficulty == "hard", 25)
    flags = F.array(
        F.when(compares & (opened < 2), "candidate_comparison_under_evidenced"),
        F.when(consecutive > 0, "consecutive_exact_action"),
        F.when(searches > most_searches, "search_heavy"),
        F.when(steps > most_steps, "trajectory_long"),
    )
    return F.array_compact(flags)


def paged(df: DataFrame, part: str, size: int, *order: Column) -> DataFrame:
    """Rank, page and total_pages of each row within its part."""
    rank = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    n = F.count("*").over(Window.partitionBy(part))
    return df.withColumn("rank", rank).withColumn("page", F.ceil(F.col("rank") / size).cast("int")).withColumn("total_pages", F.ceil(n / size).cast("int"))


def indexed(df: DataFrame, part: str, name: str, *order: Column) -> DataFrame:
    """Df with the row's number in its part, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)


def batches(sizes: Column, most_rows: int, most_size: int) -> Column:
    """For an array of sizes the number of each one's batch, from 0: a batch ends when it has most_rows or would pass
    most_size.  A fold inside the row, as every start depends on the one before."""
    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("batch"), F.lit(0).alias("rows"), F.lit(0).cast("bigint").alias("size"))

    def step(s: Column, x: Column) -> Column:
        new = (s["rows"] > 0) & ((s["rows"] >= most_rows) | (s["size"] + x > most_size))
        batch = s["batch"] + new.cast("int")
        return F.struct(F.concat(s["out"], F.array(batch)).alias("out"), batch.alias("batch"), F.when(new, 1).otherwise(s["rows"] + 1).alias("rows"), F.when(new, x.cast("bigint")).otherwise(s["size"] + x).alias("size"))

    return F.aggregate(sizes, zero, step, lambda s: s["out"])


def interleaved_events(steps: DataFrame, guards: DataFrame, part: str) -> DataFrame:
    """Part, event_id (e0000 on), kind and index: guards (before_step, index) stand before their step (index), those
    without a step come last."""
    last = F.lit(1 << 30)
    rows = steps.select(part, F.col("index"), F.col("index").alias("pos"), F.lit(1).alias("late"), F.lit("step").alias("kind"))
    rows = rows.unionByName(guards.select(part, F.col("index"), F.coalesce("before_step", last).alias("pos"), F.lit(0).alias("late"), F.lit("guard").alias("kind")))
    number = F.row_number().over(Window.partitionBy(part).orderBy("pos", "late", "index")) - 1
    return rows.select(part, F.format_string("e%04d", number).alias("event_id"), "kind", "index")


# --- what a trajectory's steps show (process features) ----------------------------------------------------------------


def divergence(steps: DataFrame, task: str, attempt: str, turn: str, signature: str) -> DataFrame:
    """Task and first_divergence_turn: the first turn at which a task's attempts differ, a missing turn being a
    difference; null if none does."""
    attempts = steps.groupBy(task).agg(F.count_distinct(F.col(attempt)).alias("attempts"))
    turns = steps.groupBy(task, turn).agg(F.count_distinct(F.col(signature)).alias("kinds"), F.count_distinct(F.col(attempt)).alias("present")).join(attempts, task)
    return turns.groupBy(task).agg(F.min(F.when((F.col("kinds") > 1) | (F.col("present") < F.col("attempts")), F.col(turn))).alias("first_divergence_turn"))


def decision_ready(steps: DataFrame, part: str, turn: str, visible: Column, evidence: str, required: list[str], buys: Column) -> DataFrame:
    """Part, ready_step (the first at which visible holds and all required evidence has been seen, that step's own included)
    and steps_after it that don't buy (0 without a ready step)."""
    so_far = Window.partitionBy(part).orderBy(turn)
    seen = [F.max((F.col(evidence) == r).cast("int")).over(so_far) for r in required]
    ready = visible & (F.coalesce(sum(seen), F.lit(0)) == len(required)) if required else visible
    marked = steps.select(part, F.col(turn).alias("turn"), F.coalesce(ready, F.lit(False)).alias("ready"), buys.alias("buys"))
    first = F.min(F.when(F.col("ready"), F.col("turn"))).over(Window.partitionBy(part))
    marked = marked.withColumn("ready_step", first)
    return marked.groupBy(part, "ready_step").agg(F.count_if((F.col("turn") > F.col("ready_step")) & ~F.col("buys")).alias("steps_after"))


def step_repeats(steps: DataFrame, part: str, order: list[str], signature: str, observation: str) -> DataFrame:
    """Per part, actions whose observation equals the one before (no_progress), repeats of a signature (n - 1 each),
    and actions whose signature is among the three before (recent)."""
    w = Window.partitionBy(part).orderBy(*order)
    marked = steps.select(
        part,
        signature,
        (F.col(observation) == F.lag(observation).over(w)).alias("same"),
        F.array_contains(F.collect_list(signature).over(w.rowsBetween(-3, -1)), F.col(signature)).alias("recent"),
    )
    return marked.groupBy(part).agg(F.count_if("same").alias("no_progress"), (F.count("*") - F.count_distinct(F.col(signature))).alias("repeats"), F.count_if("recent").alias("recent_repeats"))
