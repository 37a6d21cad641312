"""Chats and tool calls reshaped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def call_texts(messages: DataFrame, chat: str, pos: str, role: str, call: str, text: str) -> DataFrame:
    """Tool messages with assistant_text: that of the last assistant message that made their call."""
    said = messages.where(F.col(role) == "assistant").groupBy(chat, call).agg(F.max_by(text, pos).alias("assistant_text"))
    return messages.where(F.col(role) == "tool").join(said, [chat, call], "left")


def previous_observation(messages: DataFrame, chat: str, pos: str, role: str, text: str, guard: Column) -> DataFrame:
    """Messages with observed, the text of the latest earlier tool message that no guard made."""
    before = Window.partitionBy(chat).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("observed", F.last(F.when((F.col(role) == "tool") & ~guard, F.col(text)), ignorenulls=True).over(before))


def chat_rows(messages: DataFrame, chat: str, pos: str, role: str, text: str, keep: Column, final_text: str | None = None) -> DataFrame:
    """Chat and messages, array<struct<role,text>> in order, of the messages to keep; the last one's text is replaced if final_text is
    given, as it may tell the result.  A chat's messages are one row."""
    kept = messages.where(keep)
    ordered = kept.groupBy(chat).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(role).alias("role"), F.col(text).alias("text")))).alias("m"))
    shown = lambda m, i: F.when(i == F.size("m") - 1, F.lit(final_text)).otherwise(m["text"]) if final_text is not None else m["text"]
    return ordered.select(chat, F.transform("m", lambda m, i: F.struct(m["role"].alias("role"), shown(m, i).alias("text"))).alias("messages"))


def projected(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed fields only (a.b for one inside a struct), in their order; one that isn't there is an error."""
    return df.select(*[F.col(c).alias(c.replace(".", "_")) for c in allowed])


def masked_labels(ids: Column, owners: Column, teach: str = "assistant", ignored: int = -100) -> Column:
    """The token ids where their owner is taught, else the ignored label; ids and owners are arrays of one length."""
    return F.zip_with(ids, owners, lambda i, o: F.when(o == teach, i).otherwise(ignored))


def training_rows(df: DataFrame, ids: Column, owners: Column, most: int) -> DataFrame:
    """Df with labels, without rows of more than most ids or with nothing to teach."""
    out = df.withColumn("labels", masked_labels(ids, owners))
    return out.where((F.size("labels") <= most) & F.exists("labels", lambda x: x >= 0))


def kept_suffix(messages: DataFrame, chat: str, pos: str, group: str, size: str, anchor: Column, budget: int) -> DataFrame:
    """The anchor messages, and of the others the longest run of whole groups at the chat's end whose sizes with the anchors' stay
    within budget; a group is kept or left out as a whole."""
    every = Window.partitionBy(chat)
    marked = messages.withColumn("__anchor", anchor)
    marked = marked.withColumn("__fixed", F.coalesce(F.sum(F.when(F.col("__anchor"), F.col(size))).over(every), F.lit(0)))
    back = every.orderBy(F.desc(group)).rangeBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("__tail", F.coalesce(F.sum(F.when(~F.col("__anchor"), F.col(size))).over(back), F.lit(0)))
    return marked.where(F.col("__anchor") | (F.col("__fixed") + F.col("__tail") <= budget)).drop("__anchor", "__fixed", "__tail")


def aligned_suffix(arrays: dict[str, Column], anchor: Column, most: Column) -> dict[str, Column]:
    """Arrays of one length cut alike: the first anchor elements, then as many from the end as fit into most."""
    some = next(iter(arrays.values()))
    room = F.greatest(most - anchor, F.lit(0))
    tail = F.least(room, F.greatest(F.size(some) - anchor, F.lit(0)))
    return {n: F.concat(F.slice(a, F.lit(1), F.least(anchor, F.size(a))), F.slice(a, F.size(a) - tail + 1, tail)) for n, a in arrays.items()}


def fitted(lines: Column, budget: int, size: Callable[[Column], Column] = F.length) -> Column:
    """A page's lines, as many from the beginning as stay within budget together, one for each line end."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("kept"), F.lit(True).alias("open"))

    def step(s: Column, line: Column) -> Column:
        n = s["n"] + size(line) + 1
        fits = s["open"] & (n <= budget + 1)
        return F.struct(F.when(fits, n).otherwise(s["n"]).alias("n"), (s["kept"] + fits.cast("int")).alias("kept"), fits.alias("open"))

    return F.slice(lines, F.lit(1), F.aggregate(lines, zero, step, lambda s: s["kept"]))


def unstable(replays: DataFrame, task: str, signature: str) -> DataFrame:
    """Tasks whose replays have more than one signature, with how many."""
    return replays.groupBy(task).agg(F.count_distinct(F.col(signature)).alias("signatures")).where("signatures > 1")


def loader_stats(rows: DataFrame, wanted: DataFrame | None, key: str, kept: Column) -> DataFrame:
    """One row: total, filtered_out (not among wanted), kept, dropped, and matched, the wanted keys that have a row."""
    own = rows.select(key, kept.alias("kept"))
    if wanted is None:
        own = own.withColumn("wanted", F.lit(True))
    else:
        own = own.join(wanted.select(key).distinct().withColumn("wanted", F.lit(True)), key, "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    good = F.col("wanted") & F.col("kept")
    return own.agg(F.count("*").alias("total"), F.count_if(~F.col("wanted")).alias("filtered_out"), F.count_if(good).alias("kept"), F.count_if(F.col("wanted") & ~F.col("kept")).alias("dropped"), F.count_distinct(F.when(F.col("wanted"), F.col(key))).alias("matched"))


def recovered_query(instruction: Column, first_user: Column) -> Column:
    """The instruction, or the first user message without its heading."""
    plain = F.trim(F.regexp_replace(first_user, r"^\s*Instruction:\s*", ""))
    return F.coalesce(F.when(F.trim(instruction) != "", F.trim(instruction)), F.when(plain != "", plain))


def digested(df: DataFrame, private: list[str]) -> DataFrame:
    """Df with sha256 digests (<name>_sha256) in place of the private columns."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in private], *[F.sha2(F.col(f"`{c}`").cast("string"), 256).alias(f"{c}_sha256") for c in private])
