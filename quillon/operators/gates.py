"""Acceptance of trajectories, rows and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

# Fixed values.
INFRASTRUCTURE_ERRORS = ("ConnectionError", "ContextBudgetError", "OSError", "RemoteDisconnected", "ShopEnvironmentError", "ShopHttpError", "TimeoutError", "URLError")
REWARD_VERSION = "shopsimulator-reward-v3"


def strict_success(status: Column, done: Column, ended: Column, over: Column, version: Column, kind: Column, valid: Column, success: Column, reason: Column) -> Column:
    """all nine hold; a null holds nothing."""
    true = lambda c: c.eqNullSafe(F.lit(True))
    return status.eqNullSafe("done") & true(done) & true(ended) & true(over) & version.eqNullSafe(REWARD_VERSION) & kind.eqNullSafe("gold_purchase") & true(valid) & true(success) & reason.eqNullSafe("gold_purchase")


def coded(**codes: Column) -> Column:
    """Sorted codes of the conditions that hold; a null doesn't."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, code) for code, c in codes.items()])))


def acceptance_reasons(strict: Column, contract: Column, wanted_contract: str, error: Column, release_error: Column, released: Column, events: Column, tools: list[str]) -> Column:
    """why a trajectory can't be taught from, sorted; none if it can.  events: array<struct<type,tool_name,done,n_calls,dropped,
    arguments_error,reason>>."""
    has = lambda test: F.exists(events, test)
    said = lambda e: e["type"] == "assistant"
    return coded(
        not_strict_gold=~strict,
        runtime_contract_mismatch=~contract.eqNullSafe(F.lit(wanted_contract)),
        has_error=error.isNotNull(),
        release_error=release_error.isNotNull(),
        lease_not_released=~released.eqNullSafe(F.lit(True)),
        missing_executed_terminal_buy=~F.coalesce(has(lambda e: (e["type"] == "environment_step") & (e["tool_name"] == "buy_now") & e["done"].eqNullSafe(F.lit(True))), F.lit(False)),
        parallel_tool_calls_dropped=has(lambda e: said(e) & e["dropped"]),
        multiple_tool_calls=has(lambda e: said(e) & (e["n_calls"] > 1)),
        unknown_tool=has(lambda e: said(e) & (e["n_calls"] > 0) & ~F.coalesce(e["tool_name"].isin(*tools), F.lit(False))),
        malformed_tool_arguments=has(lambda e: said(e) & (e["arguments_error"] == "malformed_tool_arguments")),
        tool_arguments_not_object=has(lambda e: said(e) & (e["arguments_error"] == "tool_arguments_not_object")),
        damaged_tool_structure=has(lambda e: (e["type"] == "guard_rejection") & (e["reason"].startswith("malformed_tool_call") | e["reason"].startswith("schema_"))),
    )


def indexed_reasons(base: list[tuple[str, Column]], messages: Column, tests: dict[str, object]) -> Column:
    """codes in their order, then code:index for every element of messages that a test (a function of it) finds."""
    plain = F.array_compact(F.array(*[F.when(c, code) for code, c in base]))

    def found(name: str, test) -> Column:
        return F.array_compact(F.transform(messages, lambda m, i: F.when(test(m), F.concat(F.lit(f"{name}:"), i.cast("string")))))

    return F.concat(plain, *[found(name, test) for name, test in tests.items()])


def action_refusal(tool: Column, argument: Column, page: Column, products: Column, buttons: Column) -> Column:
    """why an action can't be taken on the page last seen, null if it can; the first reason counts."""
    there = lambda held, what: F.coalesce(F.array_contains(held, what), F.lit(False))
    fixed = {"buy_now": "buy now", "next_page": "next >", "previous_page": "< prev", "back_to_search": "back to search"}
    out = F.when((tool == "search_products") & (F.trim(F.coalesce(argument, F.lit(""))) == ""), "empty_query")
    out = out.when((tool == "open_product") & ~there(products, argument), "product_not_visible")
    for name, button in fixed.items():
        out = out.when((tool == name) & ~there(F.transform(buttons, F.lower), F.lit(button)), f"{name}_not_available")
    return out.when(tool.isin("select_option", "open_subpage") & ~there(F.transform(buttons, F.lower), F.lower(argument)), "target_not_available").when((tool == "buy_now") & (page != "product_detail"), "not_a_product_page")


def record_problems(row: dict[str, Column], required: list[str], statuses: list[str], content: Column, content_hash: Column) -> Column:
    """sorted codes: missing_<field>, a status that isn't known, an error that a done row has or a failed one hasn't, and a hash
    that isn't that of the content.  Rows with any go to quarantine."""
    return coded(
        **{f"missing_{f}": row[f].isNull() for f in required},
        unknown_status=~F.coalesce(row["status"].isin(*statuses), F.lit(False)),
        done_with_error=(row["status"] == "done") & row["error"].isNotNull(),
        failure_without_error=(row["status"] == "infrastructure_failure") & row["error"].isNull(),
        hash_mismatch=~F.sha2(content, 256).eqNullSafe(content_hash),
    )


def infrastructure_invalid(flag: Column, error_type: Column, release_error: Column, extra: tuple[str, ...] = ()) -> Column:
    """the flag, any release error, or an error of a kind that the infrastructure makes."""
    kinds = [*INFRASTRUCTURE_ERRORS, *extra]
    return F.coalesce(flag, F.lit(False)) | release_error.isNotNull() | F.coalesce(error_type.isin(*kinds), F.lit(False))


def contract_issues(status: Column, done: Column, ended: Column, over: Column, detail: Column, version: Column, warnings: Column) -> Column:
    """codes, in their order, of what a trajectory's own statements don't agree on."""
    finished = status == "done"
    not_true = lambda c: ~c.eqNullSafe(F.lit(True))
    return F.array_compact(F.array(
        F.when(finished & not_true(done), "done_status_without_trajectory_done"),
        F.when(finished & not_true(ended), "done_status_without_terminal_done"),
        F.when(finished & not_true(over), "done_status_without_terminal_over"),
        F.when(finished & detail.isNull(), "done_status_without_reward_detail"),
        F.when(detail.isNotNull() & version.isNotNull() & (version != REWARD_VERSION), "unexpected_reward_version"),
        F.when(F.size(warnings) > 0, "normalization_warnings"),
    ))


def forbidden_fields(kind: DataType, names: set[str], suffixes: tuple[str, ...] = (), path: str = "") -> list[str]:
    """The paths in a schema whose last name, in any case, is forbidden or has a forbidden suffix."""
    if isinstance(kind, ArrayType):
        return forbidden_fields(kind.elementType, names, suffixes, f"{path}[]")
    if isinstance(kind, MapType):
        return forbidden_fields(kind.valueType, names, suffixes, f"{path}{{}}")
    if not isinstance(kind, StructType):
        return []
    out = []
    for f in kind.fields:
        here = f"{path}.{f.name}" if path else f.name
        low = f.name.lower()
        out += [here] * (low in names or low.endswith(suffixes) if suffixes else low in names)
        out += forbidden_fields(f.dataType, names, suffixes, here)
    return out


def forbidden_keys(text: Column, names: set[str]) -> Column:
    """F8: the forbidden keys, sorted, that a JSON text has at any depth; every key is a string before a colon, outside of values."""
    keys = F.regexp_extract_all(text, F.lit(r'(?:[{,]\s*)"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    return F.array_sort(F.array_distinct(F.array_intersect(F.transform(keys, F.lower), F.array(*[F.lit(n) for n in sorted(names)]))))


def ids_only(text: Column) -> Column:
    """whether a JSON object has no keys but task_id, and extra_info with no key but task_id."""
    top, inner = F.json_object_keys(text), F.json_object_keys(F.get_json_object(text, "$.extra_info"))
    extra = lambda keys, ok: F.size(F.array_except(keys, F.array(*[F.lit(k) for k in ok]))) > 0
    return F.coalesce(~extra(top, ["task_id", "extra_info"]) & ~F.coalesce(extra(inner, ["task_id"]), F.lit(False)), F.lit(False))


def chat_problems(messages: DataFrame, chat: str, pos: str, role: str) -> DataFrame:
    """chat and problem: it starts with neither system nor user, a system turn comes later, a role follows itself, or it ends with
    the user's turn.  messages: a row a turn."""
    w = Window.partitionBy(chat).orderBy(pos)
    marked = messages.select(chat, F.col(role).alias("role"), F.lag(role).over(w).alias("before"), F.lead(role).over(w).alias("after"))
    seen = marked.groupBy(chat).agg(
        F.max(F.col("before").isNull() & ~F.col("role").isin("system", "user")).alias("bad_start"), F.max(F.col("before").isNotNull() & (F.col("role") == "system")).alias("late_system"),
        F.max(F.col("before") == F.col("role")).alias("again"), F.max(F.col("after").isNull() & (F.col("role") == "user")).alias("open_end"),
    )
    return seen.select(chat, F.explode(coded(bad_start=F.col("bad_start"), late_system=F.col("late_system"), repeated_role=F.col("again"), ends_with_user=F.col("open_end"))).alias("problem"))


def has_marker(text: Column, markers: list[str]) -> Column:
    """whether the text holds any of the markers."""
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return F.coalesce(out, F.lit(False))


def length_gate(df: DataFrame, tokens: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """rows of at most so many tokens, and the others with their tokens and a reason."""
    counted = df.withColumn("token_length", tokens)
    return counted.where(F.col("token_length") <= most), counted.where(F.col("token_length") > most).withColumn("reason", F.lit("too_long"))


def reachability(instructions: Column, required: Column, offered: Column) -> Column:
    """F16: reason codes that a task can't be done for: not one instruction, or an option that the product doesn't offer; both lists are
    option texts."""
    return F.array_compact(F.array(F.when(instructions != 1, "instruction_cardinality"), F.when(F.size(F.array_except(required, offered)) > 0, "required_option_not_exposed")))


def span_problems(spans: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """key, rubric and problem: a rubric id twice, a hardness that isn't hard or soft, or a span (start, end, text) that isn't the
    text's own.  spans: key, rubric, hardness, start, end, span; texts: key, text."""
    joined = spans.join(texts.select(key, "text"), key, "left")
    joined = joined.withColumn("__n", F.count("*").over(Window.partitionBy(key, "rubric")))
    own = F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start"))
    found = coded(duplicate_id=F.col("__n") > 1, hardness=~F.coalesce(F.col("hardness").isin("hard", "soft"), F.lit(False)), span_text=~own.eqNullSafe(F.col("span")))
    return joined.select(key, "rubric", F.explode(found).alias("problem"))


def label_problems(labels: DataFrame, rows: DataFrame, key: str, enums: dict[str, list[str]], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Key and problem: a value outside its list or range, a label without a row, a row without a label."""
    seen = rows.select(key).distinct().withColumn("__row", F.lit(True))
    joined = labels.withColumn("__label", F.lit(True)).join(seen, key, "full")
    has = F.col("__label").isNotNull()
    bad = {f"{c}_not_listed": has & ~F.coalesce(F.col(c).isin(*v), F.lit(False)) for c, v in enums.items()} | {f"{c}_out_of_range": has & ~F.coalesce(F.col(c).between(*v), F.lit(False)) for c, v in ranges.items()}
    return joined.select(key, F.explode(coded(**bad, no_row=F.col("__row").isNull(), no_label=~has)).alias("problem"))


def changed_fields(old: dict, new: dict) -> list[str]:
    """the sorted keys at which two contracts differ."""
    return sorted(k for k in old.keys() | new.keys() if (k in old) != (k in new) or old.get(k) != new.get(k))


def page_problems(raw: Column, shown: Column, clickable: Column, buttons: Column, navigation: list[str], size: Column, most: int) -> Column:
    """codes of what a shortened search page lost: an id, a way to open it, a button, or its budget."""
    differ = lambda a, b: (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)
    return coded(ids_differ=differ(raw, shown), not_actionable=differ(shown, clickable), navigation_lost=F.size(F.array_except(F.array(*[F.lit(b) for b in navigation]), buttons)) > 0, over_budget=size > most)


def reachability_problems(classified: DataFrame, splits: DataFrame, task: str) -> DataFrame:
    """task and problem: classified twice, in no split, or in a split but not classified."""
    n = classified.groupBy(task).agg(F.count("*").alias("n"))
    both = n.join(splits.select(task).distinct().withColumn("__split", F.lit(True)), task, "full")
    return both.select(task, F.explode(coded(classified_twice=F.col("n") > 1, not_in_a_split=F.col("__split").isNull(), not_classified=F.col("n").isNull())).alias("problem"))
