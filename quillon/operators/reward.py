"""Comparison of products with demands, prices of variants, and the outcome of a purchase.

Statuses are pass, fail and unverifiable.  Row-wise rules are column expressions; those over a product's options work on tables
of one row an option, so that a product's size is no row's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.prices import price_candidates
from quillon.functions.text import UNITS, brands, clean_list, exact_spans, folded_list, in_base_unit, option_axis, option_text, plain_text, shared_models

PASS, FAIL, UNVERIFIABLE = "pass", "fail", "unverifiable"
# Fixed values.
NEGATIONS = ("不支持", "不含", "不具备", "没有", "无", "非", "不")
WEIGHTS = {"brand": 0.35, "model": 0.25, "core_functions": 0.25, "key_options": 0.15}
REWARDS = {
    "gold_purchase": 1.0,
    "valid_alternative_purchase": 0.55,
    "partial_purchase_base": -0.30,
    "partial_purchase_scale": 0.55,
    "partial_purchase_cap": 0.25,
    "graceful_stop": -0.15,
    "early_abstain": -0.35,
    "max_steps": -0.50,
    "repeat_loop": -0.65,
    "wrong_purchase": -0.85,
    "reward_unverifiable": 0.0,
}
MATCH, COVERAGE = 0.70, 0.75
REWARD_VERSION = "shopsimulator-reward-v3"
REWARD_TYPES = ("gold_purchase", "valid_alternative_purchase", "partial_alternative_purchase", "wrong_purchase", "graceful_stop", "early_abstain", "max_steps", "repeat_loop", "reward_unverifiable")


def _status(unknown: Column, passed: Column) -> Column:
    return F.when(F.coalesce(unknown, F.lit(True)), UNVERIFIABLE).when(passed, PASS).otherwise(FAIL)


def category_gate(required: Column, actual: Column) -> Column:
    """Equal leaves, and common ancestors unless a side has none.  Chains are written with › between."""
    chain = lambda c: F.filter(F.split(plain_text(c, True), "›"), lambda p: p != "")
    a, b = chain(required), chain(actual)
    above = lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))
    related = (F.size(a) < 2) | (F.size(b) < 2) | F.arrays_overlap(above(a), above(b))
    return _status((F.size(a) < 1) | (F.size(b) < 1), (F.try_element_at(a, F.lit(-1)) == F.try_element_at(b, F.lit(-1))) & related)


def brand_gate(expected: Column, brand: Column, shop: Column, aliases: dict[str, str]) -> Column:
    """R2: the brand, or any alias of the same canonical name, stands in brand and shop."""
    text, wanted = plain_text(F.concat_ws(" ", brand, shop), True), plain_text(expected, True)
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.create_map().cast("map<string,string>")
    canonical = F.coalesce(F.element_at(names, wanted), wanted)
    hits = [(canonical == c) & F.contains(text, F.lit(a)) for a, c in aliases.items() if len(a) >= 2]
    return F.when(reduce(Column.__or__, hits, F.contains(text, wanted)), PASS).otherwise(FAIL)


def exact_brand(expected: Column, brand: Column, shop: Column, aliases: dict[str, str]) -> Column:
    """The canonical brand, or the shop's where there is none, is the expected one."""
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.create_map().cast("map<string,string>")
    canonical = lambda c: F.coalesce(F.element_at(names, plain_text(c, True)), plain_text(c, True))
    actual = F.coalesce(F.when(brand != "", brand), F.when(shop != "", shop))
    return _status(actual.isNull() | (plain_text(expected, True) == ""), canonical(expected) == canonical(actual))


def model_gate(expected: Column, actual: Column) -> Column:
    """A Latin model stands in the text with no letter or digit on either side; another is the whole text."""
    wanted, text = plain_text(expected), plain_text(actual)
    inside = F.rlike(text, F.concat(F.lit("(?<![a-z0-9])\\Q"), wanted, F.lit("\\E(?![a-z0-9])")))
    return _status((wanted == "") | (text == ""), F.when(wanted.rlike("^[a-z0-9._+-]+$"), inside).otherwise(wanted == text))


def function_gate(expected: Column, attributes: Column, text: Column) -> Column:
    """An attribute holds the function without a negation right before it: pass; only with one: fail; none holds it: the same of
    the text.  attributes: an array.  Unverifiable without a function, or with neither attributes nor text."""
    wanted = plain_text(expected, True)
    held = F.transform(folded_list(F.coalesce(attributes, F.array().cast("array<string>"))), lambda a: F.regexp_replace(F.coalesce(a, F.lit("")), r"(?U)\s+", ""))
    rest = plain_text(text, True)
    plain = F.concat(F.lit("(?<!" + "|".join(NEGATIONS) + ")\\Q"), wanted, F.lit("\\E"))
    # What is compared goes in as an array, as no Python function can stand inside a lambda.
    each = F.zip_with(held, F.array_repeat(F.struct(wanted.alias("w"), plain.alias("p")), F.size(held)), lambda a, x: F.struct(F.contains(a, x["w"]).alias("in"), F.rlike(a, x["p"]).alias("plain")))
    listed, affirmed = F.exists(each, lambda x: x["in"]), F.exists(each, lambda x: x["plain"])
    return _status((wanted == "") | ((F.size(held) < 1) & (rest == "")), F.when(listed, affirmed).otherwise(F.rlike(rest, plain)))


def numeric_gate(value: Column, unit: Column, operator: Column, text: Column, tolerance: Column | None = None, upper: Column | None = None) -> Column:
    """A number of the text, in the same dimension, equals value, is at least (min), at most (max) or between value and upper (range)."""
    slack = F.lit(0.0) if tolerance is None else tolerance
    names = "ml|毫升|l|升|kg|千克|公斤|g|克|mm|毫米|cm|厘米|m|米"
    pattern = rf"(\d+(?:\.\d+)?)\s*({names})"
    plain = plain_text(text)
    numbers, units = F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), F.regexp_extract_all(plain, F.lit(pattern), F.lit(2))
    kinds = F.create_map(*[F.lit(x) for u, (kind, _) in UNITS.items() for x in (u, kind)])
    factors = F.create_map(*[F.lit(x) for u, (_, factor) in UNITS.items() for x in (u, factor)])
    target = in_base_unit(value, unit)
    high = in_base_unit(upper, unit)["value"] if upper is not None else F.lit(None).cast("double")
    found = F.zip_with(numbers, units, lambda n, u: F.struct(F.element_at(kinds, u).alias("kind"), (n.cast("double") * F.element_at(factors, u)).alias("x")))
    asked = F.struct(target["dimension"].alias("kind"), target["value"].alias("t"), high.alias("high"))

    def test(f: Column, a: Column) -> Column:
        x, t = f["x"], a["t"]
        passes = F.when(operator == "eq", F.abs(x - t) <= slack).when(operator == "min", x + slack >= t).when(operator == "max", x - slack <= t).when(operator == "range", (x >= t - slack) & (x <= a["high"] + slack))
        return F.when(f["kind"] == a["kind"], F.coalesce(passes, F.lit(False)))

    tested = F.array_compact(F.zip_with(found, F.array_repeat(asked, F.size(found)), test))
    known = operator.isin("eq", "min", "max", "range")
    return _status(target.isNull() | (F.size(tested) < 1) | ~known, F.exists(tested, lambda x: x))


def price_gate(limit: Column, status: Column, price: Column) -> Column:
    """Without a budget pass; without a settled, finite price, or with a budget not above 0, unverifiable; else price <= budget."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    unknown = ~status.eqNullSafe(F.lit(PASS)) | ~finite(price) | ~finite(limit) | (price < 0) | (limit <= 0)
    return F.when(limit.isNull(), PASS).otherwise(_status(unknown, price <= limit))


# --- a product's options, one row each: product, axis, value, price ------------------------------------------------------


def option_index(options: DataFrame) -> DataFrame:
    """Product, axis (canonical), value (as an option text), raw_axis, raw_value, price of the axes that one name alone stands
    for, and collides: the names of others, kept with the mark.  Of equal values the last by raw_value counts; prices that aren't finite
    or are below 0 are none."""
    price = F.when((F.col("price") >= 0) & (F.col("price") < float("inf")) & ~F.isnan(F.col("price").cast("double")), F.col("price").cast("double"))
    own = options.select("product", option_axis(F.col("axis")).alias("axis"), F.col("axis").alias("raw_axis"), option_text(F.col("value")).alias("value"), F.col("value").alias("raw_value"), price.alias("price"))
    own = own.where("value <> ''").groupBy("product", "axis", "raw_axis", "value").agg(F.max_by(F.struct("raw_value", "price"), "raw_value").alias("r")).select("product", "axis", "raw_axis", "value", "r.*")
    several = own.groupBy("product", "axis").agg((F.count_distinct(F.col("raw_axis")) > 1).alias("collides"))
    return own.join(several, ["product", "axis"])


def resolved_options(required: DataFrame, index: DataFrame) -> DataFrame:
    """Case, value, axis and reason: the one axis that offers a required value, or axis_not_found, axis_ambiguous, or
    canonical_axis_collision for all but the first value (by pos) of an axis.  required: case, product, pos, value."""
    own = required.withColumn("wanted", option_text(F.col("value")))
    offers = index.select("product", "axis", "raw_axis", F.col("value").alias("wanted")).distinct()
    matched = own.join(offers, ["product", "wanted"], "left").groupBy("case", "pos", "value").agg(F.count("raw_axis").alias("n"), F.min("axis").alias("axis"))
    first = matched.where("n = 1").groupBy("case", "axis").agg(F.min("pos").alias("first"))
    marked = matched.join(first, ["case", "axis"], "left")
    reason = F.when(F.col("n") == 0, "axis_not_found").when(F.col("n") > 1, "axis_ambiguous").when(F.col("pos") > F.col("first"), "canonical_axis_collision")
    return marked.select("case", "pos", "value", F.when(F.col("n") == 1, F.col("axis")).alias("axis"), reason.alias("reason"))


def compared_options(cases: DataFrame, required: DataFrame, index: DataFrame, selected: DataFrame) -> DataFrame:
    """Case and status: unverifiable if the product's or the selection's axes collide or a required axis is missing, fail if a
    required value isn't offered or another one is selected, else pass.  cases: case, product; required and selected: case, axis, value
    (required ones with canonical axes)."""
    chosen = selected.select("case", option_axis(F.col("axis")).alias("axis"), option_text(F.col("value")).alias("chosen"), F.col("axis").alias("raw"))
    twice = chosen.groupBy("case", "axis").agg(F.count("*").alias("n"), F.first("chosen").alias("chosen"))
    wanted = required.select("case", "axis", option_text(F.col("value")).alias("wanted")).join(cases, "case")
    axes = index.groupBy("product", "axis").agg(F.max("collides").alias("collides"))
    offered = index.select("product", "axis", F.col("value").alias("wanted"), F.lit(True).alias("offered")).distinct()
    each = wanted.join(axes.where("not collides"), ["product", "axis"], "left").join(offered, ["product", "axis", "wanted"], "left").join(twice.select("case", "axis", "chosen"), ["case", "axis"], "left")
    missing, wrong = F.col("collides").isNull(), F.col("offered").isNull() | ~F.col("chosen").eqNullSafe(F.col("wanted"))
    by_case = each.groupBy("case").agg(F.max(missing).alias("missing"), F.max(~missing & wrong).alias("wrong"))
    bad_axes = axes.groupBy("product").agg(F.max("collides").alias("bad_product"))
    bad_choice = twice.groupBy("case").agg((F.max("n") > 1).alias("bad_choice"))
    out = cases.join(bad_axes, "product", "left").join(bad_choice, "case", "left").join(by_case, "case", "left")
    flag = lambda n: F.coalesce(n, F.lit(False))
    unknown = flag(F.col("bad_product")) | flag(F.col("bad_choice")) | flag(F.col("missing"))
    return out.select("case", F.when(unknown, UNVERIFIABLE).when(flag(F.col("wrong")), FAIL).otherwise(PASS).alias("status"))


def filled_options(cases: DataFrame, required: DataFrame, index: DataFrame) -> DataFrame:
    """Case, axis and value: the required values, and for every other axis the one with the lowest listed price, values
    without a price last, then in order of the text."""
    cheapest = index.where("not collides").groupBy("product", "axis").agg(F.min_by("value", F.struct(F.col("price").isNull(), "price", "value")).alias("value"))
    wanted = required.select("case", "axis", option_text(F.col("value")).alias("value"))
    rest = cases.join(cheapest, "product").select("case", "axis", "value").join(wanted.select("case", "axis"), ["case", "axis"], "left_anti")
    return wanted.unionByName(rest)


def variant_prices(cases: DataFrame, index: DataFrame, selected: DataFrame, combinations: DataFrame, base: DataFrame) -> DataFrame:
    """Case, status, price and method: colliding axes, the price of the full combination, then by the axes whose values differ
    in price: several, one (unselected, without a price, or its price), none (the one price of all options, the one base price, or not
    settled).  combinations: product, combination, axis, value, price; base: product, price."""
    chosen = selected.select("case", option_axis(F.col("axis")).alias("axis"), option_text(F.col("value")).alias("value")).distinct()
    picked = selected.select("case", option_axis(F.col("axis")).alias("axis")).groupBy("case", "axis").agg(F.count("*").alias("n"))
    bad_choice = picked.groupBy("case").agg((F.max("n") > 1).alias("bad_choice"))
    as_set = F.array_sort(F.collect_set(F.struct("axis", "value")))  # the axes of one product
    held = cases.join(chosen.groupBy("case").agg(as_set.alias("set")), "case")
    whole = combinations.select("product", "combination", "price", option_axis(F.col("axis")).alias("axis"), option_text(F.col("value")).alias("value")).groupBy("product", "combination").agg(as_set.alias("set"), F.max("price").alias("price"))
    full = held.join(whole.groupBy("product", "set").agg(F.min_by("price", "combination").alias("full_price")), ["product", "set"]).select("case", "full_price")

    axes = index.groupBy("product", "axis").agg(F.max("collides").alias("collides"), F.count_distinct(F.col("price")).alias("prices"))
    shape = axes.groupBy("product").agg(F.max("collides").alias("bad_product"), F.count_if(F.col("prices") > 1).alias("effective"), F.min(F.when(F.col("prices") > 1, F.col("axis"))).alias("price_axis"))
    every = index.groupBy("product").agg(F.count_distinct(F.col("price")).alias("all_prices"), F.min("price").alias("one_price"))
    bases = base.where("price >= 0").groupBy("product").agg(F.count_distinct(F.col("price")).alias("base_prices"), F.min("price").alias("base_price"))
    out = cases.join(shape, "product", "left").join(every, "product", "left").join(bases, "product", "left").join(bad_choice, "case", "left").join(full, "case", "left")
    out = out.join(chosen.select("case", F.col("axis").alias("price_axis"), F.col("value").alias("chosen")), ["case", "price_axis"], "left")
    out = out.join(index.select("product", F.col("axis").alias("price_axis"), F.col("value").alias("chosen"), F.col("price").alias("chosen_price")), ["product", "price_axis", "chosen"], "left")
    c = F.col
    zero = lambda n: F.coalesce(c(n), F.lit(0))
    no = lambda n: F.coalesce(c(n), F.lit(False))
    method = (
        F.when(no("bad_product") | no("bad_choice"), "invalid_option_axes")
        .when(c("full_price").isNotNull(), "full_variant_combination")
        .when(zero("effective") > 1, "multiple_effective_price_axes")
        .when((zero("effective") == 1) & c("chosen").isNull(), "effective_price_axis_unselected")
        .when((zero("effective") == 1) & c("chosen_price").isNull(), "selected_variant_price_missing")
        .when(zero("effective") == 1, "unique_effective_price_axis")
        .when(zero("all_prices") == 1, "constant_option_price")
        .when(c("effective").isNull() & (zero("base_prices") == 1), "single_base_price")
        .otherwise("price_not_deterministic")
    )
    out = out.withColumn("method", method)
    price = F.expr("case method when 'full_variant_combination' then full_price when 'unique_effective_price_axis' then chosen_price when 'constant_option_price' then one_price when 'single_base_price' then base_price end")
    return out.select("case", F.when(price.isNotNull(), PASS).otherwise(UNVERIFIABLE).alias("status"), price.alias("price"), "method")


# --- scores and outcomes -------------------------------------------------------------------------------------------------


def preferences(dimensions: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """struct<match_score,coverage,all_satisfied> of arrays of statuses by dimension: the shares that pass and that are verifiable,
    weighted over the dimensions that ask for anything; 1 and 1 if none does."""
    size = {n: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for n, c in dimensions.items()}
    share = lambda n, ok: F.coalesce(F.size(F.filter(dimensions[n], ok)) / F.when(size[n] > 0, size[n]), F.lit(0.0))
    active = sum(F.when(size[n] > 0, weights[n]).otherwise(0.0) for n in dimensions)
    total = lambda ok: F.when(active > 0, sum(F.when(size[n] > 0, share(n, ok) * weights[n]).otherwise(0.0) for n in dimensions) / active).otherwise(1.0)
    match, coverage = total(lambda s: s == PASS), total(lambda s: s != UNVERIFIABLE)
    whole = lambda x: F.abs(x - 1) <= 1e-8
    return F.struct(match.alias("match_score"), coverage.alias("coverage"), (whole(match) & whole(coverage)).alias("all_satisfied"))


def purchase(gates: list[Column], prefer: Column, same_product: Column, rewards: dict[str, float] = REWARDS) -> Column:
    """struct<reward_type,reward,reward_valid> of a purchase."""
    any_ = lambda s: reduce(Column.__or__, [g == s for g in gates])
    partial = F.least(F.lit(rewards["partial_purchase_cap"]), rewards["partial_purchase_base"] + rewards["partial_purchase_scale"] * prefer["match_score"])
    kind = F.when(any_(UNVERIFIABLE), "reward_unverifiable").when(any_(FAIL), "wrong_purchase").when(~prefer["all_satisfied"], "partial_alternative_purchase").when(same_product, "gold_purchase").otherwise("valid_alternative_purchase")
    fixed = F.create_map(*[F.lit(x) for n in ("reward_unverifiable", "wrong_purchase", "gold_purchase", "valid_alternative_purchase") for x in (n, float(rewards[n]))])
    return F.struct(kind.alias("reward_type"), F.when(kind == "partial_alternative_purchase", partial).otherwise(F.element_at(fixed, kind)).alias("reward"), (kind != "reward_unverifiable").alias("reward_valid"))


def eligible(gates: list[Column], prefer: Column) -> Column:
    """Whether an opened candidate is good enough to make giving up too early."""
    return reduce(Column.__and__, [g == PASS for g in gates]) & (prefer["match_score"] >= MATCH) & (prefer["coverage"] >= COVERAGE)


def abstention(result_sets: Column, opened: Column, acceptable: Column) -> Column:
    """graceful_stop after two result sets and two opened products with none acceptable, else early_abstain."""
    return F.when((result_sets >= 2) & (opened >= 2) & (F.coalesce(acceptable, F.lit(0)) == 0), "graceful_stop").otherwise("early_abstain")


def fixed_reward(reason: Column) -> Column:
    """The reward of an ending by itself; another reason is an error."""
    table = F.create_map(*[F.lit(x) for n in ("repeat_loop", "max_steps", "graceful_stop", "early_abstain") for x in (n, REWARDS[n])])
    return F.coalesce(F.element_at(table, reason), F.raise_error(F.concat(F.lit("no fixed reward: "), reason)).cast("double"))


def reward_problems(version: Column, kind: Column, reason: Column, valid: Column, utility: Column, invalid_sample: Column, score: Column) -> Column:
    """what is wrong with the detail of a reward, as sorted codes; none if it holds together."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.array_sort(F.array_compact(F.array(
        F.when(~version.eqNullSafe(F.lit(REWARD_VERSION)), "version"),
        F.when(~F.coalesce(kind.isin(*REWARD_TYPES), F.lit(False)), "unknown_type"),
        F.when(~reason.eqNullSafe(kind), "termination_reason"),
        F.when(valid.isNull() | ~((kind == "reward_unverifiable") == ~valid), "reward_valid"),
        F.when(~finite(utility), "utility"),
        F.when(invalid_sample.isNull() | (invalid_sample != ~valid), "sampling_invalid"),
        F.when(~finite(score) | (score < 0) | (score > 1), "weighted_score"),
    )))


def length_penalty(steps: Column, free: int = 20, each: float = 0.01, most: float = 0.15) -> Column:
    """A hundredth for each step beyond twenty, 0.15 at most."""
    return F.least(F.greatest(steps - free, F.lit(0)) * each, F.lit(most))


def disagreements(assessments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Case and reasons, sorted, where a purchase's reward and its rubric disagree.  assessments: case, rubric, hardness, status
    of valid judgements; outcomes: case, reward_type, success."""
    hard, applies = F.col("hardness") == "hard", F.col("status") != "not_applicable"
    seen = assessments.groupBy("case").agg(
        F.count_if(F.col("status") == "violated").alias("violated"), F.count_if((F.col("status") == "violated") & hard).alias("violated_hard"),
        F.count_if(applies).alias("n"), F.count_if(applies & (F.col("status") != "satisfied")).alias("unsatisfied"),
        F.count_if(applies & hard).alias("n_hard"), F.count_if(applies & hard & (F.col("status") != "satisfied")).alias("unsatisfied_hard"),
    )
    c = F.col
    reasons = F.array_compact(F.array(
        F.when((c("reward_type") == "partial_alternative_purchase") & (c("n") > 0) & (c("unsatisfied") == 0), "partial_reward_with_all_rubrics_satisfied"),
        F.when(c("success") & (c("violated_hard") > 0), "reward_success_with_hard_rubric_violation"),
        F.when(c("success") & (c("violated") > 0), "reward_success_with_rubric_violation"),
        F.when((c("reward_type") == "wrong_purchase") & (c("n_hard") > 0) & (c("unsatisfied_hard") == 0), "wrong_purchase_with_all_hard_rubrics_satisfied"),
    ))
    return outcomes.join(seen, "case").select("case", reasons.alias("reasons")).where(F.size("reasons") > 0)


def constraint_contract(instruction: Column, attributes: Column, options: Column) -> Column:
    """whether a task's demands are complete: it says something and has both lists."""
    return (F.regexp_replace(F.coalesce(instruction, F.lit("")), r"(?U)\s+", "") != "") & attributes.isNotNull() & options.isNotNull()


def features(instruction: Column, attributes: Column, title: Column, shop: Column, description: Column, aliases: dict[str, str]) -> Column:
    """struct<expected_brand,expected_model,expected_core_functions> of a task; its options come from resolved_options."""
    target = F.concat_ws(" ", F.when(title != "", title), F.when(description != "", description))
    return F.struct(brands(instruction, title, shop, aliases).alias("expected_brand"), shared_models(instruction, target).alias("expected_model"), clean_list(F.coalesce(attributes, F.array().cast("array<string>"))).alias("expected_core_functions"))


def rubric_candidates(tasks: DataFrame, query: str, category: str, lists: dict[str, str], options: str) -> DataFrame:
    """Task, candidate_id (c0001 on), kind, field, operator, value, hardness and spans (places in the query) of a task's possible demands:
    its category's leaf, every value of the lists by kind, every option (map of axis to value), and the prices it states; of equal ones the
    first counts."""
    # Field and operator by kind.
    fields = {"brand": ("product.brand", "eq"), "model": ("product.model", "eq"), "core_function": ("product.attributes", "contains")}
    one = lambda kind, field, op, value, said, hard="hard": F.struct(F.lit(kind).alias("kind"), field.alias("field"), op.alias("operator"), value.alias("value"), said.alias("said"), F.lit(hard).alias("hardness"))

    def named(kind: str):
        field, op = fields[kind]
        return lambda v: one(kind, F.lit(field), F.lit(op), v, v)

    leaf = F.trim(F.element_at(F.split(F.col(category), "›"), -1))
    parts = [F.when(F.col(category) != "", F.array(one("category", F.lit("product.category"), F.lit("in_category"), F.col(category), leaf)))]
    parts += [F.transform(clean_list(F.col(c)), named(kind)) for kind, c in lists.items()]
    parts.append(F.transform(F.array_sort(F.map_entries(options)), lambda e: one("option", F.concat(F.lit("purchase.options."), e["key"]), F.lit("eq"), e["value"], e["value"])))
    empty = F.array().cast("array<struct<kind:string,field:string,operator:string,value:string,said:string,hardness:string>>")
    priced = F.transform(
        price_candidates(F.col(query)),
        lambda p: F.struct(
            p["kind"].alias("kind"), F.lit("purchase.price").alias("field"), F.when(p["kind"] == "budget_upper", "lte").when(p["kind"] == "price_range", "between").when(p["kind"] == "price_lower", "gte").otherwise("approximately").alias("operator"),
            F.when(p["low"] == p["high"], p["low"].cast("string")).otherwise(F.concat_ws("-", p["low"].cast("string"), p["high"].cast("string"))).alias("value"),
            F.substring(F.col(query), p["start"] + 1, p["end"] - p["start"]).alias("said"), F.when(p["kind"] == "price_preference", "soft").otherwise("hard").alias("hardness"),
        ),
    )
    found = tasks.withColumn("__all", F.concat(*[F.coalesce(x, empty) for x in parts], F.coalesce(priced, empty)))
    each = found.select("task", F.col(query).alias("__query"), F.posexplode("__all").alias("pos", "x")).select("task", "__query", "pos", "x.*")
    first = each.groupBy("task", "kind", "field", "operator", "value").agg(F.min("pos").alias("pos"), F.min_by("said", "pos").alias("said"), F.first("hardness").alias("hardness"), F.first("__query").alias("__query"))
    number = F.row_number().over(Window.partitionBy("task").orderBy("pos"))
    return first.select("task", F.format_string("c%04d", number).alias("candidate_id"), "kind", "field", "operator", "value", "hardness", exact_spans(F.col("__query"), F.col("said")).alias("spans"))
