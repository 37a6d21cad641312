"""Normalisers of strings, parsers and signatures."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values, which must be the same wherever tokens, axes and prices are compared.
HAN_RUN = "[㐀-䶿一-鿿]+"
LATIN_OR_NUMBER = "[a-z0-9]+(?:[._+\\-/][a-z0-9]+)*"
SEARCH_MODEL = "(?<![a-z0-9])(?=[a-z0-9._+\\-/]*[a-z])(?=[a-z0-9._+\\-/]*\\d)[a-z0-9]+(?:[._+\\-/][a-z0-9]+)*(?![a-z0-9])"
MODEL_TOKEN = "(?i)(?<![a-z0-9])(?=[a-z0-9._+-]{2,24}(?![a-z0-9]))(?=[a-z0-9._+-]*\\d)[a-z0-9._+-]+"
QUERY_STOPS = "[，,。；;：:！!？?、|]+"
AXIS_ALIASES = {
    "color": ["颜色", "颜色分类"],
    "size": ["尺码", "鞋码"],
    "dimensions": ["尺寸", "大小"],
    "net_content": ["净含量", "总净含量"],
    "flavor": ["口味", "食品口味"],
    "specification": ["规格", "规格描述", "规格类型"],
    "bundle": ["套餐", "套餐类型", "组合套餐"],
    "capacity": ["容量", "规格容量"],
}
UNITS = {
    "ml": ("volume_ml", 1.0),
    "毫升": ("volume_ml", 1.0),
    "l": ("volume_ml", 1000.0),
    "升": ("volume_ml", 1000.0),
    "g": ("mass_g", 1.0),
    "克": ("mass_g", 1.0),
    "kg": ("mass_g", 1000.0),
    "千克": ("mass_g", 1000.0),
    "公斤": ("mass_g", 1000.0),
    "mm": ("length_mm", 1.0),
    "毫米": ("length_mm", 1.0),
    "cm": ("length_mm", 10.0),
    "厘米": ("length_mm", 10.0),
    "m": ("length_mm", 1000.0),
    "米": ("length_mm", 1000.0),
}
BUDGET_SHORTHAND = r"预算(?:控制)?在?\s*(\d+)\s*万\s*(\d+)\s*(?:千)?\s*(以内|以下|内|左右)?"
BUDGET_RANGE = r"(?:预算|价格)(?:控制)?在?\s*(\d+(?:\.\d+)?)\s*(万|千|[kK])?\s*元?\s*(?:-|~|～|至|到)\s*(\d+(?:\.\d+)?)\s*(万|千|[kK])?\s*元?(?:之间|以内|以下|左右)?"
BUDGET_OPEN = r"(?:预算|价格)(?:控制)?在?\s*\d+(?:\.\d+)?\s*[kK]\s*\+"
BUDGET_SINGLE = (
    r"预算(?:控制)?在?\s*(\d+(?:\.\d+)?)\s*(万|千|[kK])?\s*元?(以内|以下|内|左右)?(?!\s*[-~～至到+kK])",
    r"价格(?:控制)?在?\s*(\d+(?:\.\d+)?)\s*(万|千|[kK])?\s*元?(以内|以下|内|左右)?(?!\s*[-~～至到+kK])",
    r"(?:不超过|不高于|最高)\s*(\d+(?:\.\d+)?)\s*(万|千)?\s*元",
    r"(\d+(?:\.\d+)?)\s*(万|千)?\s*元(以内|以下)",
)
EVIDENCE = {
    "attributes": r"(?i)型号|规格|尺寸|尺码|材质|颜色|容量|净含量|版本|款式|套装|套餐|\b[a-z]+[-+._]?\d+",
    "features": "功能|支持|防水|续航|性能|功率|接口|兼容|适合|用于",
    "reviews": "评价|评论|口碑|体验|反馈|耐用|噪音|舒适|好用",
}


@F.arrow_udf(StringType())
def _folded(texts: pa.Array) -> pa.Array:
    if pc.all(pc.string_is_ascii(texts)).as_py() is not False:
        return pc.utf8_lower(texts)
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in texts.to_pylist()], pa.string())


@F.arrow_udf(ArrayType(StringType()))
def _folded_lists(lists: pa.Array) -> pa.Array:
    return pa.array([None if v is None else [None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in v] for v in lists.to_pylist()], pa.list_(pa.string()))


def folded_list(texts: Column) -> Column:
    """folded for every element of an array, as no Python function can be called inside a built-in one's."""
    return _folded_lists(texts)


def folded(text: Column) -> Column:
    """NFKC and then full case folding, which no built-in function has; an Arrow batch at a time, batches of ASCII without Python strings."""
    return _folded(text)


def alnum_text(text: Column) -> Column:
    """Folded, letters and digits only."""
    return F.regexp_replace(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def query_template(text: Column) -> Column:
    """Folded, runs of digits as <num>, nothing but letters, digits and the marks' signs."""
    return F.regexp_replace(F.regexp_replace(folded(text), r"\d+(?:\.\d+)?", "<num>"), r"(?U)[^\w<>]+", "")


def normal_query(text: Column) -> Column:
    """Folded, names of the currency as 元, stops and white space as single spaces."""
    out = F.replace(F.replace(folded(F.coalesce(text, F.lit(""))), F.lit("人民币"), F.lit("元")), F.lit("块钱"), F.lit("元"))
    out = F.regexp_replace(out, r"(?<=\d)\s*(?:rmb|cny|yuan)\b", "元")
    return F.trim(F.regexp_replace(F.regexp_replace(out, QUERY_STOPS, " "), r"(?U)\s+", " "))


def search_tokens(text: Column) -> Column:
    """Of the normal query the bigrams of every Han run (a single character stays), then Latin words and numbers, each once."""
    query = normal_query(text)
    bigrams = F.transform(
        F.regexp_extract_all(query, F.lit(HAN_RUN), F.lit(0)),
        lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))),
    )
    return F.array_distinct(F.concat(F.flatten(bigrams), F.regexp_extract_all(query, F.lit(LATIN_OR_NUMBER), F.lit(0))))


def plain_text(text: Column, remove_space: bool = False) -> Column:
    """Folded, trimmed, runs of white space as one space, or none."""
    return F.trim(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), r"(?U)\s+", "" if remove_space else " "))


def option_text(text: Column) -> Column:
    """Folded, slashes as bars, no white space."""
    return F.regexp_replace(F.translate(folded(F.coalesce(text, F.lit(""))), "/", "|"), r"(?U)\s+", "")


def option_axis(name: Column) -> Column:
    """The axis that a name is an alias of, else the name as an option text."""
    names = F.create_map(*[F.lit(x) for axis, aliases in AXIS_ALIASES.items() for alias in aliases for x in (alias, axis)])
    plain = option_text(name)
    return F.coalesce(F.element_at(names, plain), plain)


def flat_map(values: Column) -> Column:
    """A map of strings to arrays as one list: every key, in order, and then its values."""
    entries = F.array_sort(F.map_entries(values))
    return F.flatten(F.transform(entries, lambda e: F.concat(F.array(e["key"]), e["value"])))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))


def title_models(title: Column) -> Column:
    """The distinct model tokens of a title, in order, as one string."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(normal_query(title), F.lit(SEARCH_MODEL), F.lit(0))), " ")


def shared_models(query: Column, target: Column) -> Column:
    """The model tokens that both texts hold, sorted."""
    tokens = lambda c: F.transform(F.regexp_extract_all(c, F.lit(MODEL_TOKEN), F.lit(0)), F.lower)
    return F.array_sort(F.array_intersect(tokens(query), tokens(target)))


def product_family(category: Column, title: Column) -> Column:
    """sha256 of the category and the title's template."""
    return F.sha2(F.concat_ws("|", alnum_text(category), query_template(title)), 256)


def difficulty(attributes: Column, options: Column, models: Column, budget: Column) -> Column:
    """Easy up to 3 demands, medium up to 6, else hard."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    n = size(attributes) + size(options) + size(models) + budget.isNotNull().cast("int")
    return F.when(n <= 3, "easy").when(n <= 6, "medium").otherwise("hard")


def _scaled(number: Column, unit: Column) -> Column:
    value = F.when(number != "", number.cast("double"))
    return value * F.when(unit == "万", 10000).when(F.lower(unit).isin("千", "k"), 1000).otherwise(1)


def budget(text: Column) -> Column:
    """The upper budget that a text states, null if it is open or unclear: 万 with 千, then ranges (their end), open
    prices (none), then the single forms in their order; 左右 adds a tenth."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit(""))
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    about = lambda mark: F.when(mark == "左右", 1.1).otherwise(1.0)
    short = (part(BUDGET_SHORTHAND, 1).cast("double") * 10000 + part(BUDGET_SHORTHAND, 2).cast("double") * 1000) * about(part(BUDGET_SHORTHAND, 3))
    low, high = _scaled(part(BUDGET_RANGE, 1), part(BUDGET_RANGE, 2)), _scaled(part(BUDGET_RANGE, 3), part(BUDGET_RANGE, 4))
    singles = []
    for k, pattern in enumerate(BUDGET_SINGLE):
        value = _scaled(part(pattern, 1), part(pattern, 2))
        singles.append(value * about(part(pattern, 3)) if k < 2 else value)
    single = F.coalesce(*[F.when(v > 0, v) for v in singles])
    return F.when(t.rlike(BUDGET_SHORTHAND), short).when((low > 0) & (high >= low), high).when(t.rlike(BUDGET_OPEN), F.lit(None)).otherwise(single)


def wan_shorthand(wan: Column, tail: Column, unit: Column) -> Column:
    """1万2 and 1万2千 are 12000: a tail below ten, or one with 千, counts thousands."""
    rest = tail.cast("double")
    return wan.cast("double") * 10000 + F.when(unit.eqNullSafe("千") | (rest < 10), rest * 1000).otherwise(rest)


def exact_spans(text: Column, needle: Column) -> Column:
    """array<struct<start,end>> of the places, without overlap, where text holds needle in any case, in characters."""
    low, small = F.lower(text), F.lower(needle)
    parts = F.split(low, F.concat(F.lit("\\Q"), small, F.lit("\\E")), -1)
    lengths = F.transform(parts, F.length)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.aggregate(F.slice(lengths, 1, k), F.lit(0), lambda a, b: a + b) + (k - 1) * F.length(small))
    spans = F.transform(ends, lambda s: F.struct(s.alias("start"), (s + F.length(small)).alias("end")))
    return F.when((F.size(parts) < 2) | (small == ""), F.array().cast("array<struct<start:int,end:int>>")).otherwise(spans)


def clean_list(values: Column) -> Column:
    """Trimmed values with single spaces, each once, empty ones left out."""
    plain = F.transform(values, lambda v: F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), r"(?U)\s+", " ")))
    return F.array_distinct(F.filter(plain, lambda v: v != ""))


def sorted_json(values: Column) -> Column:
    """A map of strings as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def action_signature(env_action: Column, tool: Column, parameters: Column) -> Column:
    """Env: and the folded action with single spaces if there is one, else tool and parameters (a map) but note as JSON."""
    own = F.concat(F.lit("env:"), plain_text(env_action))
    rest = F.map_filter(F.coalesce(parameters, F.create_map().cast("map<string,string>")), lambda k, _: k != "note")
    payload = F.concat(F.lit('["'), F.lower(F.coalesce(tool, F.lit(""))), F.lit('", '), sorted_json(rest), F.lit("]"))
    return F.when(F.trim(env_action) != "", own).otherwise(payload)


def process_signature(tool: Column, parameters: Column) -> Column:
    """sha256 of parameters and tool as JSON with sorted keys."""
    held = F.coalesce(parameters, F.create_map().cast("map<string,string>"))
    return F.sha2(F.concat(F.lit('{"parameters":'), sorted_json(held), F.lit(',"tool_name":'), F.coalesce(F.concat(F.lit('"'), tool, F.lit('"')), F.lit("null")), F.lit("}")), 256)


def tool_action(tool: Column, argument: Column) -> Column:
    """A tool call as an action of the shop; thinking is none."""
    # The buttons of tools without an argument.
    buttons = {"next_page": "Next >", "previous_page": "< Prev", "back_to_search": "Back to Search", "buy_now": "Buy Now"}
    out = F.when(tool == "search_products", F.concat(F.lit("search["), argument, F.lit("]"))).when(tool == "finish", F.concat(F.lit("finish["), argument, F.lit("]")))
    for name, button in buttons.items():
        out = out.when(tool == name, F.lit(f"click[{button}]"))
    return out.when(tool.isin("open_product", "select_option", "open_subpage", "click"), F.concat(F.lit("click["), argument, F.lit("]")))


def parsed_action(action: Column) -> Column:
    """struct<name,argument> of name[argument]; without that form the whole is the name and the argument is null."""
    pattern = r"(?s)^(.+)\[(.+)\]"
    fits = action.rlike(pattern)
    return F.struct(F.when(fits, F.regexp_extract(action, pattern, 1)).otherwise(action).alias("name"), F.when(fits, F.regexp_extract(action, pattern, 2)).alias("argument"))


def observation(text: Column) -> Column:
    """struct<page_type,subpage,price_visible,n_options,products,buttons> of what a page shows as text."""
    line = lambda name: F.nullif(F.lower(F.trim(F.regexp_extract(text, rf"(?m)^{name}:\s*([^\n]+)", 1))), F.lit(""))
    options = F.from_json(F.regexp_extract(text, r"(?m)^selected_options:\s*(\{.*\})$", 1), "map<string,string>")
    return F.struct(
        line("page_type").alias("page_type"),
        line("subpage").alias("subpage"),
        text.rlike(r"(?mi)^price:\s*(?!none\b|null\b|unknown\b)(\S.+)$").alias("price_visible"),
        F.greatest(F.coalesce(F.size(options), F.lit(0)), F.lit(0)).alias("n_options"),
        F.regexp_extract_all(text, F.lit(r"(?m)^\d+\|([^|\n]+)\|"), F.lit(1)).alias("products"),
        F.regexp_extract_all(text, F.lit(r"\[button\]\s*([^\[\n]+?)\s*\[button_\]"), F.lit(1)).alias("buttons"),
    )


def first_contained(text: Column, bases: list[str], otherwise: str = "not_matched") -> Column:
    """The first of bases that the folded text holds."""
    plain = plain_text(text, remove_space=True)
    return F.coalesce(*[F.when(F.contains(plain, F.lit(b)), b) for b in bases], F.lit(otherwise))


def size_class(text: Column, patterns: dict[str, str]) -> Column:
    """The name of the first pattern that finds something, numeric_size for a number alone, else not_matched."""
    plain = plain_text(text, remove_space=True)
    return F.coalesce(*[F.when(plain.rlike(p), name) for name, p in patterns.items()], F.when(plain.rlike(r"^\d+(\.\d+)?$"), "numeric_size"), F.lit("not_matched"))


def compact(text: Column, most: int) -> Column:
    """At most so many characters: two thirds from the beginning, an ellipsis, the rest from the end."""
    if most <= 0:
        return F.when(text.isNotNull(), "")
    head = max(1, (most - 1) * 2 // 3)
    tail = max(1, most - 1 - head) if most > 2 else 0
    short = "…" if most == 1 else F.concat(F.left(text, F.lit(head)), F.lit("…"), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= most, text).otherwise(short)


def tool_arguments(arguments: Column) -> Column:
    """struct<error,values> of a tool call's JSON: malformed_tool_arguments, tool_arguments_not_object or null."""
    parsed = F.try_parse_json(arguments)
    kind = F.schema_of_variant(parsed)
    error = F.when(arguments.isNull() | parsed.isNull(), "malformed_tool_arguments").when(~kind.startswith("OBJECT"), "tool_arguments_not_object")
    return F.struct(error.alias("error"), F.when(error.isNull(), F.from_json(arguments, "map<string,string>")).alias("values"))


def shortened(text: Column, most: int, marker: str = "\n...[tool page truncated]...\n") -> Column:
    """At most so many characters besides the marker: three quarters from the beginning and one from the end."""
    head = most * 3 // 4
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(marker), F.right(text, F.lit(most - head))))


def in_base_unit(value: Column, unit: Column) -> Column:
    """struct<dimension,value> in the dimension's base unit, null for other units."""
    units = F.create_map(*[x for name, (kind, factor) in UNITS.items() for x in (F.lit(name), F.struct(F.lit(kind).alias("dimension"), F.lit(factor).alias("factor")))])
    held = F.element_at(units, plain_text(unit, remove_space=True))
    return F.when(held.isNotNull(), F.struct(held["dimension"].alias("dimension"), (value.cast("double") * held["factor"]).alias("value")))


def stable_hash(*parts: Column) -> Column:
    """sha256 of the parts with colons between, the key of every repeatable order."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def rendered(fields: dict[str, Column], forbidden: set[str]) -> Column:
    """Name: value lines of the fields that aren't null; a forbidden name is refused when the plan is made."""
    bad = sorted(set(fields) & forbidden)
    if bad:
        raise ValueError(f"not for an observation: {bad}")
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), c.cast("string")) for k, c in fields.items()])


def oracle_actions(title: Column, target: Column, options: Column) -> Column:
    """Search for the title, open the target, choose every option, buy."""
    click = lambda c: F.concat(F.lit("click["), c, F.lit("]"))
    return F.concat(F.array(F.concat(F.lit("search["), title, F.lit("]")), click(target)), F.transform(options, click), F.array(F.lit("click[Buy Now]")))


def brands(instruction: Column, title: Column, shop: Column, aliases: dict[str, str], suffixes: tuple[str, ...] = ("官方旗舰店", "旗舰店", "专卖店", "专营店", "企业店", "店")) -> Column:
    """The brands that the instruction names, sorted: those of which an alias stands in it and in title or shop, and the longest
    beginning (12 to 2 characters) of the shop's name, without its suffix, that stands in it and in the title."""
    said, named = plain_text(instruction, True), plain_text(title, True)
    target = plain_text(F.concat_ws(" ", title, shop), True)
    known = [F.when(F.contains(said, F.lit(a)) & F.contains(target, F.lit(a)), F.lit(c)) for a, c in aliases.items() if len(a) >= 2]
    name = F.regexp_replace(plain_text(shop, True), "(?:" + "|".join(suffixes) + ")$", "")
    # What is compared goes in as an array, as no Python function can stand inside a lambda.
    asked = F.struct(name.alias("name"), said.alias("said"), named.alias("named"))

    def beginning(k: Column, x: Column) -> Column:
        part = F.substring(x["name"], F.lit(1), k)
        return F.when((k <= F.length(x["name"])) & F.contains(x["said"], part) & F.contains(x["named"], part), part)

    starts = F.array_compact(F.zip_with(F.sequence(F.lit(12), F.lit(2), F.lit(-1)), F.array_repeat(asked, F.lit(11)), beginning))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*known, F.get(starts, F.lit(0))))))


def price_ladder(price: Column) -> Column:
    """Prices from the next ten on, as many as the price's band has steps."""
    steps = F.when(price <= 100, 3).when(price <= 1000, 10).when(price <= 5000, 50).when(price <= 10000, 100).otherwise(4)
    return F.transform(F.sequence(F.lit(0), steps - 1), lambda k: F.ceil(price / 10) * 10 + k * 10)


def required_evidence(query: Column) -> Column:
    """The pages that a query asks for, sorted: the product's own always."""
    return F.array_sort(F.array_compact(F.array(F.lit("product_detail"), *[F.when(query.rlike(p), name) for name, p in EVIDENCE.items()])))
