"""Queries of normalisers, parsers, search, gates and messages (N, T, F, J12, J13, Y), and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import gates, goals, messages, search


def _t(spark, sf_dir, name, *columns):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _c(name):
    return F.col(name)


def n1_normal_forms(spark, sf_dir):
    """N1, N2, N5, N6 over ASCII names, where NFKC and folding are lower case."""
    p = _t(spark, sf_dir, "part", "p_partkey", F.concat_ws(" / ", "p_name", "p_type", "p_brand").alias("s"))
    return p.select("p_partkey", text.alnum_text(_c("s")).alias("alnum"), text.query_template(_c("s")).alias("template"), text.option_text(_c("s")).alias("option"), text.plain_text(_c("s")).alias("plain"), text.plain_text(_c("s"), True).alias("joined"))


def n3_search_tokens(spark, sf_dir):
    """N3, N4."""
    p = _t(spark, sf_dir, "part", "p_partkey", F.concat(_c("p_name"), F.lit(", "), _c("p_brand"), F.lit("; 中文词 "), _c("p_size"), F.lit(" RMB.")).alias("s"))
    return p.select("p_partkey", text.normal_query(_c("s")).alias("query"), F.array_join(text.search_tokens(_c("s")), " ").alias("tokens"))


def n7_option_axis(spark, sf_dir):
    names = [F.lit(x) for x in ("颜色", "鞋码", "总净含量", "Other Axis")]
    p = _t(spark, sf_dir, "part", "p_partkey").withColumn("raw", F.get(F.array(*names), (_c("p_partkey") % 4).cast("int")))
    return p.select("p_partkey", text.option_axis(_c("raw")).alias("axis"))


def n8_flat_map(spark, sf_dir):
    """N8, N9, N16."""
    p = _t(spark, sf_dir, "part")
    held = F.create_map(F.lit("type"), F.array("p_type"), F.lit("brand"), F.array("p_brand", F.col("p_size").cast("string")))
    listed = F.array(F.lit(" a  b "), _c("p_type"), F.lit(""), F.lit("a b"), _c("p_type"))
    return p.select("p_partkey", F.array_join(text.flat_map(held), "|").alias("flat"), text.first_filled(F.nullif(_c("p_type"), F.lit("ECONOMY")), _c("p_brand")).alias("first"), F.array_join(text.clean_list(listed), "|").alias("clean"))


def n10_models(spark, sf_dir):
    """N10, N11, N12, N24, N26."""
    p = _t(spark, sf_dir, "part")
    title = F.concat(_c("p_name"), F.lit(" X"), _c("p_size"), F.lit(" pro-3"))
    query = F.concat(F.lit("want x"), _c("p_size") % 10, F.lit(" or PRO-3 "), _c("p_type"))
    models = text.shared_models(query, title)
    level = text.difficulty(F.split("p_name", " "), F.array_repeat(F.lit("o"), (_c("p_size") % 5).cast("int")), models, F.when(_c("p_size") > 10, 1))
    return p.select("p_partkey", F.array_join(models, ",").alias("models"), level.alias("difficulty"), text.product_family(_c("p_type"), title).alias("family"), text.compact(title, 12).alias("compact"), text.shortened(title, 8, "~").alias("short"))


def n13_budget(spark, sf_dir):
    """N13, N27, N36."""
    forms = ["预算{}元以内", "预算1万{}左右", "价格{}-{}9元", "不超过{}元", "预算{}k+", "{}元以下", "nothing {}", "预算在{}万", "价格{}千左右"]
    n = _t(spark, sf_dir, "part", "p_partkey", (_c("p_size") % 9 + 1).cast("string").alias("n"))
    said = F.get(F.array(*[F.replace(F.lit(f), F.lit("{}"), _c("n")) for f in forms]), (_c("p_partkey") % len(forms)).cast("int"))
    return n.select("p_partkey", F.round(text.budget(said), 3).alias("budget"), F.round(text.wan_shorthand(_c("n"), _c("n"), F.lit(None)), 3).alias("wan"), F.array_join(text.price_ladder(_c("p_partkey") * 7 + 1), ",").alias("ladder"))


def n15_spans(spark, sf_dir):
    d = _t(spark, sf_dir, "documents", "doc_id", "text").where("text rlike '^[\\\\x00-\\\\x7f]*$'")
    found = text.exact_spans(_c("text"), F.lit("The"))
    return d.select("doc_id", F.size(found).alias("n"), F.coalesce(F.get(found, F.lit(0))["start"], F.lit(-1)).alias("first"), F.coalesce(F.array_max(F.transform(found, lambda s: s["end"])), F.lit(-1)).alias("last"))


def n17_signatures(spark, sf_dir):
    """N17 to N21."""
    e = _t(spark, sf_dir, "events")
    held = F.create_map(F.lit("note"), F.lit("x"), F.lit("kind"), _c("event_type"), F.lit("amount"), F.floor("value").cast("string"))
    tool = F.get(F.array(*[F.lit(t) for t in ("search_products", "open_product", "buy_now", "think", "next_page")]), (_c("event_id") % 5).cast("int"))
    action = text.tool_action(tool, _c("event_type"))
    parsed = text.parsed_action(F.coalesce(action, F.lit("none")))
    return e.select("event_id", text.action_signature(F.when(_c("event_id") % 3 == 0, F.concat(F.lit("Click[ "), _c("event_type"), F.lit("]"))), _c("event_type"), held).alias("signature"), text.process_signature(_c("event_type"), held).alias("process"), action.alias("action"), parsed["name"].alias("name"), parsed["argument"].alias("argument"))


def n22_observation(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    page = F.concat(F.lit("page_type: Product_Detail\nsubpage: "), F.lower("p_type"), F.lit("\nprice: "), F.when(_c("p_size") % 3 == 0, "None").otherwise(_c("p_size").cast("string")), F.lit('\nselected_options: {"a": "1", "b": "2"}\n1|'), _c("p_partkey").cast("string"), F.lit("|x\n2|77|y\n"))
    seen = text.observation(page)
    return p.select("p_partkey", seen["page_type"].alias("page_type"), seen["subpage"].alias("subpage"), seen["price_visible"].alias("price_visible"), seen["n_options"].alias("n_options"), F.array_join(seen["products"], ",").alias("products"))


def n23_classes(spark, sf_dir):
    """N23, N28, R22, N30, N35."""
    p = _t(spark, sf_dir, "part")
    unit = F.get(F.array(*[F.lit(u) for u in ("kg", "cm", "L", "pcs")]), (_c("p_partkey") % 4).cast("int"))
    based = text.in_base_unit(_c("p_size"), unit)
    asked = F.concat(F.lit("find "), _c("p_name"), F.when(_c("p_size") % 2 == 0, " 防水").otherwise(""), F.when(_c("p_size") % 3 == 0, " 评价 x9").otherwise(""))
    return p.select(
        "p_partkey", text.first_contained(_c("p_name"), ["cold", "widget"]).alias("colour"), text.size_class(F.when(_c("p_size") % 2 == 0, _c("p_size").cast("string")).otherwise(_c("p_type")), {"economy": "^eco", "large": "large"}).alias("size"),
        based["dimension"].alias("dimension"), based["value"].alias("value"), F.array_join(text.required_evidence(asked), ",").alias("evidence"),
        text.rendered({"name": _c("p_name"), "size": F.when(_c("p_size") > 20, _c("p_size"))}, {"secret"}).alias("shown"), F.array_join(text.oracle_actions(_c("p_name"), _c("p_partkey").cast("string"), F.array("p_type")), ";").alias("actions"),
    )


def n25_tool_arguments(spark, sf_dir):
    e = _t(spark, sf_dir, "events", "event_id", F.when(_c("event_id") % 3 == 0, _c("props")).when(_c("event_id") % 3 == 1, "[1]").otherwise("{x").alias("a"))
    parsed = text.tool_arguments(_c("a"))
    return e.select("event_id", parsed["error"].alias("error"), F.element_at(parsed["values"], "k").alias("k"))


def n29_stable_hash(spark, sf_dir):
    """N29, D7."""
    return _t(spark, sf_dir, "customer", "c_custkey", text.stable_hash(F.lit(7), _c("c_mktsegment"), _c("c_custkey")).alias("hash"))


def _index(spark, sf_dir):
    d = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return search.postings(d, "p_partkey", {"title": _c("p_name"), "brand": _c("p_brand"), "category": _c("p_type")}, _c("p_partkey"))


def t3_postings(spark, sf_dir):
    return _index(spark, sf_dir)


def t1_bm25(spark, sf_dir):
    wanted = _t(spark, sf_dir, "supplier", _c("s_suppkey").alias("query_id")).where("query_id < 8")
    words = ["cold widget", "small gadget economy", "brand 13 steel", "nothing here", "promo", "large cold brand 5", "widget", "economy standard"]
    wanted = wanted.withColumn("query", F.get(F.array(*[F.lit(w) for w in words]), _c("query_id").cast("int")))
    weights = search.checked_weights({"title": 3.0, "brand": 2.0, "category": 2.0}, ["title", "brand", "category"])
    return search.bm25(_index(spark, sf_dir), wanted, weights, 10).withColumn("score", F.round("score", 6))


def f1_strict_success(spark, sf_dir):
    """F1, F6, F7."""
    e = _t(spark, sf_dir, "events", "event_id", "event_type", "value")
    k = _c("event_id")
    maybe = lambda n: F.when(k % n == 0, F.lit(None).cast("boolean")).otherwise(k % (n + 1) > 0)
    version = F.when(k % 11 > 0, gates.REWARD_VERSION).otherwise("v2")
    status = F.when(k % 7 > 0, "done").otherwise("failed")
    strict = gates.strict_success(status, maybe(5), maybe(13), maybe(17), version, F.when(k % 2 == 0, "gold_purchase"), maybe(19), F.lit(True), F.lit("gold_purchase"))
    infra = gates.infrastructure_invalid(k % 6 == 0, F.when(k % 4 == 0, "TimeoutError").otherwise("ValueError"), F.when(k % 9 == 0, "x"))
    issues = gates.contract_issues(status, maybe(5), maybe(13), F.lit(True), F.when(k % 3 > 0, "d"), version, F.array().cast("array<string>"))
    return e.select("event_id", strict.alias("strict"), infra.alias("infrastructure"), F.array_join(issues, ",").alias("issues"))


def _trajectories(spark, sf_dir):
    """A user's events as a trajectory: purchases buy, views and clicks are the assistant's, errors are guards'."""
    e = _t(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    k, kind = _c("event_id"), _c("event_type")
    own = F.struct(
        k.alias("pos"), F.when(kind == "purchase", "environment_step").when(kind == "error", "guard_rejection").otherwise("assistant").alias("type"), F.when(kind == "purchase", "buy_now").when(k % 50 > 0, "search_products").otherwise("odd").alias("tool_name"),
        (_c("value") > 400).alias("done"), (k % 40).cast("int").alias("n_calls"), (_c("value") < 2).alias("dropped"), F.when(k % 60 == 1, "malformed_tool_arguments").when(k % 70 == 1, "tool_arguments_not_object").alias("arguments_error"), F.when(k % 30 > 0, "other").otherwise("schema_x").alias("reason"),
    )
    return e.groupBy("user_id").agg(F.array_sort(F.collect_list(own)).alias("events"))


def f2_acceptance_reasons(spark, sf_dir):
    u = _c("user_id")
    why = gates.acceptance_reasons(u % 2 == 0, F.when(u % 3 > 0, "c"), "c", F.when(u % 5 == 0, "e"), F.when(u % 7 == 0, "r"), u % 11 > 0, _c("events"), ["search_products", "buy_now"])
    return _trajectories(spark, sf_dir).select("user_id", F.array_join(why, ",").alias("reasons"))


def f3_indexed_reasons(spark, sf_dir):
    why = gates.indexed_reasons([("odd_user", _c("user_id") % 2 == 1), ("few", F.size("events") < 40)], _c("events"), {"guard": lambda m: (m["type"] == "guard_rejection") & (m["reason"] == "schema_x"), "dropped": lambda m: m["dropped"]})
    return _trajectories(spark, sf_dir).select("user_id", F.array_join(why, ",").alias("reasons"))


def f4_action_refusal(spark, sf_dir):
    e = _t(spark, sf_dir, "events", "event_id", "event_type")
    k = _c("event_id")
    tool = F.get(F.array(*[F.lit(t) for t in ("search_products", "open_product", "buy_now", "select_option", "next_page")]), (k % 5).cast("int"))
    why = gates.action_refusal(tool, F.when(k % 3 > 0, _c("event_type")).otherwise(""), F.when(k % 2 == 0, "product_detail").otherwise("search"), F.array(F.lit("view"), F.lit("click")), F.array(F.lit("Buy Now"), F.lit("Signup")))
    return e.select("event_id", why.alias("why"))


def f5_record_problems(spark, sf_dir):
    o = _t(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    row = {"status": F.when(_c("o_orderstatus") == "F", "done").when(_c("o_orderstatus") == "O", "infrastructure_failure").otherwise("odd"), "error": F.when(_c("o_orderkey") % 4 == 0, "e"), "task": F.when(_c("o_orderkey") % 5 > 0, 1)}
    why = gates.record_problems(row, ["task"], ["done", "infrastructure_failure"], _c("o_orderpriority"), F.when(_c("o_orderkey") % 3 > 0, F.sha2("o_orderpriority", 256)))
    return o.select("o_orderkey", F.array_join(why, ",").alias("problems"))


def f8_forbidden_keys(spark, sf_dir):
    """F8, F9, F14."""
    e = _t(spark, sf_dir, "events", "event_id", "props", "event_type")
    held = F.concat(F.lit('{"task_id": 1, "extra_info": {"'), F.when(_c("event_id") % 2 == 0, "task_id").otherwise("Answer"), F.lit('": "\\"gold\\": x"}}'))
    return e.select("event_id", F.array_join(gates.forbidden_keys(held, {"answer", "gold"}), ",").alias("keys"), gates.ids_only(held).alias("ids_only"), gates.has_marker(_c("event_type"), ["err", "sign"]).alias("marked"))


def f13_chat_problems(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").where("not (conv_id % 7 = 0 and turn = 1)")
    return gates.chat_problems(c, "conv_id", "turn", "role")


def f15_length_gate(spark, sf_dir):
    good, long = gates.length_gate(_t(spark, sf_dir, "documents", "doc_id", "n_chars"), F.ceil(_c("n_chars") / 4), 300)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(long).select("doc_id", "token_length", "reason")


def f16_reachability(spark, sf_dir):
    p = _t(spark, sf_dir, "part", "p_partkey", "p_size", "p_type", "p_name")
    why = gates.reachability(_c("p_size") % 3, F.array(F.lower("p_type")), F.array(F.lit("economy"), F.lit("promo")))
    return p.select("p_partkey", F.array_join(why, ",").alias("why"))


def f17_span_problems(spark, sf_dir):
    spans = _t(spark, sf_dir, "documents", "doc_id", (_c("doc_id") % 2).alias("rubric"), F.when(_c("doc_id") % 5 > 0, "hard").otherwise("odd").alias("hardness"), F.lit(2).alias("start"), F.lit(9).alias("end"), F.when(_c("doc_id") % 3 > 0, F.substring("text", 3, 7)).otherwise("zzz").alias("span"))
    return gates.span_problems(spans, _t(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")


def f18_label_problems(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels", "doc_id", (_c("quality") + _c("doc_id") % 3).alias("quality"), _c("toxic").cast("string").alias("toxic"))
    return gates.label_problems(labels, _t(spark, sf_dir, "documents", "doc_id").where("doc_id % 4 > 0"), "doc_id", {"toxic": ["0"]}, {"quality": (0, 2)})


def f25_reachability_problems(spark, sf_dir):
    return gates.reachability_problems(_t(spark, sf_dir, "orders", _c("o_custkey").alias("task")), _t(spark, sf_dir, "customer", _c("c_custkey").alias("task")).where("task % 3 > 0"), "task")


def j12_call_texts(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations", "conv_id", "turn", F.when(_c("role") == "user", "tool").otherwise(_c("role")).alias("role"), (_c("turn") % 3).alias("call"), F.sha2("text", 256).alias("text"))
    return messages.call_texts(c, "conv_id", "turn", "role", "call", "text").select("conv_id", "turn", "assistant_text")


def j13_previous_observation(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations", "conv_id", "turn", F.when(_c("role") == "user", "tool").otherwise(_c("role")).alias("role"), F.sha2("text", 256).alias("text"))
    return messages.previous_observation(c, "conv_id", "turn", "role", "text", _c("turn") % 4 == 0).select("conv_id", "turn", "observed")


def j14_products_by(spark, sf_dir):
    p = _t(spark, sf_dir, "part", _c("p_partkey").alias("asin"), _c("p_type").alias("category"), F.split("p_name", " ").alias("attribute"), _c("p_name").alias("query"))
    found = [goals.products_by(p, mode, value, 3, 20).select(F.lit(mode).alias("mode"), "asin") for mode, value in (("c", "ECONOMY"), ("a", "cold"), ("q", "cold widget"), ("r", None))]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def n33_goals(spark, sf_dir):
    p = _t(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    asked = F.array(*[F.struct(F.concat(_c("p_name"), F.lit(f" 预算{k}0元")).alias("instruction"), F.when(_c("p_size") % 2 == k % 2, F.array("p_name")).otherwise(F.array().cast("array<string>")).alias("attributes"), F.array(F.lit("o")).alias("options")) for k in (1, 2, 3)])
    return goals.goals(p.withColumn("i", asked), "p_partkey", "p_partkey", "i").select("task_id", "p_partkey", "price_upper")


def y1_chat_rows(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations", "conv_id", "turn", "role", F.substring("text", 1, 20).alias("text"))
    out = messages.chat_rows(c, "conv_id", "turn", "role", "text", _c("role") != "system", "(end)")
    return out.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|").alias("chat"))


def y5_kept_suffix(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations", "conv_id", "turn", F.floor(_c("turn") / 2).alias("pair"), F.length("text").alias("size"))
    return messages.kept_suffix(c, "conv_id", "turn", "pair", "size", _c("turn") == 0, 900).select("conv_id", "turn")


def y6_aligned_suffix(spark, sf_dir):
    """Y4, Y6, Y7."""
    p = _t(spark, sf_dir, "part", "p_partkey", "p_size", "p_name")
    ids = F.sequence(F.lit(1), _c("p_size"))
    owners = F.transform(ids, lambda i: F.when(i % 3 == 0, "assistant").otherwise("user"))
    cut = messages.aligned_suffix({"i": ids, "l": messages.masked_labels(ids, owners)}, F.lit(2), F.lit(7))
    fit = messages.fitted(F.split("p_name", " "), 8)
    return p.select("p_partkey", F.array_join(cut["i"], ",").alias("ids"), F.array_join(cut["l"], ",").alias("labels"), F.array_join(fit, " ").alias("fitted"))


def y8_unstable(spark, sf_dir):
    return messages.unstable(_t(spark, sf_dir, "orders", "o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus")


def y9_loader_stats(spark, sf_dir):
    return messages.loader_stats(_t(spark, sf_dir, "documents", "doc_id", "n_chars"), _t(spark, sf_dir, "labels", "doc_id"), "doc_id", _c("n_chars") < 2000)


def y10_recovered_query(spark, sf_dir):
    """Y3, Y10, Y11."""
    p = _t(spark, sf_dir, "part", "p_partkey", "p_brand", messages.recovered_query(F.when(_c("p_size") % 2 == 0, _c("p_name")), F.concat(F.lit("Instruction: "), _c("p_type"))).alias("query"))
    return messages.digested(messages.projected(p, ["p_partkey", "query", "p_brand"]), ["p_brand"])


_ROLES = "c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'tool' ELSE role END AS role, turn % 3 AS call, sha256(text) AS text FROM conversations)"
_INDEX = r"""f AS (SELECT p_partkey AS id, 'title' AS field, lower(p_name) AS s FROM part UNION ALL SELECT p_partkey, 'brand', lower(p_brand) FROM part UNION ALL SELECT p_partkey, 'category', lower(p_type) FROM part),
x AS (SELECT id, field, unnest(list_distinct(regexp_extract_all(s, '[a-z0-9]+(?:[._+\-/][a-z0-9]+)*'))) AS term FROM f),
z AS (SELECT id, count(*)::INT AS size FROM x GROUP BY 1), p AS (SELECT id, size, field, term, 1::BIGINT AS tf FROM x JOIN z USING (id))"""

ORACLES = {
    "n1_normal_forms": r"""WITH s AS (SELECT p_partkey, lower(concat_ws(' / ', p_name, p_type, p_brand)) AS s FROM part) SELECT p_partkey, regexp_replace(s, '[^a-z0-9]+', '', 'g') AS alnum, regexp_replace(regexp_replace(s, '\d+(?:\.\d+)?', '<num>', 'g'), '[^\w<>]+', '', 'g') AS template,
  regexp_replace(replace(s, '/', '|'), '\s+', '', 'g') AS option, trim(regexp_replace(s, '\s+', ' ', 'g')) AS plain, regexp_replace(s, '\s+', '', 'g') AS joined FROM s""",
    "n3_search_tokens": r"""WITH s AS (SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand || ' 中文词 ' || p_size), '\s+', ' ', 'g') || '元.' AS query FROM part), l AS (SELECT *, regexp_extract_all(query, '[a-z0-9]+(?:[._+\-/][a-z0-9]+)*') AS t FROM s)
SELECT p_partkey, query, array_to_string(list_concat(['中文', '文词', '元'], [x FOR x, i IN t IF list_position(t, x) = i]), ' ') AS tokens FROM l""",
    "n7_option_axis": "SELECT p_partkey, ['color', 'size', 'net_content', 'otheraxis'][p_partkey % 4 + 1] AS axis FROM part",
    "n8_flat_map": "SELECT p_partkey, 'brand|' || p_brand || '|' || p_size || '|type|' || p_type AS flat, CASE WHEN p_type = 'ECONOMY' THEN p_brand ELSE p_type END AS first, 'a b|' || p_type AS clean FROM part",
    "n10_models": r"""WITH t AS (SELECT *, p_name || ' X' || p_size || ' pro-3' AS title FROM part), m AS (SELECT *, CASE WHEN p_size = p_size % 10 THEN ['pro-3', 'x' || p_size] ELSE ['pro-3'] END AS models FROM t)
SELECT p_partkey, array_to_string(models, ',') AS models, CASE WHEN k <= 3 THEN 'easy' WHEN k <= 6 THEN 'medium' ELSE 'hard' END AS difficulty,
  sha256(regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g') || '|' || regexp_replace(regexp_replace(lower(title), '\d+(?:\.\d+)?', '<num>', 'g'), '[^\w<>]+', '', 'g')) AS family,
  CASE WHEN length(title) <= 12 THEN title ELSE substr(title, 1, 7) || '…' || substr(title, length(title) - 3) END AS compact, CASE WHEN length(title) <= 8 THEN title ELSE substr(title, 1, 6) || '~' || substr(title, length(title) - 1) END AS short
FROM (SELECT *, len(string_split(p_name, ' ')) + p_size % 5 + len(models) + (p_size > 10)::INT AS k FROM m)""",
    "n13_budget": """WITH n AS (SELECT p_partkey, p_size % 9 + 1 AS n, p_partkey * 7 + 1 AS x FROM part)
SELECT p_partkey, round([n, 10000 + CASE WHEN n < 10 THEN n * 1000 ELSE n END, n * 10 + 9, n, NULL, n, NULL, n * 10000, n * 1000][p_partkey % 9 + 1]::DOUBLE * CASE WHEN p_partkey % 9 IN (1, 8) THEN 1.1 ELSE 1 END, 3) AS budget,
  round(n * 10000 + n * 1000, 3)::DOUBLE AS wan, array_to_string([ceil(x / 10)::BIGINT * 10 + k * 10 FOR k IN range(CASE WHEN x <= 100 THEN 3 WHEN x <= 1000 THEN 10 WHEN x <= 5000 THEN 50 WHEN x <= 10000 THEN 100 ELSE 4 END)], ',') AS ladder FROM n""",
    "n15_spans": """WITH d AS (SELECT doc_id, string_split(lower(text), 'the') AS parts FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7f]*'))
SELECT doc_id, (len(parts) - 1)::INT AS n, CASE WHEN len(parts) > 1 THEN length(parts[1]) ELSE -1 END::INT AS first, CASE WHEN len(parts) > 1 THEN list_sum([length(x) + 3 FOR x IN parts[1:-2]]) ELSE -1 END::INT AS last FROM d""",
    "n17_signatures": """WITH e AS (SELECT *, ['search_products', 'open_product', 'buy_now', 'think', 'next_page'][event_id % 5 + 1] AS tool FROM events),
a AS (SELECT *, CASE tool WHEN 'search_products' THEN 'search[' || event_type || ']' WHEN 'open_product' THEN 'click[' || event_type || ']' WHEN 'buy_now' THEN 'click[Buy Now]' WHEN 'next_page' THEN 'click[Next >]' END AS action, floor(value)::BIGINT AS f FROM e)
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'env:click[ ' || event_type || ']' ELSE '["' || event_type || '", {"amount":"' || f || '","kind":"' || event_type || '"}]' END AS signature,
  sha256('{"parameters":{"amount":"' || f || '","kind":"' || event_type || '","note":"x"},"tool_name":"' || event_type || '"}') AS process, action,
  CASE WHEN action IS NULL THEN 'none' ELSE regexp_extract(action, '^(.+)\\[(.+)\\]', 1) END AS name, CASE WHEN action IS NOT NULL THEN regexp_extract(action, '^(.+)\\[(.+)\\]', 2) END AS argument FROM a""",
    "n22_observation": "SELECT p_partkey, 'product_detail' AS page_type, lower(p_type) AS subpage, p_size % 3 <> 0 AND p_size >= 10 AS price_visible, 2 AS n_options, p_partkey || ',77' AS products FROM part",
    "n23_classes": """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'cold') THEN 'cold' WHEN contains(lower(p_name), 'widget') THEN 'widget' ELSE 'not_matched' END AS colour,
  CASE WHEN p_size % 2 = 0 THEN 'numeric_size' WHEN starts_with(lower(p_type), 'eco') THEN 'economy' WHEN contains(lower(p_type), 'large') THEN 'large' ELSE 'not_matched' END AS size,
  ['mass_g', 'length_mm', 'volume_ml', NULL][p_partkey % 4 + 1] AS dimension, p_size * [1000.0, 10.0, 1000.0, NULL][p_partkey % 4 + 1]::DOUBLE AS value,
  concat_ws(',', CASE WHEN p_size % 3 = 0 THEN 'attributes' END, CASE WHEN p_size % 2 = 0 THEN 'features' END, 'product_detail', CASE WHEN p_size % 3 = 0 THEN 'reviews' END) AS evidence,
  concat_ws(chr(10), 'name: ' || p_name, CASE WHEN p_size > 20 THEN 'size: ' || p_size END) AS shown, 'search[' || p_name || '];click[' || p_partkey || '];click[' || p_type || '];click[Buy Now]' AS actions FROM part""",
    "n25_tool_arguments": "SELECT event_id, CASE event_id % 3 WHEN 1 THEN 'tool_arguments_not_object' WHEN 2 THEN 'malformed_tool_arguments' END AS error, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') END AS k FROM events",
    "n29_stable_hash": "SELECT c_custkey, sha256('7:' || c_mktsegment || ':' || c_custkey) AS hash FROM customer",
    "t3_postings": f"WITH {_INDEX} SELECT * FROM p",
    "t1_bm25": f"""WITH {_INDEX}, q AS (SELECT s_suppkey AS query_id, unnest(list_distinct(string_split(['cold widget', 'small gadget economy', 'brand 13 steel', 'nothing here', 'promo', 'large cold brand 5', 'widget', 'economy standard'][s_suppkey + 1], ' '))) AS term FROM supplier WHERE s_suppkey < 8),
w AS (SELECT term, id, size, sum(tf * CASE field WHEN 'title' THEN 3.0 ELSE 2.0 END) AS f FROM p GROUP BY 1, 2, 3), n AS (SELECT term, count(*) AS df FROM w GROUP BY 1), c AS (SELECT count(*) AS n, avg(size) AS m FROM z),
s AS (SELECT query_id, id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / m))) AS score FROM q JOIN w USING (term) JOIN n USING (term), c GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS rank, id, round(score, 6) AS score FROM s QUALIFY rank <= 10""",
    "f1_strict_success": """WITH e AS (SELECT event_id, event_id AS k, CASE WHEN event_id % 5 <> 0 THEN event_id % 6 > 0 END AS a, CASE WHEN event_id % 13 <> 0 THEN event_id % 14 > 0 END AS b, CASE WHEN event_id % 17 <> 0 THEN event_id % 18 > 0 END AS c,
  CASE WHEN event_id % 19 <> 0 THEN event_id % 20 > 0 END AS d, event_id % 7 > 0 AS done, event_id % 11 > 0 AS v FROM events)
SELECT event_id, done AND coalesce(a, false) AND coalesce(b, false) AND coalesce(c, false) AND v AND k % 2 = 0 AND coalesce(d, false) AS strict, k % 6 = 0 OR k % 4 = 0 OR k % 9 = 0 AS infrastructure,
  concat_ws(',', CASE WHEN done AND NOT coalesce(a, false) THEN 'done_status_without_trajectory_done' END, CASE WHEN done AND NOT coalesce(b, false) THEN 'done_status_without_terminal_done' END,
    CASE WHEN done AND k % 3 = 0 THEN 'done_status_without_reward_detail' END, CASE WHEN k % 3 > 0 AND NOT v THEN 'unexpected_reward_version' END) AS issues FROM e""",
    "f2_acceptance_reasons": """WITH t AS (SELECT user_id AS u, bool_or(event_type = 'purchase' AND value > 400) AS buy, bool_or(event_type NOT IN ('purchase', 'error') AND value < 2) AS dropped, bool_or(event_type NOT IN ('purchase', 'error') AND event_id % 40 > 1) AS several,
  bool_or(event_type NOT IN ('purchase', 'error') AND event_id % 40 > 0 AND event_id % 50 = 0) AS odd, bool_or(event_type NOT IN ('purchase', 'error') AND event_id % 60 = 1) AS bad, bool_or(event_type NOT IN ('purchase', 'error') AND event_id % 60 <> 1 AND event_id % 70 = 1) AS flat,
  bool_or(event_type = 'error' AND event_id % 30 = 0) AS broken FROM events GROUP BY 1)
SELECT u AS user_id, concat_ws(',', CASE WHEN broken THEN 'damaged_tool_structure' END, CASE WHEN u % 5 = 0 THEN 'has_error' END, CASE WHEN u % 11 = 0 THEN 'lease_not_released' END, CASE WHEN bad THEN 'malformed_tool_arguments' END,
  CASE WHEN NOT buy THEN 'missing_executed_terminal_buy' END, CASE WHEN several THEN 'multiple_tool_calls' END, CASE WHEN u % 2 > 0 THEN 'not_strict_gold' END, CASE WHEN dropped THEN 'parallel_tool_calls_dropped' END, CASE WHEN u % 7 = 0 THEN 'release_error' END,
  CASE WHEN u % 3 = 0 THEN 'runtime_contract_mismatch' END, CASE WHEN flat THEN 'tool_arguments_not_object' END, CASE WHEN odd THEN 'unknown_tool' END) AS reasons FROM t""",
    "f3_indexed_reasons": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT user_id, concat_ws(',', CASE WHEN user_id % 2 = 1 THEN 'odd_user' END, CASE WHEN count(*) < 40 THEN 'few' END, string_agg('guard:' || i, ',' ORDER BY i) FILTER (WHERE event_type = 'error' AND event_id % 30 = 0),
  string_agg('dropped:' || i, ',' ORDER BY i) FILTER (WHERE value < 2)) AS reasons FROM e GROUP BY 1""",
    "f4_action_refusal": """WITH e AS (SELECT event_id, event_id AS k, CASE WHEN event_id % 3 > 0 THEN event_type ELSE '' END AS a FROM events)
SELECT event_id, CASE k % 5 WHEN 0 THEN CASE WHEN a = '' THEN 'empty_query' END WHEN 1 THEN CASE WHEN a NOT IN ('view', 'click') THEN 'product_not_visible' END WHEN 2 THEN CASE WHEN k % 2 > 0 THEN 'not_a_product_page' END
  WHEN 3 THEN CASE WHEN a NOT IN ('buy now', 'signup') THEN 'target_not_available' END ELSE 'next_page_not_available' END AS why FROM e""",
    "f5_record_problems": """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'done_with_error' END, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 > 0 THEN 'failure_without_error' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'hash_mismatch' END, CASE WHEN o_orderkey % 5 = 0 THEN 'missing_task' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'unknown_status' END) AS problems FROM orders""",
    "f8_forbidden_keys": "SELECT event_id, CASE WHEN event_id % 2 > 0 THEN 'answer' ELSE '' END AS keys, event_id % 2 = 0 AS ids_only, contains(event_type, 'err') OR contains(event_type, 'sign') AS marked FROM events",
    "f13_chat_problems": """WITH c AS (SELECT * FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 1)), m AS (SELECT conv_id, role, lag(role) OVER w AS b, lead(role) OVER w AS a FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT DISTINCT conv_id, 'bad_start' AS problem FROM m WHERE b IS NULL AND role NOT IN ('system', 'user') UNION ALL SELECT DISTINCT conv_id, 'late_system' FROM m WHERE b IS NOT NULL AND role = 'system'
UNION ALL SELECT DISTINCT conv_id, 'repeated_role' FROM m WHERE b = role UNION ALL SELECT DISTINCT conv_id, 'ends_with_user' FROM m WHERE a IS NULL AND role = 'user'""",
    "f15_length_gate": "SELECT doc_id, ceil(n_chars / 4)::BIGINT AS token_length, CASE WHEN ceil(n_chars / 4) > 300 THEN 'too_long' END AS reason FROM documents",
    "f16_reachability": "SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 3 <> 1 THEN 'instruction_cardinality' END, CASE WHEN lower(p_type) NOT IN ('economy', 'promo') THEN 'required_option_not_exposed' END) AS why FROM part",
    "f17_span_problems": """SELECT doc_id, doc_id % 2 AS rubric, 'hardness' AS problem FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, doc_id % 2, 'span_text' FROM documents WHERE CASE WHEN doc_id % 3 > 0 THEN text IS NULL ELSE substr(text, 3, 7) IS DISTINCT FROM 'zzz' END AND NOT (doc_id % 3 > 0 AND text IS NULL)""",
    "f18_label_problems": """WITH l AS (SELECT doc_id, quality + doc_id % 3 AS q, toxic FROM labels), d AS (SELECT doc_id FROM documents WHERE doc_id % 4 > 0)
SELECT doc_id, 'toxic_not_listed' AS problem FROM l WHERE toxic IS DISTINCT FROM 0 UNION ALL SELECT doc_id, 'quality_out_of_range' FROM l WHERE NOT coalesce(q BETWEEN 0 AND 2, false)
UNION ALL SELECT doc_id, 'no_row' FROM l WHERE doc_id NOT IN (FROM d) UNION ALL SELECT doc_id, 'no_label' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM l)""",
    "f25_reachability_problems": """WITH o AS (SELECT o_custkey AS task, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT c_custkey AS task FROM customer WHERE c_custkey % 3 > 0)
SELECT task, 'classified_twice' AS problem FROM o WHERE n > 1 UNION ALL SELECT task, 'not_in_a_split' FROM o WHERE task NOT IN (FROM c) UNION ALL SELECT task, 'not_classified' FROM c WHERE task NOT IN (SELECT task FROM o)""",
    "j12_call_texts": f"WITH {_ROLES}, a AS (SELECT conv_id, call, arg_max(text, turn) AS t FROM c WHERE role = 'assistant' GROUP BY 1, 2) SELECT conv_id, turn, t AS assistant_text FROM c LEFT JOIN a USING (conv_id, call) WHERE role = 'tool'",
    "j13_previous_observation": f"WITH {_ROLES} SELECT conv_id, turn, last_value(CASE WHEN role = 'tool' AND turn % 4 <> 0 THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS observed FROM c",
    "j14_products_by": """SELECT 'c' AS mode, p_partkey AS asin FROM part WHERE p_type = 'ECONOMY' UNION ALL SELECT 'a', p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'cold')
UNION ALL SELECT 'q', p_partkey FROM part WHERE p_name = 'cold widget' UNION ALL SELECT 'r', p_partkey FROM (SELECT p_partkey FROM part ORDER BY sha256('3:' || p_partkey) LIMIT 20)""",
    "n33_goals": "SELECT row_number() OVER (ORDER BY p_partkey, k) - 1 AS task_id, p_partkey, (k * 10)::DOUBLE AS price_upper FROM part, (SELECT unnest([1, 2, 3]) AS k) WHERE p_size % 2 = k % 2",
    "y1_chat_rows": """WITH m AS (SELECT conv_id, turn, role, substr(text, 1, 20) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role <> 'system')
SELECT conv_id, string_agg(role || ':' || CASE back WHEN 1 THEN '(end)' ELSE t END, '|' ORDER BY turn) AS chat FROM m GROUP BY 1""",
    "y5_kept_suffix": """WITH c AS (SELECT conv_id, turn, turn // 2 AS pair, length(text) AS size, turn = 0 AS anchor FROM conversations),
s AS (SELECT *, coalesce(sum(size) FILTER (WHERE anchor) OVER (PARTITION BY conv_id), 0) + coalesce(sum(size) FILTER (WHERE NOT anchor) OVER (PARTITION BY conv_id ORDER BY pair DESC RANGE UNBOUNDED PRECEDING), 0) AS used FROM c)
SELECT conv_id, turn FROM s WHERE anchor OR used <= 900""",
    "y6_aligned_suffix": """WITH p AS (SELECT p_partkey, p_name, [i FOR i IN range(1, p_size + 1) IF i <= 2 OR i > p_size - least(5, greatest(p_size - 2, 0))] AS ids, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, array_to_string(ids, ',') AS ids, array_to_string([CASE WHEN i % 3 = 0 THEN i ELSE -100 END FOR i IN ids], ',') AS labels,
  array_to_string([x FOR x, i IN w IF list_sum([length(y) + 1 FOR y IN w[1:i]]) <= 9], ' ') AS fitted FROM p""",
    "y8_unstable": "SELECT o_custkey, count(DISTINCT o_orderstatus) AS signatures FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1",
    "y9_loader_stats": """SELECT count(*) AS total, count(*) FILTER (WHERE NOT w) AS filtered_out, count(*) FILTER (WHERE w AND n_chars < 2000) AS kept, count(*) FILTER (WHERE w AND n_chars >= 2000) AS dropped, count(DISTINCT doc_id) FILTER (WHERE w) AS matched
FROM (SELECT doc_id, n_chars, doc_id IN (SELECT doc_id FROM labels) AS w FROM documents)""",
    "y10_recovered_query": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS query, sha256(p_brand) AS p_brand_sha256 FROM part",
}
QUERIES = {name: globals()[name] for name in ORACLES}
