"""Queries of comparisons, variant prices and outcomes (R), and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import reward


def _t(spark, sf_dir, name, *columns):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _c(name):
    return F.col(name)


_ALIASES = {"brandone": "one", "brand#1": "one", "brand#5": "five"}


def r1_gates(spark, sf_dir):
    """R1 to R4."""
    p = _t(spark, sf_dir, "part")
    k = _c("p_partkey")
    actual = F.concat(F.when(k % 2 == 0, "Top›").otherwise(""), F.when(k % 3 == 0, "Mid › ").otherwise(""), _c("p_type"))
    attributes = F.array(F.concat(F.when(k % 2 == 0, "不支持").otherwise("支持"), _c("p_type")), F.lit("other"))
    return p.select(
        "p_partkey", reward.category_gate(F.lit("Mid›Economy"), actual).alias("category"), reward.brand_gate(F.lit("BrandOne"), _c("p_brand"), F.lit(None).cast("string"), _ALIASES).alias("brand"),
        reward.exact_brand(F.lit("BrandOne"), _c("p_brand"), F.lit("x"), _ALIASES).alias("exact"), reward.model_gate(F.lit("X5"), F.concat(F.lit("the x"), (k % 10).cast("string"), F.lit(" "), _c("p_name"))).alias("model"),
        reward.function_gate(F.lit("Economy"), attributes, _c("p_name")).alias("function"), reward.function_gate(F.lit("widget"), attributes, _c("p_name")).alias("fallback"),
    )


def r5_numeric(spark, sf_dir):
    p = _t(spark, sf_dir, "part", "p_partkey", "p_size")
    said = F.concat(F.lit("weight "), _c("p_size"), F.lit("kg or 7 g, 3 cm"))
    op = F.get(F.array(*[F.lit(o) for o in ("eq", "min", "max", "range", "odd")]), (_c("p_partkey") % 5).cast("int"))
    return p.select("p_partkey", reward.numeric_gate(F.lit(20000), F.lit("g"), op, said, F.lit(1000.0), F.lit(30000)).alias("mass"), reward.numeric_gate(F.lit(2), F.lit("ml"), op, said).alias("volume"))


def _options(spark, sf_dir):
    """A product's options: three sizes, priced alike or not, a colour, and two names of one axis for some products."""
    p = _t(spark, sf_dir, "part", _c("p_partkey").alias("product"), "p_size", "p_retailprice")
    k = _c("product")
    one = lambda axis, value, price: F.struct(F.lit(axis).alias("axis"), F.lit(value).alias("value"), price.cast("double").alias("price"))
    same, own = F.lit(5.0), _c("p_size").cast("double")
    held = F.array_compact(F.array(
        F.when(k % 7 > 0, one("尺码", "S", F.when(k % 2 == 0, own).otherwise(same))), F.when(k % 7 > 0, one("尺码", "M", F.when(k % 2 == 0, own + 1).otherwise(same))),
        F.when(k % 7 > 0, one("颜色", "red", F.when(k % 3 == 0, own + 2).otherwise(F.lit(None)))), F.when((k % 7 > 0) & (k % 3 == 0), one("颜色", "blue / x", F.when(k % 6 == 0, own + 9).otherwise(own + 2))),
        F.when(k % 11 == 0, one("鞋码", "42", same)),
    ))
    return p.select("product", F.explode(held).alias("o")).select("product", "o.*")


def _cases(spark, sf_dir):
    k = _c("p_partkey")
    cases = _t(spark, sf_dir, "part", k.alias("case"), k.alias("product"))
    picked = F.array_compact(F.array(F.when(k % 4 > 0, F.struct(F.lit("尺码").alias("axis"), F.when(k % 5 > 0, "s").otherwise("XL").alias("value"))), F.when(k % 3 > 0, F.struct(F.lit("颜色分类").alias("axis"), F.lit("RED").alias("value")))))
    selected = _t(spark, sf_dir, "part", k.alias("case"), F.explode(picked).alias("s")).select("case", "s.*")
    return cases, selected


def r7_variant_price(spark, sf_dir):
    """R7, R8, J16."""
    cases, selected = _cases(spark, sf_dir)
    combos = _t(spark, sf_dir, "part", _c("p_partkey").alias("product")).where("product % 10 = 1")
    rows = F.explode(F.array(F.struct(F.lit("鞋码").alias("axis"), F.lit("S").alias("value")), F.struct(F.lit("颜色").alias("axis"), F.lit("red").alias("value"))))
    combos = combos.select("product", F.lit(0).alias("combination"), F.lit(77.0).alias("price"), rows.alias("o")).select("product", "combination", "o.*", "price")
    base = _t(spark, sf_dir, "part", _c("p_partkey").alias("product"), _c("p_retailprice").alias("price"))
    return reward.variant_prices(cases, reward.option_index(_options(spark, sf_dir)), selected, combos, base)


def r9_compared_options(spark, sf_dir):
    cases, selected = _cases(spark, sf_dir)
    required = cases.select("case", F.when(_c("case") % 13 == 0, "flavor").otherwise("size").alias("axis"), F.lit("S").alias("value"))
    return reward.compared_options(cases, required, reward.option_index(_options(spark, sf_dir)), selected)


def r10_filled_options(spark, sf_dir):
    """R10, T6."""
    cases, _ = _cases(spark, sf_dir)
    required = cases.where("case % 2 = 0").select("case", F.lit("color").alias("axis"), F.lit("Blue/X").alias("value"))
    return reward.filled_options(cases, required, reward.option_index(_options(spark, sf_dir)))


def n31_resolved_options(spark, sf_dir):
    cases, _ = _cases(spark, sf_dir)
    values = F.posexplode(F.array(F.lit("S"), F.lit("m"), F.lit("nothing"), F.lit("Red")))
    required = cases.select("case", "product", values.alias("pos", "value"))
    return reward.resolved_options(required, reward.option_index(_options(spark, sf_dir)))


def _scored(spark, sf_dir):
    k = _c("p_partkey")
    s = lambda n: F.when(k % n == 0, "fail").when(k % (n + 1) == 0, "unverifiable").otherwise("pass")
    p = _t(spark, sf_dir, "part", "p_partkey", "p_retailprice")
    prefer = reward.preferences({"brand": F.when(k % 2 == 0, F.array(s(5))).otherwise(F.array().cast("array<string>")), "model": F.array(s(7), s(3)), "core_functions": F.array(s(4)), "key_options": F.array().cast("array<string>")})
    return p.withColumn("prefer", prefer), [s(11), s(17)]


def r11_preferences(spark, sf_dir):
    """R6, R11, R13, R19."""
    p, hard = _scored(spark, sf_dir)
    price = reward.price_gate(F.when(_c("p_partkey") % 6 > 0, F.lit(905.0)), F.when(_c("p_partkey") % 5 > 0, "pass"), _c("p_retailprice"))
    return p.select("p_partkey", F.round("prefer.match_score", 9).alias("match_score"), F.round("prefer.coverage", 9).alias("coverage"), "prefer.all_satisfied", reward.eligible(hard, _c("prefer")).alias("eligible"), price.alias("price"), F.round(reward.length_penalty(_c("p_partkey") % 50), 9).alias("penalty"))


def r12_purchase(spark, sf_dir):
    """R12, F22."""
    p, hard = _scored(spark, sf_dir)
    out = reward.purchase(hard, _c("prefer"), _c("p_partkey") % 3 == 0)
    made = p.withColumn("o", out)
    wrong = reward.reward_problems(F.lit(reward.REWARD_VERSION), _c("o.reward_type"), F.when(_c("p_partkey") % 8 > 0, _c("o.reward_type")).otherwise("x"), _c("o.reward_valid"), _c("o.reward"), F.when(_c("p_partkey") % 9 > 0, ~_c("o.reward_valid")).otherwise(F.lit(None)), _c("prefer.match_score"))
    return made.select("p_partkey", "o.reward_type", F.round("o.reward", 9).alias("reward"), "o.reward_valid", F.array_join(wrong, ",").alias("problems"))


def r14_abstention(spark, sf_dir):
    """R14, R15, F21."""
    k = _c("p_partkey")
    p = _t(spark, sf_dir, "part", "p_partkey", reward.abstention(k % 4, k % 3, F.when(k % 5 > 0, k % 2)).alias("kind"), "p_name")
    return p.select("p_partkey", "kind", reward.fixed_reward(_c("kind")).alias("reward"), reward.constraint_contract(F.when(k % 2 == 0, "  ").otherwise(_c("p_name")), F.when(k % 3 > 0, F.array("p_name")), F.array()).alias("complete"))


def r17_disagreements(spark, sf_dir):
    """R17, J5."""
    li = _t(spark, sf_dir, "lineitem", _c("l_orderkey").alias("case"), _c("l_linenumber").alias("rubric"), F.when(_c("l_linestatus") == "F", "hard").otherwise("soft").alias("hardness"), F.expr("case l_returnflag when 'R' then 'violated' when 'A' then 'not_applicable' else 'satisfied' end").alias("status"))
    o = _t(spark, sf_dir, "orders", _c("o_orderkey").alias("case"), F.expr("case o_orderstatus when 'F' then 'gold_purchase' when 'O' then 'wrong_purchase' else 'partial_alternative_purchase' end").alias("reward_type"), (_c("o_orderstatus") == "F").alias("success"))
    return reward.disagreements(li, o).select("case", F.array_join("reasons", ",").alias("reasons"))


_OPTIONS = """i AS (SELECT p_partkey AS k, p_size::DOUBLE AS s, p_retailprice FROM part),
opts AS (SELECT k, 'size' AS axis, 'a' AS raw, 's' AS value, CASE WHEN k % 2 = 0 THEN s ELSE 5 END AS price FROM i WHERE k % 7 > 0 UNION ALL SELECT k, 'size', 'a', 'm', CASE WHEN k % 2 = 0 THEN s + 1 ELSE 5 END FROM i WHERE k % 7 > 0
  UNION ALL SELECT k, 'color', 'c', 'red', CASE WHEN k % 3 = 0 THEN s + 2 END FROM i WHERE k % 7 > 0 UNION ALL SELECT k, 'color', 'c', 'blue|x', CASE WHEN k % 6 = 0 THEN s + 9 ELSE s + 2 END FROM i WHERE k % 7 > 0 AND k % 3 = 0
  UNION ALL SELECT k, 'size', 'b', '42', 5 FROM i WHERE k % 11 = 0),
axes AS (SELECT k, axis, count(DISTINCT raw) > 1 AS bad, count(DISTINCT price) AS prices FROM opts GROUP BY 1, 2)"""
_STATUS = "CASE WHEN k % {a} = 0 THEN 'fail' WHEN k % {b} = 0 THEN 'unverifiable' ELSE 'pass' END"
_SCORES = f"""z AS (SELECT p_partkey AS k, p_retailprice, {_STATUS.format(a=5, b=6)} AS b, {_STATUS.format(a=7, b=8)} AS m1, {_STATUS.format(a=3, b=4)} AS m2, {_STATUS.format(a=4, b=5)} AS f, {_STATUS.format(a=11, b=12)} AS h1, {_STATUS.format(a=17, b=18)} AS h2 FROM part),
y AS (SELECT *, CASE WHEN k % 2 = 0 THEN 0.35 ELSE 0 END AS wb FROM z),
x AS (SELECT *, (wb * (b = 'pass')::INT + 0.25 * ((m1 = 'pass')::INT + (m2 = 'pass')::INT) / 2 + 0.25 * (f = 'pass')::INT) / (wb + 0.5) AS score,
  (wb * (b <> 'unverifiable')::INT + 0.25 * ((m1 <> 'unverifiable')::INT + (m2 <> 'unverifiable')::INT) / 2 + 0.25 * (f <> 'unverifiable')::INT) / (wb + 0.5) AS coverage FROM y)"""

ORACLES = {
    "r1_gates": """WITH p AS (SELECT *, p_partkey AS k, lower(p_type) AS t, lower(p_brand) AS b FROM part)
SELECT p_partkey, CASE WHEN t = 'economy' AND (k % 3 = 0 OR k % 2 > 0) THEN 'pass' ELSE 'fail' END AS category, CASE WHEN contains(b, 'brand#1') THEN 'pass' ELSE 'fail' END AS brand, CASE WHEN b = 'brand#1' THEN 'pass' ELSE 'fail' END AS exact,
  CASE WHEN k % 10 = 5 THEN 'pass' ELSE 'fail' END AS model, CASE WHEN t = 'economy' AND k % 2 > 0 THEN 'pass' ELSE 'fail' END AS "function", CASE WHEN contains(lower(p_name), 'widget') THEN 'pass' ELSE 'fail' END AS fallback FROM p""",
    "r5_numeric": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN abs(p_size - 20) <= 1 THEN 'pass' ELSE 'fail' END WHEN 1 THEN CASE WHEN p_size >= 19 THEN 'pass' ELSE 'fail' END WHEN 2 THEN 'pass'
  WHEN 3 THEN CASE WHEN p_size BETWEEN 19 AND 31 THEN 'pass' ELSE 'fail' END ELSE 'unverifiable' END AS mass, 'unverifiable' AS volume FROM part""",
    "r7_variant_price": f"""WITH {_OPTIONS}, g AS (SELECT k, bool_or(bad) AS bad, count(*) FILTER (WHERE prices > 1) AS eff, min(axis) FILTER (WHERE prices > 1) AS ax FROM axes GROUP BY 1),
v AS (SELECT k, count(DISTINCT price) AS n, min(price) AS one FROM opts GROUP BY 1),
c AS (SELECT i.k, bad, coalesce(eff, 0) AS eff, ax, coalesce(n, 0) AS n, one, g.k IS NULL AS none, p_retailprice, i.k % 10 = 1 AND i.k % 4 > 0 AND i.k % 5 > 0 AND i.k % 3 > 0 AS combo,
  CASE ax WHEN 'size' THEN CASE WHEN i.k % 4 > 0 THEN CASE WHEN i.k % 5 > 0 THEN 's' ELSE 'xl' END END WHEN 'color' THEN CASE WHEN i.k % 3 > 0 THEN 'red' END END AS chosen FROM i LEFT JOIN g USING (k) LEFT JOIN v USING (k)),
d AS (SELECT c.*, o.price AS own FROM c LEFT JOIN opts o ON o.k = c.k AND o.axis = c.ax AND o.value = c.chosen),
m AS (SELECT *, CASE WHEN coalesce(bad, false) THEN 'invalid_option_axes' WHEN combo THEN 'full_variant_combination' WHEN eff > 1 THEN 'multiple_effective_price_axes' WHEN eff = 1 AND chosen IS NULL THEN 'effective_price_axis_unselected'
  WHEN eff = 1 AND own IS NULL THEN 'selected_variant_price_missing' WHEN eff = 1 THEN 'unique_effective_price_axis' WHEN n = 1 THEN 'constant_option_price' WHEN none THEN 'single_base_price' ELSE 'price_not_deterministic' END AS method FROM d),
r AS (SELECT k AS "case", CASE method WHEN 'full_variant_combination' THEN 77.0 WHEN 'unique_effective_price_axis' THEN own WHEN 'constant_option_price' THEN one WHEN 'single_base_price' THEN p_retailprice END::DOUBLE AS price, method FROM m)
SELECT "case", CASE WHEN price IS NULL THEN 'unverifiable' ELSE 'pass' END AS status, price, method FROM r""",
    "r9_compared_options": f"""WITH {_OPTIONS}, bad AS (SELECT k, bool_or(bad) AS bad FROM axes GROUP BY 1)
SELECT i.k AS "case", CASE WHEN coalesce(bad, false) OR i.k % 13 = 0 OR (i.k % 7 = 0 AND i.k % 11 <> 0) THEN 'unverifiable' WHEN i.k % 7 = 0 OR i.k % 4 = 0 OR i.k % 5 = 0 THEN 'fail' ELSE 'pass' END AS status FROM i LEFT JOIN bad USING (k)""",
    "r10_filled_options": f"""WITH {_OPTIONS}, r AS (SELECT k, axis, value, row_number() OVER (PARTITION BY k, axis ORDER BY price IS NULL, price, value) AS n FROM opts JOIN axes USING (k, axis) WHERE NOT bad)
SELECT k AS "case", 'color' AS axis, 'blue|x' AS value FROM i WHERE k % 2 = 0 UNION ALL SELECT k, axis, value FROM r WHERE n = 1 AND NOT (axis = 'color' AND k % 2 = 0)""",
    "n31_resolved_options": """WITH c AS (SELECT p_partkey AS k, unnest([0, 1, 2, 3]) AS pos, unnest(['S', 'm', 'nothing', 'Red']) AS value FROM part)
SELECT k AS "case", pos, value, CASE WHEN pos <> 2 AND k % 7 > 0 THEN CASE pos WHEN 3 THEN 'color' ELSE 'size' END END AS axis, CASE WHEN pos = 2 OR k % 7 = 0 THEN 'axis_not_found' WHEN pos = 1 THEN 'canonical_axis_collision' END AS reason FROM c""",
    "r11_preferences": f"""WITH {_SCORES} SELECT k AS p_partkey, round(score, 9) AS match_score, round(coverage, 9) AS coverage, abs(score - 1) <= 1e-8 AND abs(coverage - 1) <= 1e-8 AS all_satisfied,
  h1 = 'pass' AND h2 = 'pass' AND score >= 0.7 AND coverage >= 0.75 AS eligible, CASE WHEN k % 6 = 0 THEN 'pass' WHEN k % 5 = 0 THEN 'unverifiable' WHEN p_retailprice <= 905 THEN 'pass' ELSE 'fail' END AS price,
  round(least(greatest(k % 50 - 20, 0) * 0.01, 0.15), 9)::DOUBLE AS penalty FROM x""",
    "r12_purchase": f"""WITH {_SCORES}, t AS (SELECT *, CASE WHEN 'unverifiable' IN (h1, h2) THEN 'reward_unverifiable' WHEN 'fail' IN (h1, h2) THEN 'wrong_purchase' WHEN abs(score - 1) > 1e-8 OR abs(coverage - 1) > 1e-8 THEN 'partial_alternative_purchase'
  WHEN k % 3 = 0 THEN 'gold_purchase' ELSE 'valid_alternative_purchase' END AS kind FROM x)
SELECT k AS p_partkey, kind AS reward_type, round(CASE kind WHEN 'reward_unverifiable' THEN 0 WHEN 'wrong_purchase' THEN -0.85 WHEN 'gold_purchase' THEN 1 WHEN 'valid_alternative_purchase' THEN 0.55 ELSE least(0.25, -0.3 + 0.55 * score) END, 9)::DOUBLE AS reward,
  kind <> 'reward_unverifiable' AS reward_valid, concat_ws(',', CASE WHEN k % 9 = 0 THEN 'sampling_invalid' END, CASE WHEN k % 8 = 0 THEN 'termination_reason' END) AS problems FROM t""",
    "r14_abstention": """WITH p AS (SELECT *, p_partkey AS k FROM part), a AS (SELECT *, CASE WHEN k % 4 >= 2 AND k % 3 >= 2 AND (k % 5 = 0 OR k % 2 = 0) THEN 'graceful_stop' ELSE 'early_abstain' END AS kind FROM p)
SELECT p_partkey, kind, CASE kind WHEN 'graceful_stop' THEN -0.15 ELSE -0.35 END::DOUBLE AS reward, k % 2 > 0 AND k % 3 > 0 AS complete FROM a""",
    "r17_disagreements": """WITH a AS (SELECT l_orderkey AS k, l_linestatus = 'F' AS hard, l_returnflag AS f FROM lineitem), s AS (SELECT k, count(*) FILTER (WHERE f = 'R') AS v, count(*) FILTER (WHERE f = 'R' AND hard) AS vh, count(*) FILTER (WHERE f <> 'A') AS n,
  count(*) FILTER (WHERE f <> 'A' AND hard) AS nh FROM a GROUP BY 1),
r AS (SELECT o_orderkey AS "case", concat_ws(',', CASE WHEN o_orderstatus NOT IN ('F', 'O') AND n > 0 AND v = 0 THEN 'partial_reward_with_all_rubrics_satisfied' END, CASE WHEN o_orderstatus = 'F' AND vh > 0 THEN 'reward_success_with_hard_rubric_violation' END,
  CASE WHEN o_orderstatus = 'F' AND v > 0 THEN 'reward_success_with_rubric_violation' END, CASE WHEN o_orderstatus = 'O' AND nh > 0 AND vh = 0 THEN 'wrong_purchase_with_all_hard_rubrics_satisfied' END) AS reasons FROM orders JOIN s ON k = o_orderkey)
SELECT * FROM r WHERE reasons <> ''""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
