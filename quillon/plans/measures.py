"""Queries of aggregations and statistics (A, J4 to J7, X), and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quillon.operators import evaluation, ranking, statistics


def _t(spark, sf_dir, name, *columns):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def a2_panels(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    expected = _t(spark, sf_dir, "documents", "doc_id")
    return evaluation.panels(expected, rows, "doc_id", {"quality_rate": F.col("quality") == 1, "toxic_rate": F.col("toxic") == 1}, {"mean_sum": F.col("quality") + F.col("toxic")})


def a3_trajectory_metrics(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    kind = F.col("event_type")
    return evaluation.trajectory_metrics(e, "user_id", ["ts", "event_id"], "event_type", "event_type", kind == "error", kind == "view", kind == "click", F.get_json_object("props", "$.k"), F.length("props"))


def a5_counters(spark, sf_dir):
    out = evaluation.counters(_t(spark, sf_dir, "events", "user_id", "event_type"), "user_id", "event_type")
    return out.select("user_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


def a6_collection_quality(spark, sf_dir):
    o = _t(spark, sf_dir, "orders", "o_custkey", "o_orderstatus")
    return evaluation.collection_quality(o, "o_custkey", F.col("o_orderstatus") == "F", F.col("o_custkey") % 3 != 0)


def a7_reachability_summary(spark, sf_dir):
    p = _t(spark, sf_dir, "part", "p_brand", "p_partkey", "p_size")
    why = F.array_compact(F.array(F.when(F.col("p_size") > 30, "large"), F.when(F.col("p_size") % 2 == 0, "even")))
    out = evaluation.reachability_summary(p.withColumn("why", why), "p_brand", "p_partkey", F.size("why") == 0, F.col("why"))
    return out.select("p_brand", "n_tasks", "n_eligible", F.element_at("reasons", "large").alias("large"), F.element_at("reasons", "even").alias("even"))


def a10_distribution(spark, sf_dir):
    out = evaluation.distribution(_t(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("deviation", F.round("deviation", 6))


def a12_histogram(spark, sf_dir):
    edges = [-1.0, -0.8, -0.6, -0.4, -0.2, 0.0, 0.2, 0.4, 0.6, 0.8, 1.000001]
    return evaluation.histogram(_t(spark, sf_dir, "lineitem", (F.col("l_discount") * 20 - F.col("l_tax") * 15 - 0.5).alias("v")), "v", edges)


def a13_step_buckets(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem", F.col("l_quantity").cast("int").alias("steps"), "l_returnflag", "l_extendedprice")
    return evaluation.step_buckets(li, "steps", 35, F.col("l_returnflag") == "A", F.floor("l_extendedprice"))


def a14_most_common(spark, sf_dir):
    return evaluation.most_common(_t(spark, sf_dir, "events", "event_type", "user_id"), "event_type", "user_id")


def a15_agreement(spark, sf_dir):
    o = _t(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderstatus")
    return evaluation.agreement(o, _t(spark, sf_dir, "customer", "c_custkey"), "c_custkey", "o_orderpriority", F.col("o_orderstatus") == "F", 5)


def a15_unanimous(spark, sf_dir):
    o = _t(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice")
    return evaluation.unanimous(o, _t(spark, sf_dir, "customer", "c_custkey"), "c_custkey", "o_orderstatus", F.col("o_totalprice") > 100_000)


def _runs(spark, sf_dir):
    """Two runs over the labelled documents."""
    labels = _t(spark, sf_dir, "labels", "doc_id", "quality", "toxic").join(_t(spark, sf_dir, "documents", "doc_id", "n_chars"), "doc_id")
    a = labels.select("doc_id", F.lit("a").alias("run"), F.col("quality").alias("ok"), F.col("n_chars").alias("steps"))
    b = labels.select("doc_id", F.lit("b").alias("run"), (1 - F.col("toxic")).alias("ok"), F.when(F.col("doc_id") % 3 > 0, F.col("n_chars") + F.col("doc_id") % 5 - 2).alias("steps"))
    c = labels.where("doc_id % 2 = 0").select("doc_id", F.lit("c").alias("run"), (F.col("doc_id") % 4 == 0).cast("int").alias("ok"), F.col("n_chars").alias("steps"))
    return a.unionByName(b).unionByName(c)


def j6_paired_runs(spark, sf_dir):
    return evaluation.paired(_runs(spark, sf_dir), "doc_id", "run", ["ok"])


def j7_fully_paired(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return evaluation.fully_paired(r.where("run = 'a'"), r.where("run = 'c'"), _t(spark, sf_dir, "documents", "doc_id").where("doc_id % 3 = 0"), "doc_id")


def a16_paired_deltas(spark, sf_dir):
    pairs = evaluation.paired(_runs(spark, sf_dir), "doc_id", "run", ["ok", "steps"])
    out = evaluation.paired_deltas(pairs, ["ok", "steps"], {"steps"})
    return out.select("left_run", "right_run", "measure", "n", *[F.round(c, 6).alias(c) for c in ("left_mean", "right_mean", "mean_delta")], "better", "equal", "worse")


def a17_transitions(spark, sf_dir):
    return evaluation.transition_matrix(evaluation.paired(_runs(spark, sf_dir), "doc_id", "run", ["ok"]), "ok")


def successions(spark, sf_dir):
    return evaluation.successions(_t(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")


def _truncation(spark, sf_dir):
    e = _t(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type", "value")
    ok = e.groupBy("user_id").agg((F.count_if(F.col("event_type") == "purchase") > 8).alias("ok"))
    return evaluation.truncation(e, "user_id", ["ts", "event_id"], F.col("value") > 300, F.col("event_type") == "error", ok)


def a18_truncation(spark, sf_dir):
    return _truncation(spark, sf_dir)[0].withColumn("rate", F.round("rate", 6))


def a19_after_truncation(spark, sf_dir):
    return _truncation(spark, sf_dir)[1].withColumn("guard_rate", F.round("guard_rate", 6))


def a20_rollout_metrics(spark, sf_dir):
    out = evaluation.rollout_metrics(_t(spark, sf_dir, "lineitem"), {"quantity": F.col("l_quantity"), "tax": F.col("l_tax")}, {"returned": F.col("l_returnflag") == "R"})
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])


def _groups(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return evaluation.varying_groups(li, "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 4 == 0, F.lit(0.0)).otherwise(F.floor(F.col("l_quantity") / 10).cast("double")), F.col("l_returnflag") == "R")


def a21_varying_groups(spark, sf_dir):
    return _groups(spark, sf_dir)


def a22_accepted_groups(spark, sf_dir):
    return evaluation.accepted_groups(_groups(spark, sf_dir).select("group", F.col("group").alias("first"), "verdict"), 25).select("group", "place")


def a23_collection_summary(spark, sf_dir):
    out = evaluation.collection_summary(_t(spark, sf_dir, "orders", "o_orderstatus", "o_orderpriority", "o_totalprice"), "o_orderstatus", F.col("o_orderpriority"), F.col("o_totalprice") > 200_000, F.col("o_orderstatus") == "P")
    return out.select("n", F.round("gold_rate", 6).alias("gold_rate"), F.round("infra_rate", 6).alias("infra_rate"), F.element_at("status_counts", "F").alias("f"), F.size("reward_type_counts").alias("kinds"))


def a24_merge_report(spark, sf_dir):
    return evaluation.merge_report(_t(spark, sf_dir, "documents", "doc_id", "text", "source"), "source", F.coalesce("text", F.lit("")), F.col("doc_id") % 3 > 0)


def a26_id_hashes(spark, sf_dir):
    return evaluation.id_hashes(_t(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), "c_custkey", F.struct("c_acctbal", "c_custkey"))


def a27_running_projection(spark, sf_dir):
    e = _t(spark, sf_dir, "events", "event_id", "user_id", "ts", F.length("props").alias("size"))
    return evaluation.running_projection(e, "user_id", ["ts", "event_id"], "size").select("event_id", "size_so_far", "largest_so_far")


def a30_evaluation_facts(spark, sf_dir):
    ids = _t(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("pos"))
    facts = _t(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").where("c_custkey % 5 > 0")
    return evaluation.evaluation_facts(ids, facts, "c_custkey", _t(spark, sf_dir, "customer", "c_custkey").where("c_custkey % 8 = 1"))


def x1_mcnemar(spark, sf_dir):
    n = spark.range(0, 900).select((F.col("id") % 30).alias("b"), F.floor(F.col("id") / 30).alias("c"))
    return n.select("b", "c", F.floor(statistics.mcnemar(F.col("b"), F.col("c")) * 1_000_000 + 0.123).alias("p_millionths"))


def x2_holm(spark, sf_dir):
    p = _t(spark, sf_dir, "part", "p_partkey", "p_brand", ((F.col("p_partkey") * 37 % 101) / 1000).alias("p"))
    return statistics.holm(p, "p_brand", "p", F.col("p_partkey")).select("p_partkey", F.round("p_holm", 9).alias("p_holm"))


def x3_bootstrap(spark, sf_dir):
    pairs = _t(spark, sf_dir, "labels", "doc_id", F.lit("a/b").alias("family"), F.lit("ok").alias("endpoint"), (1 - F.col("toxic") - F.col("quality")).alias("delta"))
    return statistics.bootstrap(pairs, "family", "endpoint", "doc_id", "delta", 7, 200)


def x3_hash_bootstrap(spark, sf_dir):
    pairs = _t(spark, sf_dir, "labels", "doc_id", F.lit("a/b").alias("family"), (1 - F.col("toxic") - F.col("quality")).alias("delta"))
    return statistics.hash_bootstrap(pairs, "family", "doc_id", F.col("delta"), 20, 7).withColumn("mean", F.round("mean", 9))


def x4_paired_report(spark, sf_dir):
    out = statistics.paired_report(evaluation.paired(_runs(spark, sf_dir), "doc_id", "run", ["ok", "steps"]), ["ok"], ["steps"])
    return out.select("left_run", "right_run", "endpoint", "kind", "n", "b", "c", *[F.round(x, 6).alias(x) for x in ("left_mean", "right_mean", "difference", "p", "p_holm")])


def x5_adjacent_families(spark, sf_dir):
    return statistics.adjacent_families(_t(spark, sf_dir, "orders", "o_orderpriority"), "o_orderpriority")


def d20_rollout_index(spark, sf_dir):
    return ranking.indexed(_t(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "rollout", F.col("l_linenumber"), F.col("l_partkey"))


_RUNS = """l AS (SELECT doc_id, quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)),
runs AS (SELECT doc_id, 'a' AS run, quality AS ok, n_chars AS steps FROM l UNION ALL SELECT doc_id, 'b', 1 - toxic, CASE WHEN doc_id % 3 > 0 THEN n_chars + doc_id % 5 - 2 END FROM l
  UNION ALL SELECT doc_id, 'c', (doc_id % 4 = 0)::INT, n_chars FROM l WHERE doc_id % 2 = 0),
pairs AS (SELECT x.doc_id, x.run AS left_run, y.run AS right_run, x.ok AS left_ok, y.ok AS right_ok, x.steps AS left_steps, y.steps AS right_steps FROM runs x JOIN runs y ON x.doc_id = y.doc_id AND x.run < y.run),
long AS (SELECT left_run, right_run, 'ok' AS measure, left_ok::DOUBLE AS l, right_ok::DOUBLE AS r, 1 AS sign FROM pairs UNION ALL SELECT left_run, right_run, 'steps', left_steps, right_steps, -1 FROM pairs)"""
_P = "CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum([exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)) FOR k IN range(0, least(b, c) + 1)])) END"
_VALUE = "CASE WHEN l_orderkey % 4 = 0 THEN 0 ELSE floor(l_quantity / 10) END"
_GROUPS = f"""g AS (SELECT l_orderkey AS "group", min(l_linenumber) AS first, count(*) AS n, CASE WHEN bool_or(l_returnflag = 'R') THEN 'sampling_invalid' WHEN max({_VALUE}) - min({_VALUE}) > 1e-8 THEN 'kept' ELSE 'constant_reward' END AS verdict,
  max(abs({_VALUE})) <= 1e-8 AS all_zero FROM lineitem GROUP BY 1)"""
_EDGES = "unnest([-1.0, -0.8, -0.6, -0.4, -0.2, 0.0, 0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS a, unnest([-0.8, -0.6, -0.4, -0.2, 0.0, 0.2, 0.4, 0.6, 0.8, 1.000001]::DOUBLE[]) AS b, unnest(range(10)) AS bin"
_TRUNCATED = "t AS (SELECT user_id, event_type = 'error' AS g, value > 300 AS cut, lag(value > 300) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events)"

_BOUNDS, _TOTAL = [], 0.0
for _k in range(12):
    _TOTAL += math.exp(-1) / math.factorial(_k)
    _BOUNDS.append(_TOTAL)
_WEIGHT = " + ".join(f"(u > {b!r})::INT" for b in _BOUNDS)

ORACLES = {
    "x3_hash_bootstrap": f"""WITH d AS (SELECT doc_id, 1 - toxic - quality AS delta, unnest(range(1, 21)) AS resample FROM labels),
w AS (SELECT resample, delta, ('0x' || substr(sha256('7:' || resample || ':' || doc_id), 1, 13))::BIGINT / 4503599627370496 AS u FROM d)
SELECT 'a/b' AS family, resample::INT AS resample, round(sum(({_WEIGHT}) * delta) / sum({_WEIGHT}), 9) AS mean FROM w GROUP BY resample""",
    "a2_panels": "SELECT count(*) AS n_expected, count(l.doc_id) AS n_rows, coalesce(sum(quality), 0) / count(*) AS quality_rate, coalesce(sum(toxic), 0) / count(*) AS toxic_rate, coalesce(sum(quality + toxic), 0) / count(*) AS mean_sum FROM documents d LEFT JOIN labels l USING (doc_id)",
    "a3_trajectory_metrics": """WITH m AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type AS again FROM events)
SELECT user_id, count(*) AS n_events, count(*) FILTER (WHERE event_type <> 'error') AS n_steps, count(*) FILTER (WHERE event_type = 'error') AS n_guards, count(*) FILTER (WHERE event_type = 'view') AS n_searches,
  count(*) FILTER (WHERE event_type = 'click') AS n_opens, count(DISTINCT json_extract_string(props, '$.k')) FILTER (WHERE event_type = 'click') AS n_products, count(*) - count(DISTINCT event_type) AS n_duplicates,
  count(*) FILTER (WHERE again) AS n_consecutive, sum(length(props))::BIGINT AS total_size, max(length(props))::INT AS largest FROM m GROUP BY 1""",
    "a5_counters": "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1",
    "a6_collection_quality": """WITH t AS (SELECT o_custkey, o_custkey % 3 <> 0 AS e, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS g FROM orders GROUP BY 1, 2)
SELECT sum(n)::BIGINT AS raw_attempts, sum(g)::BIGINT AS raw_gold, round(sum(g) / sum(n), 4) AS raw_rate, sum(n) FILTER (WHERE e)::BIGINT AS eligible_attempts, sum(g) FILTER (WHERE e)::BIGINT AS eligible_gold,
  round(sum(g) FILTER (WHERE e) / sum(n) FILTER (WHERE e), 4) AS eligible_rate, count(*) FILTER (WHERE e) AS eligible_tasks, round(count(*) FILTER (WHERE e AND g > 0) / count(*) FILTER (WHERE e), 4) AS any_gold_rate FROM t""",
    "a7_reachability_summary": "SELECT p_brand, count(*) AS n_tasks, count(*) FILTER (WHERE p_size <= 30 AND p_size % 2 <> 0) AS n_eligible, nullif(count(*) FILTER (WHERE p_size > 30), 0) AS large, nullif(count(*) FILTER (WHERE p_size % 2 = 0), 0) AS even FROM part GROUP BY 1",
    "a10_distribution": """SELECT l_returnflag, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.9) AS p90, quantile_disc(l_quantity, 0.95) AS p95, quantile_disc(l_quantity, 0.99) AS p99,
  round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS deviation, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1""",
    "a12_histogram": f"SELECT bin::INT AS bin, (SELECT count(*) FROM lineitem WHERE l_discount * 20 - l_tax * 15 - 0.5 >= a AND l_discount * 20 - l_tax * 15 - 0.5 < b) AS n FROM (SELECT {_EDGES})",
    "a13_step_buckets": """SELECT CASE WHEN s <= 5 THEN '1-5' WHEN s <= 10 THEN '6-10' WHEN s <= 20 THEN '11-20' ELSE '21-35' END AS bucket, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS n_strict,
  round(100 * avg((l_returnflag = 'A')::INT), 2) AS strict_percent, round(avg(floor(l_extendedprice)), 4) AS mean_reward FROM (SELECT *, trunc(l_quantity)::INT AS s FROM lineitem) WHERE s BETWEEN 1 AND 35 GROUP BY 1""",
    "a14_most_common": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_tasks, row_number() OVER (ORDER BY count(*) DESC, event_type)::INT AS rank FROM events GROUP BY 1",
    "a15_agreement": """WITH s AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), c AS (SELECT coalesce(k, 0) AS k, count(*) AS n FROM customer LEFT JOIN s ON o_custkey = c_custkey GROUP BY 1)
SELECT r.k, coalesce(n, 0) AS n_tasks FROM (SELECT unnest(range(6)) AS k) r LEFT JOIN c USING (k)""",
    "a15_unanimous": """WITH s AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS k FROM orders WHERE o_totalprice > 100000 GROUP BY 1)
SELECT c_custkey, k IS NOT NULL AS succeeded FROM customer LEFT JOIN s ON o_custkey = c_custkey WHERE k IS NULL OR k = (SELECT count(DISTINCT o_orderstatus) FROM orders)""",
    "j6_paired_runs": f"WITH {_RUNS} SELECT doc_id, left_run, right_run, left_ok, right_ok FROM pairs",
    "j7_fully_paired": f"""WITH {_RUNS}, e AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0), a AS (SELECT doc_id FROM runs WHERE run = 'a'), c AS (SELECT doc_id FROM runs WHERE run = 'c')
SELECT doc_id, 'missing_left' AS problem FROM e WHERE doc_id NOT IN (FROM a) UNION ALL SELECT doc_id, 'missing_right' FROM e WHERE doc_id NOT IN (FROM c) UNION ALL SELECT doc_id, 'unexpected' FROM (FROM a UNION FROM c) WHERE doc_id NOT IN (FROM e)""",
    "a16_paired_deltas": f"""WITH {_RUNS} SELECT left_run, right_run, measure, count(*) AS n, round(avg(l), 6) AS left_mean, round(avg(r), 6) AS right_mean, round(avg(r - l), 6) AS mean_delta,
  count(*) FILTER (WHERE (r - l) * sign > 0) AS better, count(*) FILTER (WHERE r = l) AS equal, count(*) FILTER (WHERE (r - l) * sign < 0) AS worse FROM long WHERE l IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2, 3""",
    "a17_transitions": f"WITH {_RUNS} SELECT left_run, right_run, left_ok || '_to_' || right_ok AS change, count(*) AS n FROM pairs GROUP BY 1, 2, 3",
    "successions": """WITH n AS (SELECT event_type AS "left", lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "right" FROM events)
SELECT "left", "right", count(*) AS n FROM n WHERE "right" IS NOT NULL GROUP BY 1, 2""",
    "a18_truncation": """WITH u AS (SELECT user_id, bool_or(value > 300) AS truncated, count(*) FILTER (WHERE event_type = 'purchase') > 8 AS ok FROM events GROUP BY 1)
SELECT truncated, count(*) AS n, count(*) FILTER (WHERE ok) AS n_success, round(avg(ok::INT), 6) AS rate FROM u GROUP BY 1""",
    "a19_after_truncation": f"WITH {_TRUNCATED} SELECT count(*) FILTER (WHERE NOT g) AS executed, count(*) FILTER (WHERE g) AS guards, round(count(*) FILTER (WHERE g) / count(*), 6) AS guard_rate FROM t WHERE after",
    "a20_rollout_metrics": """SELECT count(*) AS n, round(avg(l_quantity), 6) AS quantity_mean, round(min(l_quantity), 6) AS quantity_min, round(max(l_quantity), 6) AS quantity_max, round(avg(l_tax), 6) AS tax_mean, round(min(l_tax), 6) AS tax_min,
  round(max(l_tax), 6) AS tax_max, round(avg((l_returnflag = 'R')::INT), 6) AS returned_rate FROM lineitem""",
    "a21_varying_groups": f"WITH {_GROUPS} SELECT * FROM g",
    "a22_accepted_groups": f"""WITH {_GROUPS} SELECT "group", row_number() OVER (ORDER BY "group")::INT AS place FROM g WHERE verdict = 'kept' ORDER BY "group" LIMIT 25""",
    "a23_collection_summary": "SELECT count(*) AS n, round(avg((o_totalprice > 200000)::INT), 6) AS gold_rate, round(avg((o_orderstatus = 'P')::INT), 6) AS infra_rate, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(DISTINCT o_orderpriority)::INT AS kinds FROM orders",
    "a24_merge_report": """WITH d AS (SELECT source, sha256(coalesce(text, '')) AS h, doc_id % 3 > 0 AS kept FROM documents), g AS (SELECT h FROM d GROUP BY 1 HAVING count(*) > 1)
SELECT source, count(*) AS n, count(*) FILTER (WHERE kept) AS n_kept, count(*) FILTER (WHERE NOT kept) AS n_dropped, count(DISTINCT h) FILTER (WHERE h IN (FROM g)) AS duplicate_groups FROM d GROUP BY 1""",
    "a26_id_hashes": "SELECT sha256('[' || string_agg(c_custkey::VARCHAR, ',' ORDER BY c_acctbal, c_custkey) || ']') AS ordered_sha256, sha256('[' || string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) || ']') AS set_sha256 FROM customer",
    "a27_running_projection": "SELECT event_id, sum(length(props)) OVER w::BIGINT AS size_so_far, max(length(props)) OVER w::INT AS largest_so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "a30_evaluation_facts": "SELECT o_custkey AS c_custkey, o_orderkey AS pos, CASE WHEN o_custkey % 5 > 0 THEN c_mktsegment END AS c_mktsegment, o_custkey % 5 = 0 OR c_custkey IS NULL AS missing, c_custkey IS NOT NULL AND o_custkey % 8 = 1 AS overlaps FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "x1_mcnemar": f"SELECT b, c, floor({_P} * 1000000 + 0.123)::BIGINT AS p_millionths FROM (SELECT i % 30 AS b, i // 30 AS c FROM (SELECT unnest(range(900)) AS i))",
    "x2_holm": """WITH q AS (SELECT p_partkey, p_brand, (p_partkey * 37 % 101) / 1000 AS p FROM part), s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY p_brand) - row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) + 1) * p) AS v FROM q)
SELECT p_partkey, round(max(v) OVER (PARTITION BY p_brand ORDER BY p, p_partkey ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM s""",
    "x4_paired_report": f"""WITH {_RUNS}, k AS (SELECT left_run, right_run, measure AS endpoint, CASE measure WHEN 'ok' THEN 'binary' ELSE 'continuous' END AS kind, count(*) AS n, count(*) FILTER (WHERE l > r) AS b, count(*) FILTER (WHERE l < r) AS c,
  avg(l) AS lm, avg(r) AS rm, avg(r - l) AS d FROM long WHERE l IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2, 3)
SELECT left_run, right_run, endpoint, kind, n, b, c, round(lm, 6) AS left_mean, round(rm, 6) AS right_mean, round(d, 6) AS difference, CASE kind WHEN 'binary' THEN round({_P}, 6) END AS p, CASE kind WHEN 'binary' THEN round({_P}, 6) END AS p_holm FROM k""",
    "x5_adjacent_families": "SELECT * FROM (SELECT o_orderpriority AS left_run, lead(o_orderpriority) OVER (ORDER BY o_orderpriority) AS right_run FROM (SELECT DISTINCT o_orderpriority FROM orders)) WHERE right_run IS NOT NULL",
    "d20_rollout_index": "SELECT l_orderkey, l_linenumber, l_partkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INT AS rollout FROM lineitem",
}
QUERIES = {name: globals()[name] for name in [*ORACLES, "x3_bootstrap"]}
