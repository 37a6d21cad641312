"""Queries over the driver's tables, one for each operator, with DuckDB SQL of the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import evaluation, ranking
from quillon.plans import measures, rewards, selection, texts


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def d1_latest(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return ranking.latest(e, ["user_id", "event_type"], F.col("ts"), F.col("event_id")).select("user_id", "event_type", "event_id")


def d3_first(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return ranking.first_by(o, ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


def d9_stratified_split(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return ranking.stratified_split(c, "c_custkey", "c_mktsegment", 70, 20, 7)


def a1_fixed_denominator(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", F.col("o_orderkey").alias("k"))
    return evaluation.fixed_denominator(_t(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", F.col("o_orderstatus") == "F", F.lit(1))


def a4_repeats(spark, sf_dir):
    return evaluation.repeats(_t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")


def d21_paged(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ranking.paged(o, "o_custkey", 5, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "rank", "page", "total_pages")


QUERIES = {f.__name__: f for f in (d1_latest, d3_first, d9_stratified_split, a1_fixed_denominator, a4_repeats, d21_paged)} | selection.QUERIES | measures.QUERIES | texts.QUERIES | rewards.QUERIES

_QUOTA = "({total} * n) // of + (row_number() OVER (ORDER BY ({total} * n) % of DESC, s) <= {total} - sum(({total} * n) // of) OVER ())::BIGINT"

ORACLES = selection.ORACLES | measures.ORACLES | texts.ORACLES | rewards.ORACLES | {
    "d1_latest": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "d3_first": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
    "d9_stratified_split": f"""
WITH z AS (SELECT c_mktsegment AS s, count(*) AS n, (SELECT count(*) FROM customer) AS of FROM customer GROUP BY 1),
t AS (SELECT s, n, {_QUOTA.format(total=70)} AS tq FROM z),
l AS (SELECT s, tq, n - tq AS n, (SELECT sum(n - tq) FROM t) AS of FROM t),
q AS (SELECT s, tq, {_QUOTA.format(total=20)} AS dq FROM l),
r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7:' || c_mktsegment || ':' || c_custkey)) AS p FROM customer)
SELECT c_custkey, c_mktsegment, CASE WHEN p <= tq THEN 'train' WHEN p <= tq + dq THEN 'dev' ELSE 'reserve' END AS split FROM r JOIN q ON s = c_mktsegment""",
    "a1_fixed_denominator": """
WITH f AS (SELECT o_custkey, max((o_orderstatus = 'F')::INT) AS ok, count(*) AS v FROM orders GROUP BY 1)
SELECT count(*) AS n_expected, count(ok) AS n_completed, coalesce(sum(ok), 0)::BIGINT AS n_success, coalesce(sum(ok), 0) / count(*) AS success_rate, avg(v) AS mean_value
FROM customer LEFT JOIN f ON o_custkey = c_custkey""",
    "a4_repeats": """
WITH m AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type AS again FROM events)
SELECT user_id, count(*) AS n, count(*) - count(DISTINCT event_type) AS duplicates, count(*) FILTER (WHERE again) AS consecutive FROM m GROUP BY 1""",
    "d21_paged": """
SELECT o_orderkey, r::INT AS rank, ((r + 4) // 5)::INT AS page, ((count(*) OVER (PARTITION BY o_custkey) + 4) // 5)::INT AS total_pages
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)""",
}
