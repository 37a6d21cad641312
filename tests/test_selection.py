"""Edges of splits, quotas, components and checked joins."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import evaluation, goals, leakage, ranking, reward, sets, statistics


def strata(spark, **sizes):
    return spark.createDataFrame([(s, f"{s}{k}") for s, n in sizes.items() for k in range(n)], "s string, id string")


def test_all_rows_can_be_train(spark):
    got = ranking.stratified_split(strata(spark, a=3, b=5), "id", "s", 8, 0, 1).groupBy("split").count().collect()
    assert [tuple(r) for r in got] == [("train", 8)]


def test_quotas_stay_within_strata(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 5), ("c", 0)], "s string, n long")
    assert {r.s: r.quota for r in ranking.quotas(sizes, "s", 6).collect()} == {"a": 1, "b": 5, "c": 0}
    with pytest.raises(Exception, match="9 of 6 rows"):
        ranking.quotas(sizes, "s", 9).collect()
    assert ranking.quotas(sizes.where("false"), "s", 0).collect() == []


def test_a_chain_of_keys_is_one_component(spark):
    keys = [(k, f"x:{k // 2}") for k in range(0, 40)] + [(k, f"y:{(k + 1) // 2}") for k in range(0, 40)] + [(99, "z:alone")]
    got = {r.task: r.root for r in leakage.leakage_components(spark.createDataFrame(keys, "task long, key string")).collect()}
    assert got == {k: 0 for k in range(40)} | {99: 99}


def test_allocation_takes_whole_components(spark):
    pool = spark.createDataFrame([(k, k // 4 * 4, "easy" if k % 2 else "hard") for k in range(40)], "task long, root long, difficulty string")
    got = leakage.allocate(pool, [("a", 6), ("b", 10)], 3).collect()
    roots = {s: {r.task // 4 for r in got if r.split == s} for s in ("a", "b")}
    assert sum(r.split == "a" for r in got) == 6 and sum(r.split == "b" for r in got) == 10 and not roots["a"] & roots["b"]
    with pytest.raises(ValueError, match="split a needs"):
        leakage.allocate(pool, [("a", 41)], 3)


def test_joins_refuse_missing_and_repeated_keys(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(Exception, match="no row of k 2"):
        sets.join_all(left.where("k = 2"), right, "k").collect()
    with pytest.raises(Exception, match="several rows of k 1"):
        sets.join_all(left.where("k = 1"), right, "k").collect()
    assert goals.assembled(left.where("k = 1"), {"m": right.where("v = 'x'")}, "k").first().m.v == "x"


def test_panels_refuse_unexpected_rows(spark):
    rows = spark.createDataFrame([(1, True), (3, True)], "k long, ok boolean")
    with pytest.raises(Exception, match="unexpected"):
        evaluation.panels(spark.createDataFrame([(1,), (2,)], "k long"), rows, "k", {"r": F.col("ok")}, {}).collect()


def test_batches_of_groups(spark):
    made = lambda *v: spark.createDataFrame([(f"g{k}", k, x) for k, x in enumerate(v)], "group string, first long, verdict string")
    batches = [made("kept", "constant_reward", "kept"), made("constant_reward"), made("kept", "kept")]
    assert evaluation.accept_in_batches(batches, 3) == ([["g0", "g2"], [], ["g0"]], 0)
    with pytest.raises(ValueError, match="in a row"):
        evaluation.accept_in_batches([made("constant_reward")] * 3, 3, most_skips=2)


@pytest.mark.parametrize(("b", "c", "p"), [(0, 0, 1.0), (0, 5, 0.0625), (1, 5, 0.21875), (16, 9, 0.2295), (6, 7, 1.0), (9, 12, 0.6636), (0, 135, 0.0), (3000, 3100, 0.205)])
def test_mcnemar(spark, b, c, p):
    got = spark.range(1).select(statistics.mcnemar(F.lit(b), F.lit(c)).alias("p")).first().p
    assert got == pytest.approx(p, abs=1e-3 if p not in (0.0625, 0.21875) else 1e-12)


def test_bootstrap_repeats():
    assert statistics.bootstrap_interval([1.0, 0.0, -1.0, 1.0], 5, 100) == statistics.bootstrap_interval([1.0, 0.0, -1.0, 1.0], 5, 100)


def test_goals_are_numbered(spark):
    rows = [("p2", 2, [("预算100元", ["a"], []), ("none", [], [])]), ("p1", 1, [("x", ["b"], ["o"]), ("y", ["c"], [])]), ("p0", 0, None)]
    products = spark.createDataFrame(rows, "asin string, pos int, i array<struct<instruction:string,attributes:array<string>,options:array<string>>>")
    got = sorted((r.task_id, r.asin, r.instruction, r.price_upper) for r in goals.goals(products, "asin", "pos", "i").collect())
    assert got == [(0, "p1", "x", None), (1, "p1", "y", None), (2, "p2", "预算100元", 100.0)]


def test_fixed_rewards_refuse_other_reasons(spark):
    assert spark.range(1).select(reward.fixed_reward(F.lit("max_steps")).alias("r")).first().r == -0.5
    with pytest.raises(Exception, match="no fixed reward"):
        spark.range(1).select(reward.fixed_reward(F.lit("x"))).collect()


def test_rubric_candidates(spark):
    rows = [(1, "想要防水蓝牙耳机，红色，不超过300元", "数码›耳机", ["牌"], ["防水", " 防水 ", "蓝牙"], {"color": "红色"}), (2, "x", None, [], None, None)]
    tasks = spark.createDataFrame(rows, "task long, q string, c string, b array<string>, f array<string>, o map<string,string>")
    got = reward.rubric_candidates(tasks, "q", "c", {"brand": "b", "core_function": "f"}, "o").orderBy("candidate_id").collect()
    assert [(r.candidate_id, r.kind, r.value, [(s.start, s.end) for s in r.spans]) for r in got] == [
        ("c0001", "category", "数码›耳机", [(6, 8)]), ("c0002", "brand", "牌", []), ("c0003", "core_function", "防水", [(2, 4)]), ("c0004", "core_function", "蓝牙", [(4, 6)]),
        ("c0005", "option", "红色", [(9, 11)]), ("c0006", "budget_upper", "300.0", [(12, 19)]),
    ]


def test_features(spark):
    row = spark.createDataFrame([("want X12 and A-9 widget", ["a  b", "a b", ""], "Widget x12", "shop", "")], "i string, a array<string>, t string, s string, d string")
    got = row.select(reward.features(F.col("i"), F.col("a"), F.col("t"), F.col("s"), F.col("d"), {}).alias("f")).first().f
    assert (got.expected_brand, got.expected_model, got.expected_core_functions) == ([], ["x12"], ["a b"])
