"""What the queries' SQL doesn't ask of the evaluation operators."""

from pyspark.sql import functions as F

from quillon.operators import evaluation


def test_distribution(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(1, 201)], "g string, v double")
    r = evaluation.distribution(df, ["g"], "v").first()
    assert (r.least, r.most, r.p50, r.p90, r.p95, r.p99, r.median, r.mean) == (1, 200, 100, 180, 190, 198, 100.5, 100.5)
    assert abs(r.deviation - ((200**2 - 1) / 12) ** 0.5) < 1e-9


def test_last_row_wins(spark):
    rows = spark.createDataFrame([(1, 1, True, 5), (1, 2, False, 7), (2, 1, False, 1), (2, 3, True, 4), (9, 1, True, 100)], "task int, at int, ok boolean, v int")
    r = evaluation.fixed_denominator(spark.createDataFrame([(1,), (2,), (3,), (4,)], "task int"), rows, "task", F.col("ok"), F.col("v"), ["at"]).first()
    assert (r.n_expected, r.n_completed, r.n_success, r.success_rate, r.mean_value) == (4, 2, 1, 0.25, 5.5)


def test_unanimous(spark):
    rows = spark.createDataFrame([(1, "a", True), (1, "b", True), (2, "a", True), (2, "b", False), (3, "a", False)], "task int, run string, ok boolean")
    tasks = spark.createDataFrame([(1,), (2,), (3,), (4,)], "task int")
    got = evaluation.unanimous(rows, tasks, "task", "run", F.col("ok")).collect()
    assert sorted((r.task, r.succeeded) for r in got) == [(1, True), (3, False), (4, False)]
