"""Top-k against brute force: large scores, blocks of queries, odd rows."""

import math
import random

import pytest

from quillon.llm import topk_search


def brute(rows, queries, k):
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and fine(v)]
    out = []
    for q, v in whole:
        if q in queries:
            near = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("size", "block"), [(1.0, 1 << 15), (1.0, 3), (4e5, 1 << 15)])
def test_results_are_those_of_brute_force(spark, size, block):
    r = random.Random(5)
    rows = [(k, [r.uniform(-size, size) for _ in range(40)]) for k in range(120)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, [1.0, None]), (204, [float("nan")] * 40), (205, [float("inf")] * 40), (206, []), (207, [2.0, 3.0]), (210, [1.0, -1.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = topk_search.top_k(df, df.where("vec_id % 10 = 0"), 5, 256, query_block=block, chunk=50).collect()
    assert sorted(tuple(x) for x in got) == brute(rows, {k for k in range(0, 300, 10)}, 5)
    assert topk_search.top_k(df, df.where("false")).count() == 0 and topk_search.top_k(df.where("false"), df).count() == 0


def test_scores_above_2_to_53(spark):
    rows = [(0, [1e6, 1e6]), (1, [1e6, 1e6 + 1 / 256]), (2, [1e6 + 1 / 256, 1e6])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>"), 2).collect()
    assert sorted(tuple(x) for x in got) == brute(rows, {0}, 2)
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk_search.top_k(*[spark.createDataFrame([(0, [1e15]), (1, [1e15])], "vec_id long, embedding array<double>")] * 2, 2).collect()
