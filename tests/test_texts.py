"""Forms of text whose SQL would have the same gaps, against strings worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import hooks, prices, text


def one(spark, value, made):
    return spark.createDataFrame([(value,)], "s string").select(made(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize(
    ("made", "value", "wanted"),
    [
        (text.alnum_text, " Straße Ｎo.５ ", "strasseno5"),
        (text.alnum_text, None, ""),
        (text.query_template, "Ａ 12.5 cm_x 中文!", "a<num>cm_x中文"),
        (text.plain_text, "  Große　 Maße ", "grosse masse"),
        (text.option_text, "Blau / ＸＬ", "blau|xl"),
        (text.normal_query, "耳机，100 CNY！人民币", "耳机 100元 元"),
        (lambda c: F.array_join(text.search_tokens(c), " "), "蓝牙耳 a-1 耳 a-1", "蓝牙 牙耳 耳 a-1"),
        (text.option_axis, "颜色 分类", "color"),
        (text.option_axis, "Ｌänge", "länge"),
        (text.budget, "预算1万2左右", 13200.0),
        (text.budget, "价格10-20元", 20.0),
        (text.budget, "预算4k+", None),
        (text.budget, "不超过3千元", 3000.0),
        (text.budget, "", None),
        (lambda c: text.compact(c, 2), "abc", "a…"),
    ],
)
def test_forms(spark, made, value, wanted):
    assert one(spark, value, made) == (pytest.approx(wanted) if isinstance(wanted, float) else wanted)


def test_stated_prices(spark):
    found = one(spark, "不超过1万2元，或100-200元，300元以上，50元左右", prices.price_candidates)
    assert [(p.kind, p.low, p.high) for p in found] == [("budget_upper", 12000, 12000), ("price_range", 100, 200), ("price_lower", 300, 300), ("price_preference", 50, 50)]
    assert prices.stated_prices(None) == [] and prices.stated_prices("价格200-100元") == []


def test_brands(spark):
    row = spark.createDataFrame([("想要小米手机 abc", "小米 14", "小米官方旗舰店")], "i string, t string, s string")
    assert row.select(text.brands(F.col("i"), F.col("t"), F.col("s"), {"mi": "xiaomi", "abc": "abc"}).alias("b")).first().b == ["小米"]


def test_hooks(spark):
    count = hooks.token_counter(lambda t: len(t.split()))
    rows = spark.createDataFrame([(1, "a b c"), (2, None)], "k long, s string")
    assert [r.n for r in rows.orderBy("k").select(count(F.col("s")).alias("n")).collect()] == [3, 0]

    def call(prompts):
        if any(p and "fail" in p for p in prompts):
            raise TimeoutError("late")
        return ['{"score": 2}' if p else "oops" for p in prompts]

    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "fail")], "k long, s string")
    got = {r.k: (r.answer.score if r.answer else None, r.error) for r in hooks.judged(rows, "k", "s", call, "score int", 1).collect()}
    assert got == {1: (2, None), 2: (None, "not JSON"), 3: (None, "TimeoutError: late")}
