"""Selected lines: each text is cut once, and long lines are those with so many words."""

import re

import pytest

from quillon.llm import line_dedup

LINES = ["a", " \x0b a\tb ", "a  b\x0cc\rd e", " a b c d", "é f g h i j k", "\t", "", "w " * 150, "x" * 300 + " y"]


@pytest.mark.parametrize("window", [1, 3])
def test_texts_are_cut_once_a_pass(spark, window):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = line_dedup._places(docs, window, 5, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1


def test_lines_are_shuffled_once_and_their_marks_once(spark):
    texts = ["one two three four five\nx\ny\nz"] * 2 + ["one two three four five\nu\nv\nw"] * 2 + [f"one two three four five\n{k}" for k in range(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = line_dedup.repeated_runs(docs)
    assert len(found.collect()) == 12
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("split(text") == 2


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 100, 101, 150, 151, 3000])
def test_long_lines(spark, n):
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(LINES)] + [(99, None)], "doc_id long, text string")
    got = {r.id for r in line_dedup._places(docs, 2, n, "doc_id", "text").collect() if r.around[-1]}
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in LINES]
    assert got == {k for k, w in enumerate(words) if w and w >= n}


def test_lines_of_a_text_are_numbered_once(spark):
    """Numbers worked out inside the lambda over runs would take the square of a text's lines."""
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    for_each_line = plan.split("sequence(lambda")[1].split("+- ")[0]
    assert "numbers" in for_each_line and "trim(" not in for_each_line


@pytest.mark.parametrize("window", [1, 3])
def test_counted_lines(spark, window):
    texts = ["", "\n", "é", "a\n\nb\n", "one two three four five\n\n", "one two three four five\n\n", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.line_dedup.n_lines) for r in line_dedup.dedup_lines(docs, window).collect()}
    assert got == {k: ("\n" if k == 5 else t, 0 if t is None else t.count("\n") + 1) for k, t in enumerate(texts)}
