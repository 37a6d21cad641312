"""Metadata values are told apart by all of their text and by their column."""

from quillon.llm.quality_classifier import metadata_features


def places(*rows):
    return [set(p.tolist()) for p, _ in metadata_features([list(c) for c in zip(*rows, strict=True)])]


def test_common_endings_differ():
    a, b = places(["news.example.com"], ["shop.example.com"])
    assert len(a) == len(b) == 1 and a != b


def test_columns_differ():
    assert len(places(["a long value here", "a long value here"])[0]) == 2


def test_long_values():
    a, b = places(["x" * 300], ["y" + "x" * 299])
    assert a != b
