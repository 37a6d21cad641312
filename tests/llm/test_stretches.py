"""The field is fitted on every telling token of a document."""

import numpy as np

from quillon.llm.toxicity import _stretches


def test_all_telling_tokens_are_in_one_stretch():
    found = np.zeros(2000, bool)
    found[[0, 10, 20, 45, 60, *range(100, 2000, 90), 1999]] = True
    times = np.zeros(len(found), int)
    for a, b in _stretches(found, 7):
        assert 0 < b - a <= 33
        times[a:b] += 1
    assert times.max() == 1 and (times[found] == 1).all()


def test_documents_without_telling_tokens():
    assert 1 <= len(_stretches(np.zeros(500, bool), 7)) <= 3
    assert _stretches(np.zeros(0, bool), 7) == []
