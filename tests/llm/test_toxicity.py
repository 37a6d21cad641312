"""The field against enumeration, and offending places in characters."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import toxicity


def enumerate_chain(evidence, chain):
    """(log of the sum, marginals, expected pairs) over all labellings after a clean label."""
    total, one, pairs = 0.0, np.zeros(len(evidence)), np.zeros((2, 2))
    for labels in itertools.product((0, 1), repeat=len(evidence)):
        steps = list(zip((0, *labels), labels))
        w = np.exp(sum(e * y for e, y in zip(evidence, labels)) + sum(chain[i, j] for i, j in steps))
        total += w
        one += w * np.array(labels)
        for i, j in steps:
            pairs[i, j] += w
    return np.log(total), one / total, pairs / total


@pytest.fixture
def chain():
    return np.array([[0.7, -1.1], [0.2, 0.4]])


def test_marginals_and_pairs(chain):
    r = np.random.default_rng(3)
    lengths = [6, 1, 4, 9]
    e = [r.normal(size=n) * 2 for n in lengths]
    wanted = [enumerate_chain(x, chain) for x in e]
    padded, keep = np.zeros((4, 9)), np.zeros((4, 9), bool)
    for k, x in enumerate(e):
        padded[k, : len(x)], keep[k, : len(x)] = x, True
    p, pairs = toxicity._forward_backward(padded, keep, chain)
    assert np.allclose(pairs, sum(w[2] for w in wanted))
    flat = toxicity.marginals(np.concatenate(e), np.concatenate([[0], np.cumsum(lengths)]), chain, block=4)
    for k, w in enumerate(wanted):
        at = sum(lengths[:k])
        assert np.allclose(p[k, : lengths[k]], w[1]) and np.allclose(flat[at : at + lengths[k]], w[1])


def test_gradient_of_the_likelihood(chain):
    e = np.array([0.5, -1.0, 2.0, 0.1])
    tags = (0, 1, 1, 0)

    def likelihood(c):
        return sum(x * y for x, y in zip(e, tags)) + sum(c[i, j] for i, j in zip((0, *tags), tags)) - enumerate_chain(e, c)[0]

    _, expected = toxicity._forward_backward(e[None], np.ones((1, 4), bool), chain)
    seen = np.zeros((2, 2))
    for i, j in zip((0, *tags), tags):
        seen[i, j] += 1
    for i, j in itertools.product((0, 1), repeat=2):
        move = np.zeros((2, 2))
        move[i, j] = 1e-5
        slope = (likelihood(chain + move) - likelihood(chain - move)) / 2e-5
        assert slope == pytest.approx((seen - expected)[i, j], abs=1e-6)


def test_places_are_characters(spark):
    r = np.random.default_rng(1)
    word = lambda: "".join(r.choice(list("abcdefghijé"), 6))
    clean = [" ".join(word() for _ in range(60)) for _ in range(200)]
    toxic = [" ".join(word() for _ in range(30)) + " vilewört " + " ".join(word() for _ in range(30)) for _ in range(100)]
    model = toxicity.fit(pa.array(clean + toxic), np.array([0] * 200 + [1] * 100))
    long = "ééé 𓀀 " + "aé " * 400_000 + "Vilewört ö"
    texts = ["ö𓀀 vilewört, é", "nothing", long, None, ""]
    out = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    found = {x.doc_id: [texts[x.doc_id][s.start : s.end] for s in x.spans] for x in out}
    assert found == {0: ["vilewört"], 1: [], 2: ["Vilewört"], 3: [], 4: []}
