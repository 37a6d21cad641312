"""Near-duplicates against brute force, in blocks of any size, and odd rows."""

import random

import numpy as np
import pytest

from quillon.llm import near_dedup

SCHEMA = "doc_id long, text string, n long, v long, node long, component string"


def table(spark, rows):
    return spark.createDataFrame([(k, t, 1, 2, 3, "x") for k, t in rows], SCHEMA)


def shingles(text, size):
    words = (text or "").lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    """(id, component) by comparing all rows with all."""
    sets = [shingles(t, size) for _, t in rows]
    up = {k: k for k, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                up[y] = x
    return {k: find(k) for k in up}


def family(r, n, words, changes):
    base = [f"w{r.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(r.randint(0, changes)):
            own[r.randrange(words)] = f"x{r.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("size", "percent", "blocks"), [(3, 85, {}), (5, 80, {}), (3, 85, {"sketches": 16, "sets": 8, "hashes": 2000}), (5, 80, {"sketches": 8, "sets": 8})])
def test_components_are_those_of_brute_force(spark, size, percent, blocks):
    r = random.Random(11)
    texts = [t for changes in (1, 2, 3, 6) for t in family(r, 40, 80, changes)] + family(r, 30, 400, 12) + ["one", "One", "two words", "", None, " \n", "a b c", "A b\tc"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    found = near_dedup.near_components(table(spark, rows), size=size, percent=percent, **blocks).collect()
    assert {x.id: x.component for x in found} == brute(rows, size, percent)
    assert {x.id: x.n_shingles for x in found} == {k: len(shingles(t, size)) for k, t in rows}
    assert all(x.kept == (x.id == x.component) for x in found)


def test_rows_that_share_an_id_are_one_document(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(1, x), (2, x), (2, y), (3, y), (3, ""), (4, z), (4, z), (None, z), (None, None)]
    found = near_dedup.near_components(table(spark, rows), size=3, percent=85).collect()
    assert sorted((f.id or 0, f.component or 0, f.kept) for f in found) == [(0, 0, True)] * 2 + [(1, 1, True)] + [(2, 1, False)] * 2 + [(3, 1, False)] * 2 + [(4, 4, True)] * 2
    assert near_dedup.near_components(table(spark, rows).where("false")).count() == 0


def test_a_very_long_text_and_its_copy(spark):
    r = random.Random(2)
    long = " ".join(f"w{r.randint(0, 10**7)}" for _ in range(250_000))
    found = near_dedup.near_components(table(spark, [(5, long), (3, long.replace(" ", "\n") + " end"), (4, long[: len(long) // 2])]))
    assert sorted((f.id, f.component) for f in found.collect()) == [(3, 3), (4, 4), (5, 3)]


def test_overlaps_and_estimates():
    r = np.random.default_rng(1)
    sets = lambda n, most: [np.unique(r.integers(0, most, r.integers(0, 40))) for _ in range(n)]
    a, b, k = sets(50, 60), sets(50, 90), 16
    assert (near_dedup.overlaps(a, b) == [[len({*x} & {*y}) for y in b] for x in a]).all()
    union = [sorted({*x} | {*y})[:k] for x, y in zip([x[:k] for x in a], [y[:k] for y in b], strict=True)]
    wanted = [len({*u} & {*x[:k]} & {*y[:k]}) / max(1, len(u)) for u, x, y in zip(union, a, b, strict=True)]
    assert np.allclose(near_dedup._estimates([x[:k] for x in a], [y[:k] for y in b], k), wanted)
