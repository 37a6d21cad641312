"""The pipeline's stages leave no repeat that they are there to remove."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def staged(spark, stage, texts):
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in texts]
    found = stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)
    return sorted(((r.doc_id, r.text) for r in found), key=repr)


def test_single_repeated_lines_go(spark):
    texts = [(1, "one line\nshared line\nthe end"), (2, "shared line"), (3, "own line\n\nshared line\nlast"), (4, "own pair\none line\nthe end\nown again\nown again"), (5, ""), (6, None)]
    wanted = [(1, texts[0][1]), (3, "own line\n\nlast"), (4, "own pair\nown again"), (5, ""), (6, None)]
    assert staged(spark, corpus_pipeline.lines, texts) == sorted(wanted, key=repr)


def test_repeated_sentences_and_lists_go(spark):
    menu = "Tea.\nRed soup.\nBread.\nCold milk.\n"
    first = f"Only here one. A sentence of six words here. {menu}See www.example.org now."
    texts = [(1, first), (2, "Second opening words. A sentence of six words here. Second end."), (3, f"Third opening words.\n{menu}Read www.example.net too.")]
    wanted = [(1, first), (2, "Second opening words. Second end."), (3, "Third opening words.\nRead www.example.net too.")]
    got = staged(spark, corpus_pipeline.passages, texts)
    assert [(k, t.replace("  ", " ")) for k, t in got] == wanted


def test_one_row_of_each_group_stays(spark):
    r = random.Random(5)
    plain, other, apart, near = ([f"w{r.randint(0, 10**6)}" for _ in range(80)] for _ in range(4))
    changed = [*near[:40], "changed", *near[41:]]
    plain, other, apart, near, changed = (" ".join(w) for w in (plain, other, apart, near, changed))
    texts = [(1, plain), (1, plain), (None, plain), (2, plain), (None, other), (None, other), (3, apart), (3, near), (4, changed), (None, changed), (5, None), (None, "")]
    got = staged(spark, corpus_pipeline.near_duplicates, texts)
    assert [t for _, t in got].count(plain) == 1 and (1, plain) in got
    assert [t for _, t in got].count(other) == 1
    assert (3, apart) in got or (3, near) in got
    assert sum(t in (near, changed) for _, t in got) == 1 and (3, apart) in got
    assert (5, None) in got and (None, "") in got and len(got) == 6
