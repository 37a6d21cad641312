"""Lines and passages against plain loops, with odd rows and clashing names."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import line_dedup, unit_dedup

SCHEMA = "doc_id long, text string, removed_lines string, n_lines int, line_dedup int, removed int, runs int, id int, th int"


def table(spark, texts):
    return spark.createDataFrame([(k, t, "a", 1, 2, 3, 4, 5, 6) for k, t in texts], SCHEMA)


def lines_left(texts, window, long_line):
    """id: text; a line goes if it stands in a window of worded lines that stands earlier, or is long and stands earlier."""
    seen, out = set(), {}
    for k, t in sorted(texts):
        if t is None:
            out[k] = None
            continue
        lines = t.split("\n")
        held = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\f\r")]
        gone = set()
        for p, i in enumerate(held):
            marks = [("line", lines[i])] if len(re.findall(r"[^\x20\x09-\x0D]+", lines[i])) >= long_line or window == 1 else []
            run = held[p : p + window]
            if len(run) == window:
                marks.append(("run", *[lines[j] for j in run]))
            for m in marks:
                if m in seen:
                    gone |= {i} if m[0] == "line" else set(run)
                seen.add(m)
        out[k] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize(("window", "long_line"), [(1, 5), (2, 4), (3, 5), (3, 100), (5, 6)])
def test_lines_that_go(spark, window, long_line):
    r = random.Random(window)
    line = lambda: " ".join(r.choice("abc") for _ in range(r.choice([0, 1, 1, 2, 6])))
    texts = [(k, "\n".join(line() for _ in range(r.randint(0, 30)))) for k in range(60)] + [(70, None), (71, ""), (72, "\n \n"), (73, "p f q\nx\ny"), (74, "p f q\nx\nz\nx\nz\nx")]
    rows = table(spark, texts)
    got = line_dedup.dedup_lines(rows, window, long_line)
    assert got.columns == [*rows.columns, "line_dedup_"]
    assert {x.doc_id: x.text for x in got.collect()} == lines_left(texts, window, long_line)
    assert line_dedup.dedup_lines(rows.where("false"), window, long_line).count() == 0


def test_repeated_rows_keep_alike(spark):
    texts = [(2, "one two three four five"), (2, "one two three four five"), (2, "other\none two three four five"), (None, "one two three four five"), (5, "one two three four five")]
    got = sorted(((x.doc_id or 0, x.text, x.line_dedup_.n_lines) for x in line_dedup.dedup_lines(table(spark, texts)).collect()))
    first = (0, "one two three four five", 1)
    assert first in got and (5, "", 1) in got and len(got) == 5 and [x[1] for x in got if x[0] == 2] == ["", "", "other"]


def passages_left(texts, least):
    seen, out = set(), {}
    for k, t in sorted(texts):
        if t is None:
            out[k] = None
            continue
        units = re.findall(r"[^.!?\n]+[.!?\n]*|[.!?\n]+", t)
        plain = [" ".join(re.sub(r"[^\w]|_", " ", u.lower()).split()) for u in units]
        counted = [i for i, p in enumerate(plain) if p]
        again = []
        for i in counted:
            again.append(plain[i] in seen)
            seen.add(plain[i])
        gone, at = set(), 0
        while at < len(counted):
            stop = at
            while stop < len(counted) and again[stop]:
                stop += 1
            if stop > at and sum(len(plain[i].split()) for i in counted[at:stop]) >= least:
                gone |= set(range(counted[at], counted[stop - 1] + 1))
            at = max(stop, at + 1)
        out[k] = "".join(u for i, u in enumerate(units) if i not in gone)
    return out


def test_passages_that_go(spark):
    r = random.Random(9)
    unit = lambda: " ".join(r.choice(["ab", "Cd", "é"]) for _ in range(r.choice([1, 2, 3]))) + r.choice([". ", "!\n", "...", "\n\n", "? "])
    texts = [(k, "".join(unit() for _ in range(r.randint(0, 15)))) for k in range(60)] + [(70, None), (71, ""), (72, "...")]
    rows = table(spark, texts)
    got = unit_dedup.dedup_passages(rows)
    assert got.columns == [*rows.columns, "removed_"]
    found = got.collect()
    assert {x.doc_id: x.text for x in found} == passages_left(texts, 5)
    of = dict(texts)
    for x in found:  # the spans are what is missing
        kept, at = "", 0
        for s in x.removed_:
            kept += of[x.doc_id][at : s.start]
            at = s.end
        assert x.text is None or kept + of[x.doc_id][at:] == x.text
    assert unit_dedup.dedup_passages(rows.where("false")).count() == 0


def test_a_very_long_line_and_text(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    got = line_dedup.dedup_lines(table(spark, [(1, long), (2, f"own\n{long}")])).select("doc_id", F.length("text").alias("n")).collect()
    assert {x.doc_id: x.n for x in got} == {1: len(long), 2: 3}
