"""Readers, writers and streams over files."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from quillon.operators import gates, search
from quillon.sources import readers, writers
from quillon.streaming import logs, progress

ROW = StructType().add("task_id", LongType()).add("v", StringType())


def put(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_json_lines(spark, tmp_path):
    good = put(tmp_path / "a.jsonl", '{"task_id": 1, "v": "x"}', "", '{"task_id": 2}')
    assert sorted(readers.json_lines(spark, good, ROW).collect()) == [(1, "x"), (2, None)]
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as out:
        out.write('{"task_id": 3}\n')
    assert readers.json_lines(spark, str(tmp_path / "b.jsonl.gz"), ROW).first().task_id == 3
    bad = put(tmp_path / "c.jsonl", '{"task_id": 1}', "[1]", "{oops")
    with pytest.raises(Exception, match="FAILFAST|Malformed|MALFORMED"):
        readers.json_lines(spark, bad, ROW).collect()
    rows, faults = readers.json_lines_checked(spark, bad, ROW)
    assert rows.count() == 1 and sorted(r.value for r in faults.collect()) == ["[1]", "{oops"]


def test_keyed_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], ROW)
    assert readers.keyed(df, "task_id").count() == 2
    for rows, message in (([(1, "a"), (1, "b")], "key twice: 1"), ([(None, "a")], "without a key"), ([(9, "a")], "not allowed: 9")):
        with pytest.raises(Exception, match=message):
            readers.keyed(spark.createDataFrame(rows, ROW), "task_id", df).collect()


def test_id_files(spark, tmp_path):
    files = [put(tmp_path / "a.json", "[3, 1]"), put(tmp_path / "b.json", '{"task_ids": [3, 1]}'), put(tmp_path / "c.jsonl", '{"task_id": 3}', '{"extra_info": {"task_id": 1}}'), put(tmp_path / "d.txt", "3", "1")]
    for path in files:
        assert [r.task_id for r in readers.task_ids(spark, path).orderBy("pos").collect()] == [3, 1]
    with pytest.raises(ValueError, match="2 rows, 3 declared"):
        readers.task_facts(spark, put(tmp_path / "f.jsonl", '{"task_id": 1}', '{"task_id": 2}'), ROW, "task_id", 3)


def test_catalog_pins_and_runs(spark, tmp_path):
    path = put(tmp_path / "p.json", json.dumps([{"asin": "a", "v": "1"}, {"asin": "a", "v": "2"}, {"asin": "nan", "v": "3"}, {"asin": "x" * 21, "v": "4"}]))
    assert [tuple(r) for r in readers.catalog(spark, path, "asin string, v string").collect()] == [("a", "1")]
    sha = hashlib.sha256((tmp_path / "p.json").read_bytes()).hexdigest()
    assert readers.pinned(spark, path, sha).count() == 1
    with pytest.raises(ValueError, match="has sha256"):
        readers.pinned(spark, path, "0" * 64)
    for run, summary in (("one", True), ("two", False)):
        (tmp_path / "runs" / run).mkdir(parents=True)
        put(tmp_path / "runs" / run / "trajectories.jsonl", '{"task_id": 1}')
        if summary:
            put(tmp_path / "runs" / run / "summary.json", "{}")
    assert [(r.run, r.task_id) for r in readers.runs(spark, str(tmp_path / "runs"), ROW).collect()] == [("one", 1)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], ROW)
    writers.json_lines(df, f"{tmp_path}/j")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.json_lines(df, f"{tmp_path}/j")
    writers.append(df, f"{tmp_path}/j")
    assert readers.json_lines(spark, f"{tmp_path}/j", ROW).count() == 4
    writers.ordered_parquet(df, f"{tmp_path}/p", ["v", "task_id"], ["task_id"])
    assert spark.read.parquet(f"{tmp_path}/p").columns == ["v", "task_id"]
    targets = F.expr("transform(filter(array('outcome', 'process'), a -> task_id = 1 or a = 'process'), a -> struct(a as arm, 'train' as split))")
    writers.fan_out(df, f"{tmp_path}/f", targets)
    assert spark.read.json(f"{tmp_path}/f").groupBy("arm").count().orderBy("arm").collect() == [("outcome", 1), ("process", 2)]
    assert writers.if_identical(spark, {"b": 1, "a": "ö"}, f"{tmp_path}/s.json") and not writers.if_identical(spark, {"a": "ö", "b": 1}, f"{tmp_path}/s.json")
    assert (tmp_path / "s.json").read_text() == '{\n  "a": "ö",\n  "b": 1\n}\n'
    with pytest.raises(ValueError, match="something else"):
        writers.if_identical(spark, {}, f"{tmp_path}/s.json")
    with pytest.raises(FileExistsError):
        writers.json_object(spark, {}, f"{tmp_path}/s.json")
    writers.report(spark, "<script>d = __DATA__</script>", {"x": "</script>"}, f"{tmp_path}/r.html")
    assert (tmp_path / "r.html").read_text() == '<script>d = {"x": "<\\/script>"}</script>'


def test_search_index(spark, tmp_path):
    rows = [("a", "blue a-1 phone", "x"), ("b", "phone", "x"), ("a", "again", "x"), (None, "phone", "x"), (" ", "phone", "x")]
    df = spark.createDataFrame(rows, "asin string, title string, brand string").withColumn("pos", F.monotonically_increasing_id())
    index = search.postings(df, "asin", {"title": F.col("title"), "brand": F.col("brand")}, F.col("pos"))
    writers.search_index(index, f"{tmp_path}/i", 4)
    held = spark.read.parquet(f"{tmp_path}/i")
    asked = spark.createDataFrame([(1, "Blue PHONE"), (2, ""), (3, "absent")], "query_id long, query string")
    got = search.bm25(held, asked, {"title": 2.0, "brand": 1.0}, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.id) for r in got] == [(1, 1, "a"), (1, 2, "b")]
    for weights in ({"title": 1.0}, {"title": 1.0, "brand": 0}, {"title": float("nan"), "brand": 1}):
        with pytest.raises(ValueError):
            search.checked_weights(weights, ["title", "brand"])


ACTIONS = "session string, pos int, name string, argument string, visible array<string>, page string, options map<string,string>"


def actions():
    ids = [str(10_000_000 + k) for k in range(8)]
    walk = [("search", "phone", ids[:4], "search", None), ("click", ids[0], [ids[0]], "product_detail", {"color": "red"}), ("click", "features", [ids[0]], "information_subpage", {"color": "red"}), ("click", ids[0], [ids[0]], "product_detail", None)]
    loop = [("search", " Phone", ids[:2], "search", None), ("search", "phone", ids[:2], "search", None), ("search", "phone!", ids[:2], "search", None)]
    return [("s1", k, *a) for k, a in enumerate(walk)] + [("s2", k, *a) for k, a in enumerate(loop)]


def test_progress_by_batch_and_stream(spark, tmp_path):
    rows = actions()
    got = sorted(tuple(r) for r in progress.progress(spark.createDataFrame(rows, ACTIONS)).collect())
    assert got == [("s1", 1, 0, 0, 1, 0, 0, None), ("s1", 2, 0, 0, 1, 1, 0, None), ("s1", 3, 0, 0, 1, 1, 1, None), ("s1", 4, 0, 1, 1, 1, 1, None)] + [("s2", 1, 0, 1, 0, 0, 0, None), ("s2", 2, 1, 2, 0, 0, 0, None), ("s2", 3, 2, 3, 0, 0, 0, "repeat_loop")]
    for part, own in enumerate((rows[:2] + rows[4:5], rows[2:4] + rows[5:])):
        put_rows = [json.dumps(dict(zip(("session", "pos", "name", "argument", "visible", "page", "options"), r, strict=True))) for r in own]
        (tmp_path / "in").mkdir(exist_ok=True)
        put(tmp_path / "in" / f"{part}.json", *put_rows)
        stream = progress.progress_stream(logs.append_log(spark, str(tmp_path / "in"), ACTIONS))
        logs.append_diagnostics(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    out = spark.read.schema(progress.OUTPUT).json(f"{tmp_path}/out")
    assert sorted(tuple(r) for r in out.collect()) == got


def test_completion_index(spark, tmp_path):
    (tmp_path / "log").mkdir()
    put(tmp_path / "log" / "a.json", '{"k": "r1", "pos": 1, "status": "failed"}', '{"k": "r1", "pos": 2, "status": "done"}', '{"k": "r2", "pos": 3, "status": "failed"}')
    log = logs.append_log(spark, str(tmp_path / "log"), "k string, pos long, status string")
    logs.index_batches(log, f"{tmp_path}/index", f"{tmp_path}/c", "k", F.col("status") == "failed", "pos").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/index")
    assert sorted((r.k, r.status, r.n_completed) for r in got.collect()) == [("r1", "done", 1), ("r2", "failed", 0)]


def test_cache_by_input_hash(spark):
    inputs = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    cache = spark.createDataFrame([(1, hashlib.sha256(b"a").hexdigest(), "old"), (2, "stale", "old")], "k long, input_sha256 string, result string")
    hits, todo = logs.to_recompute(inputs, cache, "k", F.col("v"))
    assert [r.k for r in hits.collect()] == [1] and [r.k for r in todo.collect()] == [2]


def test_schemas_without_forbidden_fields(spark):
    kind = spark.createDataFrame([], "a int, b struct<Answer:int, c:array<struct<my_api_key:string>>>").schema
    assert gates.forbidden_fields(kind, {"answer"}, ("_api_key",)) == ["b.Answer", "b.c[].my_api_key"]
    assert gates.changed_fields({"a": 1, "b": None}, {"a": 2}) == ["a", "b"]
