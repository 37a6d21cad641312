"""The pipeline on planted documents, against texts worked out by hand."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm.queries import tokenizer_path


def test_planted_documents(spark, tmp_path):
    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(4, 9))) for _ in range(n))
    plain = words(120)
    near = plain.split(" ")
    near[60] = "changed"
    run = "\n".join(words(9) for _ in range(4))
    lines = "\n".join(words(20) for _ in range(4))
    passage = f"{words(20)}. {words(20)}. {words(20)}."
    a, b = words(80), words(80)
    texts = {1: plain, 2: plain, 3: " ".join(near), 4: "too short", 5: None, 6: f"{lines}\n{run}", 7: f"{words(90)}\n{run}\nend of it", 8: f"{a}. {passage}", 9: f"{b}. {passage}"}
    wanted = {1: texts[1], 6: texts[6], 7: texts[7].replace(f"{run}\n", ""), 8: texts[8], 9: f"{b}."}
    rows = [(k, t, "en", None if k == 6 else "s", None if t is None else len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("removed_lines", F.lit(1)).withColumn("removed", F.lit(2)).withColumn("kept", F.lit(3))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    assert {r.doc_id: r.text for r in docs.collect()} == wanted
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    pieces = {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(p.doc_id, []).append(p)
    own = Tokenizer.from_file(tokenizer_path())
    assert set(pieces) == set(wanted)
    for k, t in wanted.items():
        ids = [*own.encode(t, add_special_tokens=False).ids, 1]
        for p in pieces[k]:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        assert sum(p.length for p in pieces[k]) == len(ids)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
