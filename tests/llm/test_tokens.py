"""Token files and packing: every id is there once, in order."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillon.llm import packing, queries, token_store, tokens

SF = "/root/testdata/sf0.001"


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def ids(spark):
    rows = queries.table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    own = Tokenizer.from_file(queries.tokenizer_path())
    return {r.doc_id: own.encode(r.text or "", add_special_tokens=False).ids for r in rows}


def test_token_store(spark, ids):
    start, wanted = 0, []
    for doc_id, own in ids.items():
        wanted.append((doc_id, start, len(own) + 1, crc([*own, 2])))
        start += len(own) + 1
    assert sorted(tuple(r) for r in queries.op3_token_store(spark, SF).collect()) == wanted


def test_packing(spark, ids):
    rows = queries.op9_packing(spark, SF).collect()
    seen = {k: 0 for k in ids}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = [*ids[r.doc_id], 1]
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(own)
        assert r.ids_crc32 == crc(own[r.start : r.start + r.length])
        seen[r.doc_id] += r.length
    assert seen == {k: len(v) + 1 for k, v in ids.items()}
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


@pytest.mark.parametrize("kind", ["long", "string"])
def test_token_store_of_odd_rows(spark, tmp_path, kind):
    texts = [None, "", "hello <|endoftext|> world", "same text", "same text", "ña ö  two\t\tspaces ", "x" * 200_000, "longer words, here"]
    own = Tokenizer.from_file(queries.tokenizer_path())
    rows = [(str(k) if kind == "string" else k, t, "x", 5) for k, t in enumerate(texts)] + [(None, "no id", "x", 5), ("3" if kind == "string" else 3, "same text", "x", 5)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, id string, start long")
    manifest = token_store.write_tokens(docs, str(tmp_path / "t"), queries.tokenizer_path(), 2, 3)
    found = token_store.read_tokens(manifest).collect()
    wanted = [(k, [*own.encode(t or "", add_special_tokens=False).ids, 2]) for k, t, *_ in rows]
    assert sorted((repr(r.doc_id), bytes(r.ids)) for r in found) == sorted((repr(k), np.array(i, "<u4").tobytes()) for k, i in wanted)
    starts = sorted((r.start, r.n_tokens) for r in found)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    one = token_store.read_document(manifest, wanted[2][0])
    assert [x.tolist() for x in one] == [wanted[2][1]]
    assert len(token_store.read_document(manifest, wanted[3][0])) == 2
    path = manifest.first().path
    dictionary = next((tmp_path / "t").glob("*.zdict"))
    dictionary.write_bytes(b"another")
    with pytest.raises(ValueError, match="dictionary"):
        token_store.TokenFile(path)
    empty = token_store.write_tokens(docs.where("false"), str(tmp_path / "e"), queries.tokenizer_path(), 2, 3)
    assert token_store.read_tokens(empty).count() == 0


def test_packing_of_odd_rows(spark):
    r = random.Random(1)
    texts = [None, "", "hello <|endoftext|> world", *(" ".join(["word"] * r.randint(1, 3000)) for _ in range(60)), "same", "same"]
    rows = [(None if k == 4 else min(k, 60), t, "x", 5) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string, start long")
    out = packing.pack(docs, queries.tokenizer_path(), 1, 512, 32).collect()
    sequences = {}
    for p in out:
        sequences.setdefault(p.sequence_id, []).append(p)
    for held in sequences.values():
        held.sort(key=lambda p: p.offset)
        used = sum(p.length for p in held)
        assert [p.offset for p in held] == [sum(q.length for q in held[:k]) for k in range(len(held))]
        assert {(p.sequence_tokens, p.padded) for p in held} == {(used, used if used & (used - 1) == 0 else 512)} and used <= 512
    for doc_id in {p.doc_id for p in out} - {60}:
        own = sorted((p.start, p.length, p.doc_tokens) for p in out if p.doc_id == doc_id)
        assert sum(n for _, n, _ in own) == own[0][2] and [a for a, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))]
    tokens = sum(p.length for p in out)
    assert sum(h[0].padded for h in sequences.values()) <= 1.1 * tokens + 4 * 512
    assert packing.pack(docs.where("false"), queries.tokenizer_path(), 1).count() == 0


def test_a_bin_of_a_class_takes_a_fixed_number():
    own = packing.Packer(512, 32)
    done = [s for k in range(200) for s in own.add(k, np.zeros(16 + k % 16, np.uint16))]
    assert done and all(len(s) == 512 // len(s[0][2]) and len({512 // len(p[2]) for p in s}) == 1 for s in done)


def test_words_of_texts_side_by_side(monkeypatch):
    """Ids of odd texts, taken side by side and in slices, are the library's; what is made of known words isn't encoded again."""
    r = random.Random(5)
    parts = ["a", "word", "Größe", "é", " ", " ", " ", "\n", ".", ",", "9", "\n\n", "\t", "***", "'", "'s", "12", "×", "ª", "µ", "²", "中", "“q”", "\u00a0", "\u00ad", "\u0250", "\u024f", "😀", "(", "<|endoftext|>", "\r\n", "e\u0301", "\x7f"]
    texts = [None, "", " ", "\n", " a", "a ", "\n a", *("".join(r.choice(parts if r.random() < 0.3 else parts[:11]) for _ in range(r.randint(0, 12))) for _ in range(4000))]
    whole = Tokenizer.from_file(queries.tokenizer_path())
    wanted = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kind, slices in ((pa.string(), 1 << 20), (pa.large_string(), 100)):
        monkeypatch.setattr(tokens, "SIDE_BY_SIDE", slices)
        monkeypatch.setattr(tokens, "LAID", 64)
        monkeypatch.setattr(tokens, "REMEMBERED", 50)
        own = tokens.Encoder(queries.tokenizer_path())
        assert own.direct and own.parted
        assert [x.tolist() for x in own.encode_all(pa.array(texts, kind).slice(1))] == wanted[1:]
    monkeypatch.undo()
    own = tokens.Encoder(queries.tokenizer_path())
    list(own.encode_all(pa.array(["known words", "x, x. x***\nx"])))
    text = "x words,\nx words. words***"
    monkeypatch.setattr(own, "word", None)
    monkeypatch.setattr(own, "whole", None)
    assert own.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids
