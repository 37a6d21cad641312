"""N-best segmentation in bounded memory, with the texts decoded by the worker that encodes."""

import random
import tracemalloc

import numpy as np
import public_tokenizers

from quillon.llm import piece_nbest

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts_of_new_words(seed, characters):
    r = random.Random(seed)
    return [" ".join("".join(r.choices("abcdeinorst\n", k=8)) for _ in range(500)) for _ in range(characters // 4500)]


def test_new_words_take_bounded_memory():
    own = piece_nbest.Segmenter(MODEL, 4)
    texts = texts_of_new_words(1, 2_500_000)
    tracemalloc.start()
    for at in range(0, len(texts), 222):  # a million characters, as encode_texts hands them over
        for best in own.encode_many(texts[at : at + 222]):
            assert len(best) == 4
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_forgetting_changes_nothing(monkeypatch):
    texts = texts_of_new_words(2, 60_000)
    texts += texts[:3] + ["a" * 100 + " b", None, ""]
    plain = lambda own: [[(s, ids.tolist()) for s, ids in best] for k in range(0, len(texts), 3) for best in own.encode_many(texts[k : k + 3])]
    wanted = plain(piece_nbest.Segmenter(MODEL, 3))
    monkeypatch.setattr(piece_nbest, "_HELD", 700)
    monkeypatch.setattr(piece_nbest, "_SEARCHED", 2)
    own = piece_nbest.Segmenter(MODEL, 3)
    assert plain(own) == wanted
    assert len(own.memory.numbers) <= 700 + 1500 and len(own._searches) <= 2


def test_decoding_side_by_side_is_decoding_alone():
    own = piece_nbest.Segmenter(MODEL, 1)
    r = random.Random(5)
    marks = [own.bytes[b] for b in (*"▁é \n".encode(), 65)] + [0, 1, 2, 300, 5000, own.pieces["▁the"][0], own.pieces["▁"][0]]
    for some in (marks, marks[:9], marks[-4:]):
        lists = [np.array(r.choices(some, k=r.randint(0, 6)), np.int32) for _ in range(800)]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        assert own.decode_many(np.concatenate(lists), bounds).to_pylist() == [own.decode(x) for x in lists]
    halves = np.array([own.bytes[b] for b in "é".encode()], np.int32)  # a character cut by the bound of two texts
    assert own.decode_many(halves, np.array([0, 1, 2])).to_pylist() == ["�"] * 2


def test_decoded_column_is_what_decode_ids_makes(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "hello  there\n", 0), (3, "ab𓀀c ▁ x", 0), (4, "z" * 300, 0)]
    out = piece_nbest.encode_texts(spark.createDataFrame(rows, "doc_id long, text string, rank int"), MODEL, 3, decoded="again")
    assert out.columns == ["doc_id", "rank", "score", "ids", "again"]
    got = piece_nbest.decode_ids(out, MODEL).collect()
    assert len(got) == 11 and all(r.again == r.text for r in got)
