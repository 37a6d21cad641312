"""N-best segmentation does its work once: words are cut by their bytes, edges laid out once, equal texts decoded once."""

import random
import re
import zlib

import numpy as np
import public_tokenizers

from quillon.llm import piece_nbest, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_words_are_those_of_the_pattern():
    own = piece_nbest.Segmenter(MODEL, 2)
    r = random.Random(8)
    texts = [None, "", " ", "a", "▁▁a▁", "é\n▁ b", *("".join(r.choices("ab ▁é\n𓀀", k=r.randint(0, 12))) for _ in range(500)), "", None]
    words, bounds = own.words(texts)
    assert len(bounds) == len(texts) + 1
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert words[a:b].to_pylist() == (re.findall("▁*[^▁]+|▁+", own.processor.normalize(t)) if t else [])
    assert [len(x) for x in own.words([None, ""])] == [0, 3]


def test_edges_of_a_searched_word_are_laid_out_once(monkeypatch):
    own, stops = piece_nbest.Segmenter(MODEL, 5), []
    plain = own._ending
    monkeypatch.setattr(own, "_ending", lambda word, stop: stops.append(stop) or plain(word, stop))
    best = own.search("▁unthinkable")
    assert len(best) == 5 and stops == list(range(1, 13))


def test_words_of_all_lengths_side_by_side():
    own = piece_nbest.Segmenter(MODEL, 2)
    r = random.Random(6)
    words = ["𓀀", "▁", "\n\n", "▁𓀀𓀀ñ", *("".join(r.choices("▁abcdethinsoño𓀀\n.", k=r.randint(1, 64))) for _ in range(150))]
    assert own._together(words) == [own._alone(w) for w in words]


def test_segmentations_with_the_same_bytes_are_marked():
    own = piece_nbest.Segmenter(MODEL, 4)
    texts = ["unable to do  so", "ab𓀀c", None, "", "x"]
    for found in own._segmented(texts):
        shown = [b"".join(own.text_of[k] for k in ids.tolist()) for _, ids, _ in found]
        assert [alike for _, _, alike in found] == [x == shown[0] for x in shown]
    own.text_of[own.pieces["▁un"][0]] = b"?"  # a piece that is written otherwise
    best, alike = own._searched("▁un")
    assert len(best) > 1 and alike == [True] + [False] * (len(best) - 1)


def test_ids_crc32_is_that_of_the_joined_ids(spark, tmp_path):
    texts = ["the cat sat", "", None, "𓀀", "unable  to\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = piece_nbest.Segmenter(MODEL, 4)
    for r in queries.op6_piece_nbest(spark, str(tmp_path)).collect():
        ids = own.encode(texts[r.doc_id])[r["rank"] - 1][1]
        assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(",".join(map(str, ids.tolist())).encode()))
