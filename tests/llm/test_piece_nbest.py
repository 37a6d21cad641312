"""N-best segmentation against all segmentations, and round trips."""

import random
import zlib

import public_tokenizers
import pytest

from quillon.llm import piece_nbest, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def every(own, word):
    found = [[] for _ in range(len(word) + 1)]
    found[0] = [0.0]
    for stop in range(1, len(word) + 1):
        for start in range(stop):
            piece = own.pieces.get(word[start:stop])
            if piece or start == stop - 1:
                found[stop] += [s + (piece[1] if piece else own.unknown) for s in found[start]]
    return sorted(found[-1], reverse=True)


@pytest.mark.parametrize("text", ["the cat", "ab𓀀c", "unable to", "a  b", "x", "\nq\t"])
@pytest.mark.parametrize("n", [1, 2, 5])
def test_scores_are_the_best_of_all(text, n):
    own = piece_nbest.Segmenter(MODEL, n)
    got = own.encode(text)
    assert [s for s, _ in got] == every(own, own.processor.normalize(text))[:n]
    assert len({tuple(ids.tolist()) for _, ids in got}) == len(got)
    assert all(own.decode(ids) == text for _, ids in got)


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "hello there", 0), (3, "hello there", 0), (4, "z" * 5000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    out = piece_nbest.encode_texts(docs, MODEL, 3)
    got = out.collect()
    assert [(r.rank, r.score, r.ids) for r in got if r.doc_id in (1, 2)] == [(1, 0.0, [])] * 2
    assert len([r for r in got if r.doc_id == 3]) == 6
    texts = {(r.doc_id, r.text) for r in piece_nbest.decode_ids(out, MODEL).collect()}
    assert texts == {(1, ""), (2, ""), (3, "hello there"), (4, "z" * 5000)}
    assert piece_nbest.encode_texts(docs.where("false"), MODEL, 3).count() == 0


def test_words_side_by_side_are_those_searched_alone():
    own = piece_nbest.Segmenter(MODEL, 3)
    r = random.Random(4)
    words = list({"▁" * r.randint(0, 2) + "".join(r.choices("abcdethinsño𓀀", k=r.randint(1, 14))) for _ in range(400)})
    for w, (top, loss, ids) in zip(words, own._together(words), strict=True):
        best = own.search(w)
        assert (top, ids) == best[0]
        assert loss == (best[0][0] - best[1][0] if len(best) > 1 else float("inf"))
        assert own._alone(w) == (top, loss, ids)


def test_query(spark, tmp_path):
    texts = ["the cat sat on the mat", "ab𓀀c", "", None, "unable to do", "the cat sat on the mat"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = piece_nbest.Segmenter(MODEL, 4)
    got = queries.op6_piece_nbest(spark, str(tmp_path)).collect()
    for k, t in enumerate(texts):
        ranks = sorted((r for r in got if r.doc_id == k), key=lambda r: r["rank"])
        assert [r.score for r in ranks] == (every(own, own.processor.normalize(t))[:4] if t and len(t) < 14 else [s for s, _ in own.encode(t)])
        assert all(r.text_crc32 == zlib.crc32((t or "").encode()) for r in ranks)


def test_a_long_word_goes_through():
    own = piece_nbest.Segmenter(MODEL, 2)
    text = "".join(random.Random(1).choices("abcdefgh", k=200_000))
    best = own.encode(text)
    assert len(best) == 2 and best[0][0] >= best[1][0] and all(own.decode(ids) == text for _, ids in best)
