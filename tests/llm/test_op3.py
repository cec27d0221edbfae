"""Segmentations against the sentencepiece library, whose unigram model gets the same scores."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from facetgraph.llm import sentence_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return sp.codec(PATH)


@pytest.fixture(scope="module")
def library():
    """The file's pieces as a unigram model with our scores."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    for p, s in zip(proto.pieces, sp.Model.load(PATH).scores, strict=True):
        p.score = s
    proto.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


TEXTS = ["", " ", "  two  blanks ", "The quick brown fox", "über straße, niño?", "你好 世界 😀", "a\nb\tc\x00", "x" * 3000, "Thndou erhaha | eaernd | ertible " * 40]


def total(codec, ids):
    return sum(codec.unknown if codec.model.kinds[i] == sp.BYTE else codec.model.scores[i] for i in ids)


@pytest.mark.parametrize("text", TEXTS)
def test_like_the_library(codec, library, text):
    ids = codec.encode(text).tolist()
    expected = library.encode(text)
    assert ids == expected or total(codec, ids) == pytest.approx(total(codec, expected), abs=1e-3)
    assert codec.decode(codec.encode(text)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="▁"), max_size=60))
def test_round_trip(text):
    codec = sp.codec(PATH)
    assert codec.decode(codec.encode(text)) == text


@settings(max_examples=60, deadline=None)
@given(st.text("abcdeth ", max_size=12))
def test_best_of_all_segmentations(text):
    codec = sp.codec(PATH)
    known = {p: s for p, s, k in zip(codec.model.pieces, codec.model.scores, codec.model.kinds, strict=True) if k == sp.NORMAL}
    whole = ("▁" + text.replace(" ", "▁")) if text else ""
    best = [0.0] + [-1e18] * len(whole)
    for j in range(1, len(whole) + 1):
        best[j] = max(best[i] + known.get(whole[i:j], -1e17) for i in range(j))
    assert sum(codec.model.scores[i] for i in codec.encode(text)) == pytest.approx(best[-1], abs=1e-6)


def test_nulls_extra_columns_and_empty(spark):
    rows = [(1, None, "a"), (None, "x y", "b"), (1, None, "a"), (3, "the ▁ mark", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = sp.encode(docs, PATH).collect()
    assert sorted((r.n_pieces, r.round_trip) for r in found)[:2] == [(0, True), (0, True)]
    assert len(found) == 4 and not next(r for r in found if r.doc_id == 3).round_trip
    assert sp.encode(docs.limit(0), PATH).count() == 0
    back = sp.decode(sp.encode(docs, PATH), PATH).filter("doc_id is null").first()
    assert back.decoded == "x y"
