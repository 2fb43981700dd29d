from __future__ import annotations

import os

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import pieces

from .helpers import awkward, empty

if not os.path.exists(pieces.MODEL_PATH):
    pytest.skip("no vocabulary here", allow_module_level=True)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
VOCABULARY = pieces.load()
CASES = ["", " ", "  a  b ", "\n\na", "▁x", "▁▁", "日本語 テキスト 🎉", "a" * 3000, "\t\x00b", " a", "The quick\nbrown  fox", "é ß ﬁ", "1234567890 " * 20, "-----====", "<s> </s> <unk> <0x41>"]


def both(texts):
    found = pieces.encode_texts(texts, pieces.Encoder(VOCABULARY))
    return [x.tolist() for x in found], LIBRARY.encode(texts)


def test_ids_equal_the_library():
    ours, theirs = both(CASES)
    assert ours == theirs


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcde the▁ \n"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=8))
@settings(max_examples=60, deadline=None)
def test_any_texts(texts):
    ours, theirs = both(texts)
    assert ours == theirs
    for ids in ours:
        assert pieces.decode_ids(np.array(ids, dtype=np.int32), VOCABULARY.spelled) == LIBRARY.decode(ids)


def test_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pieces.decode(pieces.encode(docs)).select("text", "__ids", "__text").collect()
    assert [r["__ids"] for r in rows] == LIBRARY.encode([r["text"] for r in rows])
    assert all(r["__text"] == r["text"].replace("▁", " ") for r in rows)


def test_unigram_viterbi_equals_brute_force():
    ids = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "bab": 5, "ba": 6}
    scores = [-3.0, -2.0, -2.5, -3.1, -2.2, -4.0, -3.3]
    v = pieces.Vocabulary(ids, scores, [], None, 99, False)

    def best(word):
        if not word:
            return 0.0, []
        options = []
        for n in range(1, len(word) + 1):
            if word[:n] in ids or n == 1:
                s, rest = best(word[n:])
                i = ids.get(word[:n])
                options.append((s + (scores[i] if i is not None else v.unk_score), [i if i is not None else 99, *rest]))
        return max(options, key=lambda o: o[0])

    words = sorted(["▁" + w for w in ("abab", "bab", "a", "babba", "abcab", "aabb")])
    for word, raw in pieces.Encoder(v).encode_sorted(words):
        assert np.frombuffer(raw, dtype="<i4").tolist() == best(word)[1]


def test_unigram_equals_the_library():
    """The public pieces with scores of our own, as a unigram model: Viterbi gives the library's ids."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(open(pieces.MODEL_PATH, "rb").read())
    model.trainer_spec.model_type = 1
    rng = np.random.default_rng(0)
    for k, piece in enumerate(model.pieces):
        piece.score = -np.log(k + 10.0) - rng.random() * 1e-3  # no ties
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == 1}
    byte_ids = [k for k, p in enumerate(model.pieces) if p.type == 6]
    v = pieces.Vocabulary(ids, [library.get_score(k) for k in range(len(model.pieces))], [], byte_ids, 0, False)
    texts = [*CASES, "the unbelievable characterisation of internationally renowned words", "Größenordnung naïveté überhaupt", "wordword " * 50]
    assert [x.tolist() for x in pieces.encode_texts(texts, pieces.Encoder(v))] == library.encode(texts)


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz0123456789+/", "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))])
def test_a_million_letters_without_a_space(alphabet):
    """Memory and time are linear in a word's length."""
    import random
    import time
    import tracemalloc

    rng = random.Random(1)
    word = "".join(rng.choices(alphabet, k=1_000_000))
    began = time.time()
    tracemalloc.start()
    found = pieces.encode_texts([word[:200_000]], pieces.Encoder(VOCABULARY))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    whole = pieces.encode_texts([word], pieces.Encoder(VOCABULARY))[0]
    assert pieces.decode_ids(whole, VOCABULARY.spelled) == word
    assert pieces.decode_ids(found, VOCABULARY.spelled) == word[:200_000]
    assert time.time() - began < 120


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    found = pieces.decode(pieces.encode(docs))
    once = pieces.round_trip(docs)
    assert once.columns == found.columns
    assert sorted(map(repr, once.collect())) == sorted(map(repr, found.collect()))
    rows = found.collect()
    assert len(rows) == docs.count()
    assert found.columns == [*[c for c in docs.columns if c != "__ids"], "__ids", "__text"]
    for r in rows:
        assert r["__ids"] == LIBRARY.encode(r["text"] or "")
        assert r["__text"] == (r["text"] or "").replace("▁", " ")
    assert pieces.decode(pieces.encode(empty(spark))).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,)], "__ids array<int>")).first()["__text"] is None
