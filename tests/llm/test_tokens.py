import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from lattica.llm import tokens


@pytest.fixture(scope="module")
def blob():
    return tokens.unigram_model()


def altered(blob, fallback=True, scores=None):
    model = sentencepiece_model_pb2.ModelProto.FromString(blob)
    model.trainer_spec.byte_fallback = fallback
    if not fallback:
        for p in model.pieces:
            if p.type == 6:
                p.type = 5
    if scores:
        for k, p in enumerate(model.pieces):
            if p.type == 1:
                p.score = scores(k)
    return model.SerializeToString()


def sample(rng, n):
    return ["".join(rng.choices(["the ", "tion", "a", " ", "é", "ing", "日", "🙂", "\n", "q", "zz", "Th", "."], k=rng.randrange(n))) for _ in range(300)]


@pytest.mark.parametrize("kind", ["own", "no fallback", "uneven scores", "ties"])
def test_counts_equal_the_library(blob, kind):
    rng = random.Random(7)
    model = {"own": blob, "no fallback": altered(blob, False), "uneven scores": altered(blob, True, lambda k: -7.3 - (k * 7919 % 1000) / 777), "ties": altered(blob, True, lambda k: -1.0)}[kind]
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), tokens.TokenCounter(model)
    for t in ["", " ", "  a  ", *sample(rng, 60)]:
        assert own.count(t) == len(library.encode(t)), repr(t)


def test_very_long_texts_follow_32_bit_rounding(blob):
    rng = random.Random(8)
    text = " ".join("".join(rng.choices(["th", "e", "ion", "q", "é"], k=4)) for _ in range(30_000))
    library, own = sentencepiece.SentencePieceProcessor(model_proto=blob), tokens.TokenCounter(blob)
    assert len(text) > own.safe
    assert own.count(text) == len(library.encode(text))


def test_rows_with_nulls_copies_and_clashing_columns(spark, blob):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "the end", 1), (3, "the end", 1), (None, "x", 1)], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.token_counts(docs, blob).collect()), key=str)
    assert [g[:2] for g in got] == sorted([(1, 0), (2, 0), (3, 7), (3, 7), (None, 1)], key=str)
    assert {g[2] for g in got if g[0] in (1, 2)} == {0} and all(g[2] > 0 for g in got if g[0] in (3, None))
    assert tokens.token_counts(docs.limit(0), blob).count() == 0
