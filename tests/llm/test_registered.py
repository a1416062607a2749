"""Registered queries without SQL, by their names, over whole small driver tables against plain versions."""

import hashlib
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece

from lattica.llm import pieces, quality, registry, tokens
from tests.llm.test_quality import plain as plain_counts
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_substrings import plain as plain_removal

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def docs():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


def run(spark, name):
    return registry.QUERIES[name](spark, DATA).collect()


def test_op1_token_counts(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_proto=tokens.unigram_model())
    assert sorted((r.doc_id, r.n_tokens) for r in run(spark, "op1_token_counts")) == sorted((d, len(library.encode(t or ""))) for d, t in docs)


def test_op2_quality_rules(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op2_quality_rules")}
    forest = quality.fit_rules(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    assert len(got) == len(docs)
    for d, t in docs:
        r, want = got[d], plain_counts(t)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        # a walk through the trees, node by node
        x, total = quality.statistics(t)[1], forest.base
        for f, cut, value in zip(forest.feature, forest.threshold, forest.value):
            k = 0
            for _ in range(forest.depth):
                k = 2 * k + 1 + (x[f[k]] > cut[k])
            total += value[k]
        assert r.kept == (not r.base_failed and 1 / (1 + np.exp(-total)) >= quality.KEEP_FROM)


def test_op3_suffix_dedup(spark, docs):
    assert sorted(map(tuple, run(spark, "op3_suffix_dedup"))) == sorted(plain_removal([(d, (t or "").encode()) for d, t in docs]))


def test_op7_simhash(spark, docs):
    rows = [(d, plain_fingerprint(t)) for d, t in docs]
    component = plain_components(rows)
    assert sorted(map(tuple, run(spark, "op7_simhash"))) == sorted((d, f"{f:016x}", component[d, f]) for d, f in rows)


def test_op8_sentencepiece(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = {r.doc_id: r for r in run(spark, "op8_sentencepiece")}
    for d, t in docs:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[d].n_tokens == len(ids) and got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
