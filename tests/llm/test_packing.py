import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from lattica.llm import packing
from lattica.llm.common import Scratch
from lattica.llm.ragged import Ragged, Remembered, parts

SCHEMA = "doc_id long, text string, part long, rank long, sequence_id string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.default_tokenizer())


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def texts():
    rng = random.Random(5)
    words = ["Straße", "l'été", "don't", "'s", "x9y", "İstanbul", "ΟΔΟΣ", "é", "́a", "<|endoftext|>", "a<|startoftext|>b", "🙂", "a b", "a\x1cb", "a1b22", "x.y", "(Ab)", "Ünï-1", "ß?!", "a'b", "<|x|>", "_a", "日本語", "...", "ﬁn", "A" * 40]
    out = [" ".join(rng.choice(words) + rng.choice(["", "", "\n", "\t", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    return [*out, None, "", " \n", "word " * 9000, "b" * 30000, *["same text"] * 7]


def test_word_coder_equals_library(library):
    import pyarrow as pa

    coder = packing.WordCoder(packing.default_tokenizer())
    assert coder.by_word
    given = [t or "" for t in texts()]
    for _ in range(2):  # the second time from memory
        ids, n = coder.ids(pa.array(given))
        stops = np.concatenate([[0], np.cumsum(n)])
        assert [ids[a:b].tolist() for a, b in zip(stops, stops[1:])] == [plain(library, t)[:-1] for t in given]
    coder.by_word = False
    ids, n = coder.ids(pa.array(given))
    assert n.tolist() == [len(plain(library, t)) - 1 for t in given]


@pytest.mark.parametrize("seed", range(40))
def test_patterns_hold_the_histogram(seed):
    rng = random.Random(seed)
    length = rng.choice([5, 16, 64, 2048])
    histogram = {rng.randint(1, length): rng.choice([0, 1, 2, 7, 10**9]) for _ in range(rng.randint(0, 60))}
    held = Counter()
    for p in packing.shortest_pack_first(histogram, length):
        assert 0 < p.filled <= length and p.count > 0
        assert list(p.slots) == sorted(p.slots, reverse=True)
        held.update({size: n * p.count for size, n in p.slots})
    assert held == Counter({x: n for x, n in histogram.items() if n})


def one_by_one(histogram, length):
    """Piece for piece, into the emptiest sequence that has room."""
    packs = []
    for size in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        at = min((k for k, x in enumerate(packs) if x + size <= length), key=packs.__getitem__, default=None)
        if at is None:
            packs.append(size)
        else:
            packs[at] += size
    return sorted(packs)


@pytest.mark.parametrize("seed", range(60))
def test_patterns_fill_as_piece_for_piece(seed):
    rng = random.Random(seed)
    length = rng.choice([7, 20, 50])
    histogram = {rng.randint(1, length): rng.randint(1, 9) for _ in range(rng.randint(1, 15))}
    # moving whole counts may differ from single steps by sequences, not by more
    got = sorted(p.filled for p in packing.shortest_pack_first(histogram, length) for _ in range(p.count))
    want = one_by_one(histogram, length)
    assert sum(got) == sum(want) and len(got) <= len(want) + max(2, len(want) // 10)


def test_lengths_out_of_range():
    with pytest.raises(ValueError):
        packing.shortest_pack_first({9: 1}, 8)


def test_pack_documents(spark, library):
    rows = [(k % 70, t, 3, 4, "x") for k, t in enumerate(texts())] + [(None, "no id", 3, 4, "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = Scratch(spark, "packing").put(packing.token_pieces(docs, length=64, with_ids=True))
    out = packing.packed(made, 64)
    got = out.collect()
    want = Counter((d, tuple(plain(library, t))) for d, t, *_ in rows)
    by_doc = Counter()
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        by_doc[r.doc_id] += r.length
    tokens = Counter()
    for (d, ids), n in want.items():
        tokens[d] += n * len(ids)
    assert by_doc == tokens
    cut = Counter((d, s, tuple(ids[s : s + 64]), len(ids)) for (d, ids), n in want.items() for s in range(0, len(ids), 64) for _ in range(n))
    assert Counter((r.doc_id, r.start, tuple(r.ids), r.doc_tokens) for r in got) == cut
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for r in packing.sequences(out, 64, pad_id=7).collect():
        some = sorted(by_sequence[r.sequence_id], key=lambda x: x.offset)
        ids = [i for x in some for i in x.ids]
        assert r.n_tokens == len(ids) and r.ids == (ids if len(ids) in (1, 2, 4, 8, 16, 32, 64) else ids + [7] * (64 - len(ids)))
        assert [(p.doc_id, p.start, p.length, p.offset) for p in r.pieces] == [(x.doc_id, x.start, x.length, x.offset) for x in some]


def test_padding_is_small(spark):
    docs = spark.createDataFrame([(k, "token " * (1 + k * 37 % 3000)) for k in range(800)], "doc_id long, text string")
    got = packing.pack_documents(docs, Scratch(spark, "packing")).collect()
    assert sum(r.length for r in got) >= 0.97 * 2048 * len({r.sequence_id for r in got})


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), Scratch(spark, "packing")).collect() == []


def test_ragged_and_memory():
    table = Ragged("<i8")
    table.extend(np.arange(9000), np.array([0, 9000]))
    table.extend(np.arange(5), np.array([2, 0, 3]))
    values, lengths = table.take(np.array([4, 0, 2, 2]))
    assert values.tolist() == [2, 3, 4, 0, 1, 0, 1] and lengths.tolist() == [3, 0, 2, 2]
    learnt = []

    def keep(rows):
        learnt[:] = [learnt[k] for k in rows]

    memory = Remembered(learnt.extend, keep, most=4)
    for chunks in (["a", "b"], ["b", "c"], ["d", "b"], ["d", "e", "b", "f"], list("bghijk"), ["b", "k"]):
        assert [learnt[k] for k in memory.of(chunks)] == chunks
    assert "b" in learnt and len(learnt) <= 7
    assert list(parts([])) == [] and list(parts([5, 5, 90, 1], 10)) == [(0, 2), (2, 3), (3, 4)]
