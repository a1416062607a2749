import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lattica.llm import alignment
from lattica.llm.common import Scratch

SCHEMA = "doc_id long, text string, block long, pair string, total int"


class Plain:
    """Whole texts by the libraries, and every pair of tokens compared."""

    def __init__(self):
        self.a = Tokenizer.from_file(alignment.default_bytes())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=alignment.default_model())
        alphabet = alignment.byte_alphabet()
        self.a_bytes = {k: bytes(alphabet[c] for c in x) if all(c in alphabet for c in x) else x.encode() for x, k in self.a.get_vocab().items()}

    def b_bytes(self, k):
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()

    def one(self, text):
        if not text:
            return [], [], [], ""
        a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
        raw = f" {text}".encode()
        pa, pb = [self.a_bytes[x] for x in a], [self.b_bytes(x) for x in b]
        if b"".join(pa) != raw or b"".join(pb) != raw:
            return [], [], [], ""
        ea, eb = np.cumsum([len(x) for x in pa]).tolist(), np.cumsum([len(x) for x in pb]).tolist()
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(ea[i] - len(pa[i]), eb[j] - len(pb[j])) < min(ea[i], eb[j])]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            x, y = ea.index(cut) + 1, eb.index(cut) + 1
            groups.append(f"{','.join(map(str, a[i:x]))}|{','.join(map(str, b[j:y]))}")
            i, j = x, y
        return a, b, links, ";".join(groups)

    def all(self, rows):
        made = [(d, *self.one(t)) for d, t in rows]
        counts = Counter(x for _, _, _, links, _ in made for x in links)
        most = Counter()
        for (_, b), n in counts.items():
            most[b] = max(most[b], n)
        digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
        return Counter((d, len(a), len(b), len(g.split(";")) if g else 0, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest(g)) for d, a, b, links, g in made)


@pytest.fixture(scope="module")
def plain():
    return Plain()


def texts():
    rng = random.Random(3)
    words = ["the", "aththwhst", "Straße", "don't", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "🙂🙂", "日本語", "é", "a b", "x y", "...", "12345", "\x00", "�", "ab\ncd"]
    out = [" ".join(rng.choice(words) + rng.choice(["", "", "", "\n", "\t", "  ", "　"]) for _ in range(rng.randint(0, 25))) for _ in range(80)]
    return [*out, None, "", " ", "  ", "\n", " a", "a ", "a▁b", "ok then a▁b", "▁", "q" * 1500, *["same text here"] * 5]


def test_bitsets():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 70)
        ends = [sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n}) for _ in range(2)]
        cuts, a, b, stops, link_a, link_b = alignment.aligned(*(np.array(x) for x in ends), n)
        assert cuts.tolist() == sorted(set(ends[0]) & set(ends[1])) and stops.tolist() == sorted({*ends[0], *ends[1]})
        assert a.tolist() == [sum(x <= c for x in ends[0]) for c in cuts] and b.tolist() == [sum(x <= c for x in ends[1]) for c in cuts]
        begins = [[0, *x[:-1]] for x in ends]
        want = [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if max(begins[0][i], begins[1][j]) < min(ends[0][i], ends[1][j])]
        assert list(zip(link_a.tolist(), link_b.tolist())) == want


@pytest.mark.parametrize("splits", [True, False])
def test_counts_equal_plain(spark, plain, splits, monkeypatch):
    rows = [(k % 80, t) for k, t in enumerate(texts())] + [(None, "no id")]
    docs = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA).repartition(3)
    if not splits:
        aligner = alignment.Aligner(alignment.default_bytes(), alignment.default_model())
        aligner.splits = False
        import pyarrow as pa

        got, n = aligner.rows(pa.array([t or "" for _, t in rows]))
        assert n.tolist() == [bool(t) for _, t in rows]
        assert [aligner.texts[k] for k in got] == [plain.one(t)[3] for _, t in rows if t]
        return
    assert Counter(map(tuple, alignment.aligned_counts(docs, Scratch(spark, "alignment"), size=300).collect())) == plain.all(rows)


def test_one_block_equals_many(spark, plain):
    docs = spark.createDataFrame([(k, t, 1, "p", 2) for k, t in enumerate(texts())], SCHEMA).coalesce(1)
    few, many = (Counter(map(tuple, alignment.aligned_counts(docs, Scratch(spark, "alignment"), size=s).collect())) for s in (1 << 20, 1))
    assert few == many


def test_alignments(spark, plain):
    rows = [(k, t, 1, "p", 2) for k, t in enumerate(texts())]
    for r in alignment.alignments(spark.createDataFrame(rows, SCHEMA)).collect():
        a, b, links, text = plain.one(rows[r.doc_id][1])
        assert (r.a_ids, r.b_ids) == (a, b) and sorted((a[x.a], b[x.b]) for x in r.links) == sorted(links)
        written, i, j = [], 0, 0
        for g in r.groups:
            written.append(f"{','.join(map(str, a[i : i + g.n_a]))}|{','.join(map(str, b[j : j + g.n_b]))}")
            i, j = i + g.n_a, j + g.n_b
        assert ";".join(written) == text


def test_empty_table(spark):
    assert alignment.aligned_counts(spark.createDataFrame([], SCHEMA), Scratch(spark, "alignment")).collect() == []


def test_worker_memory_is_bounded():
    """What is remembered of stretches has a limit, and nothing else of them is kept, nor by the piece model's coder."""
    aligner = alignment.Aligner(alignment.default_bytes(), alignment.default_model())
    assert aligner.memory.most == alignment.STRETCHES
    aligner.memory.most, before = 60, len(aligner.b.seen)
    fresh = alignment.Aligner(alignment.default_bytes(), alignment.default_model())
    import pyarrow as pa

    for k in range(30):
        texts = pa.array([" ".join(f"w{k}x{i}" for i in range(20)) + " same words"])
        rows, n = aligner.rows(texts)
        assert n.tolist() == [22] and len(aligner.memory.rows) <= 60
        assert len(aligner.texts) == aligner.stats.n == aligner.links.n == len(aligner.memory.rows)
        assert [aligner.texts[x] for x in rows] == [fresh.texts[x] for x in fresh.rows(texts)[0]]
    assert len(aligner.b.seen) == before


def test_blocks_are_written_in_small_row_groups(spark, tmp_path):
    """A block is a long row: a task writes it out before it holds a hundred of them."""
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(40000)), 1, "p", 2) for k in range(24)], SCHEMA).coalesce(1)
    made = Scratch(spark, "alignment").put(alignment.blocks(docs, alignment.default_bytes(), alignment.default_model(), "doc_id", "text", 1), **alignment.LONG_ROWS | {"parquet.block.size": 1 << 20})
    files = [pq.ParquetFile(f.split(":", 1)[-1].replace("///", "/")) for f in made.inputFiles()]
    assert sum(f.metadata.num_rows for f in files) == 24 and sum(f.num_row_groups for f in files) > 1
