"""Alignment of two tokenizers' tokens over the same bytes.

Token ends are marked in packed bitsets, one bit per byte. The AND of both has the places where both tokenizers cut, and
counts of set bits up to those places map each shared cut to ranges of tokens on both sides. The OR has every place where
either cuts: each stretch up to the next mark lies in exactly one token of either side and no two stretches lie in the
same two, so the stretches are the links, the pairs of tokens whose bytes overlap.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, map_rows, table
from lattica.llm.pieces import SPACE_MARK, coder_of as piece_coder
from lattica.llm.pieces import default_model, read_model
from lattica.llm.ragged import Ragged, Remembered, parts

#: A text splits before a space between two characters that are none: both tokenizers always cut there.
BORDER = re.compile(r"(?<=\S)(?= \S)")
#: New stretches are given to the libraries so many at a time.
JOINED = 4000
#: Characters of a block of documents: what a task works on at once, beside what it remembers.
AT_ONCE = 1 << 20
#: Stretches that a task remembers.
STRETCHES = 250_000
#: Rows of blocks are long, so what a task holds before it writes is looked at after each, and row groups are small.
LONG_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
#: Links carry both ids in one number.
HIGH = 32


def default_bytes() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Marks:
    """A packed bitset over the bytes 1 to n: bit k - 1 is set if a token ends with byte k."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def of(ends: np.ndarray, n: int) -> Marks:
        held = np.zeros(n, bool)
        held[ends - 1] = True
        return Marks(np.packbits(held, bitorder="little"))

    def __and__(self, other: Marks) -> Marks:
        return Marks(self.bits & other.bits)

    def __or__(self, other: Marks) -> Marks:
        return Marks(self.bits | other.bits)

    def select(self) -> np.ndarray:
        """Places of the set bits, rising: the byte counts at which tokens end."""
        return np.flatnonzero(np.unpackbits(self.bits, bitorder="little")) + 1

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many tokens end at each place or before it: whole bytes of bits by running counts, the rest by a mask."""
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])
        whole, rest = np.divmod(places, 8)
        last = np.append(self.bits, 0)[whole] & ((1 << rest) - 1).astype(np.uint8)
        return before[whole] + np.bitwise_count(last)


def aligned(a_ends: np.ndarray, b_ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cuts, a, b, stretches, link_a, link_b) of two lists of token ends over n bytes, each without tokens of no bytes: the
    shared cuts, tokens of either side up to each, the ends of the stretches, and for each the two tokens it lies in."""
    a, b = Marks.of(a_ends, n), Marks.of(b_ends, n)
    cuts, stretches = (a & b).select(), (a | b).select()
    before = np.concatenate([[0], stretches[:-1]]) if len(stretches) else stretches
    return cuts, a.rank(cuts), b.rank(cuts), stretches, a.rank(before), b.rank(before)


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones of Latin-1 stand for themselves, the
    others take the characters from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [x for x in range(256) if x not in own]
    return {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(others)}


class Aligner:
    """Groups and links of a text's tokens under a byte-level vocabulary (A) and a piece model (B).

    Stretches between borders are aligned once and remembered: no token of either side crosses a border, so a text's
    result is that of its stretches one after the other. New stretches are joined, encoded and aligned many at a time. For
    a model whose normaliser changes text, or whose pieces may cross marks, a text is one stretch.
    """

    def __init__(self, a_path: str, b_path: str):
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, k in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        self.b = piece_coder(b_path)
        model = read_model(b_path)
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE_MARK, " ").encode() for p in model.pieces]
        self.a_widths, self.b_widths = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        plain_a = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        n = self.b.normaliser
        self.splits = plain_a and self.b.by_chunk and not n.map.units and not n.squeeze and n.prefix and n.mark == SPACE_MARK.encode()
        self.stats, self.links, self.texts = Ragged("<i8"), Ragged("<i8"), []
        self.memory = Remembered(self.learn, self.keep, STRETCHES)

    def keep(self, rows: np.ndarray) -> None:
        self.stats, self.links, self.texts = self.stats.only(rows), self.links.only(rows), [self.texts[k] for k in rows.tolist()]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space + text under A, and of text under B, which adds the space itself."""
        a = self.a.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids
        b = self.b.ids(f" {text}".replace(" ", SPACE_MARK), False) if self.splits else self.b.library.encode(text)
        return np.array(a, np.int64), np.array(b, np.int64)

    def agree(self, a: np.ndarray, b: np.ndarray, raw: bytes) -> bool:
        """Both sides' tokens have the text's bytes, and none is empty."""
        joined = (b"".join(map(x.__getitem__, ids.tolist())) for x, ids in ((self.a_bytes, a), (self.b_bytes, b)))
        return all(x == raw for x in joined) and self.a_widths[a].all() and self.b_widths[b].all()

    def learn(self, keys: list[str]) -> None:
        """keys: stretches without their first space. Those that a border surely separates are encoded together, so many at a
        time, and kept before the next are, so that no more than these are held as objects of their own."""
        for k in range(0, len(keys), JOINED):
            some = keys[k : k + JOINED]
            free = [x for x in some if x and not x[0].isspace() and not x[-1].isspace()] if self.splits else []
            done = dict(zip(free, self.stretches(free) or [self.stretches([x])[0] for x in free])) if free else {}
            got = [done[x] if x in done else self.stretches([x])[0] for x in some]
            self.stats.extend(np.array([x[0] for x in got], np.int64).ravel(), np.full(len(got), 4, np.int64))
            self.links.extend(np.concatenate([x[1] for x in got]), np.array([len(x[1]) for x in got], np.int64))
            self.texts += [x[2] for x in got]

    def stretches(self, keys: list[str]) -> list[tuple] | None:
        """((tokens of A, of B, groups, failed), links, groups as text) of each stretch. A lone one whose tokens don't have
        its bytes failed; of several, None says that they have to be tried one by one."""
        raws = [f" {k}".encode() for k in keys]
        raw = b"".join(raws)
        a, b = self.encode(" ".join(keys))
        ends = np.cumsum([len(x) for x in raws])
        if not self.agree(a, b, raw):
            return None if len(keys) > 1 else [((0, 0, 0, 1), np.zeros(0, np.int64), "")]
        cuts, a_upto, b_upto, stops, link_a, link_b = aligned(np.cumsum(self.a_widths[a]), np.cumsum(self.b_widths[b]), len(raw))
        group = np.searchsorted(cuts, ends)
        if len(keys) > 1 and not np.array_equal(cuts[np.minimum(group, len(cuts) - 1)], ends):
            return None
        link = np.searchsorted(stops, ends, "right")
        codes = np.split((a[link_a] << HIGH) | b[link_b], link[:-1])
        texts_a, texts_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        written, p, q = [], 0, 0
        for x, y in zip(a_upto.tolist(), b_upto.tolist()):
            written.append(f"{','.join(texts_a[p:x])}|{','.join(texts_b[q:y])}")
            p, q = x, y
        upto = group + 1
        n_a, n_b, n_groups = (np.diff(x, prepend=0).tolist() for x in (a_upto[group], b_upto[group], upto))
        begins = np.concatenate([[0], upto[:-1]]).tolist()
        return [((i, j, g, 0), c, ";".join(written[s : s + g])) for i, j, g, c, s in zip(n_a, n_b, n_groups, codes, begins)]

    def rows(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the stretches of an Arrow array of texts, and how many each text has; an empty text has none."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.splits:
            whole = texts.to_pylist()
            held = [x for x in whole if x]
            words = list(dict.fromkeys(held))
            at = dict(zip(words, self.memory.of(words).tolist()))
            return np.array([at[x] for x in held], np.int64), np.array([bool(x) for x in whole], np.int64)
        lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
        found = lists.flatten().dictionary_encode()
        words, index = found.dictionary.to_pylist(), found.indices.to_numpy()
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        # next to other white space a space is no border: such texts are split by the rule itself
        odd = np.fromiter((not w or w[0].isspace() or w[-1].isspace() for w in words), bool, len(words))
        owner = np.repeat(np.arange(len(n)), n)
        again = np.unique(owner[odd[index]])
        if len(again):
            keep = ~np.isin(owner, again)
            more = [[x[1:] for x in BORDER.split(f" {t}")] if t else [] for t in texts.take(pa.array(again)).to_pylist()]
            at = {w: k for k, w in enumerate(words)}
            late = [at.setdefault(x, len(at)) for xs in more for x in xs]
            used, index = np.unique(np.concatenate([index[keep], np.array(late, np.int64)]), return_inverse=True)
            known = list(at)
            words = [known[k] for k in used.tolist()]
            n[again] = [len(xs) for xs in more]
            owner = np.concatenate([owner[keep], np.repeat(again, n[again])])
            index = index[np.argsort(owner, kind="stable")]
        return self.memory.of(words)[index], n


@functools.lru_cache(maxsize=2)
def aligner_of(a_path: str, b_path: str) -> Aligner:
    """One for a Python worker, so that what it remembers serves all its tasks."""
    return Aligner(a_path, b_path)


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, groups, links) of each row: ids of both sides, groups (end, n_a, n_b) with the byte after each
    in space + text and the tokens of either side, and links (a, b) as places in the lists of ids. A text that is null or
    empty, or of which either side's tokens don't have the bytes, has empty lists. Rows are kept, other columns not read."""
    a_path, b_path = a_path or default_bytes(), b_path or default_model()

    def make():
        aligner = aligner_of(a_path, b_path)

        def one(doc, text):
            a, b = aligner.encode(text) if text else (np.zeros(0, np.int64),) * 2
            raw = f" {text}".encode()
            if not text or not aligner.agree(a, b, raw):
                return doc, [], [], [], []
            cuts, a_upto, b_upto, _, link_a, link_b = aligned(np.cumsum(aligner.a_widths[a]), np.cumsum(aligner.b_widths[b]), len(raw))
            groups = [{"end": e, "n_a": x, "n_b": y} for e, x, y in zip(cuts.tolist(), np.diff(a_upto, prepend=0).tolist(), np.diff(b_upto, prepend=0).tolist())]
            return doc, a.tolist(), b.tolist(), groups, [{"a": x, "b": y} for x, y in zip(link_a.tolist(), link_b.tolist())]

        return one

    schema = "doc_id long, a_ids array<int>, b_ids array<int>, groups array<struct<end: long, n_a: int, n_b: int>>, links array<struct<a: int, b: int>>"
    return map_rows(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text"), make, schema)


BLOCK = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, n_pairs array<int>, link array<int>, times array<int>, pair array<long>, n array<long>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, size: int) -> DataFrame:
    """A row for each run of a task's documents of about `size` characters: their counts and digests, the distinct id pairs
    of their links with how often each occurs, and for each document its pairs, by place in that list, with counts."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        aligner, made = aligner_of(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for begin, end in parts(pc.binary_length(texts).to_pylist(), size):
                rows, n = aligner.rows(texts.slice(begin, end - begin))
                stops = np.concatenate([[0], np.cumsum(n)])
                stats = aligner.stats.take(rows)[0].reshape(-1, 4)
                sums = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(stats, axis=0)])[stops], axis=0)
                good = (sums[:, 3] == 0) & (n > 0)
                sums[~good] = 0
                texts_of = list(map(aligner.texts.__getitem__, rows.tolist()))
                digests = [hashlib.sha256(";".join(texts_of[a:b]).encode()).hexdigest() if ok else "" for a, b, ok in zip(stops[:-1].tolist(), stops[1:].tolist(), good.tolist())]
                codes, n_codes = aligner.links.take(rows[np.repeat(good, n)])
                owner = np.repeat(np.repeat(np.arange(len(n)), n * good), n_codes)
                pairs, index = np.unique(codes, return_inverse=True)
                own, times = np.unique(owner * max(1, len(pairs)) + index, return_counts=True)
                owner, index = np.divmod(own, max(1, len(pairs)))
                columns = [
                    np.array([made]), batch.column(0).slice(begin, end - begin), sums[:, 0], sums[:, 1], sums[:, 2], np.bincount(owner, times, len(n)).astype(np.int64), pa.array(digests, pa.string()),
                    np.bincount(owner, minlength=len(n)).astype(np.int32), index.astype(np.int32), times.astype(np.int32), pairs, np.bincount(index, times, len(pairs)).astype(np.int64),
                ]
                made += 1
                lists = [pa.array(columns[0])] + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x)) for x in columns[1:]]
                yield pa.RecordBatch.from_arrays(lists, names=[x.split()[0] for x in BLOCK.split(", ")])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, BLOCK)


def pair_counts(made: DataFrame, scratch: Scratch) -> DataFrame:
    """(pair, total, best) of the id pairs of all blocks: how many links hold each, and whether that is its B id's most."""
    totals = made.select(F.explode(F.arrays_zip("pair", "n")).alias("x")).groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.n").alias("total"))
    totals = scratch.put(totals.withColumn("b", F.col("pair").bitwiseAND((1 << HIGH) - 1)))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def aligned_counts(docs: DataFrame, scratch: Scratch, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = AT_ONCE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row per row of docs.

    A text that is null or empty, or of which either side's tokens don't have the bytes of space + text, has zeros and an
    empty digest. Repeated rows count each, null ids are kept, an empty table gives an empty result, other columns are not read.

    Corpus-wide counts come back to a block as one row for each of its distinct pairs, however many of its documents have
    it, so that a pair that all documents have is one row per block on either side of the join. Nothing is broadcast; a task
    holds a block, which is a run of documents of about `size` characters or one longer document, and its pairs.
    """
    made = scratch.put(blocks(docs, a_path or default_bytes(), b_path or default_model(), id_col, text_col, size), **LONG_ROWS)
    asked = made.select(F.col("block").alias("asker"), F.posexplode("pair").alias("at", "pair"))
    known = asked.join(pair_counts(made, scratch), "pair").select("asker", "at", "total", "best")

    def told(counts, block):
        import pyarrow as pa

        totals, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
        at = counts.column("at").to_numpy()
        totals[at], best[at] = counts.column("total").to_numpy(), counts.column("best").to_numpy().astype(np.int64)
        flat = lambda x: block.column(x).combine_chunks().flatten()
        link, times = flat("link").to_numpy(), flat("times").to_numpy().astype(np.int64)
        stops = np.concatenate([[0], np.cumsum(flat("n_pairs").to_numpy())])
        summed = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x[link] * times)])[stops]))
        names = [x.split()[0] for x in ALIGNED.split(", ")]
        return pa.table([summed(best) if x == "n_best" else summed(totals) if x == "count_sum" else flat(x) for x in names], names=names)

    return known.groupBy("asker").cogroup(made.drop("pair", "n").groupBy("block")).applyInArrow(told, ALIGNED)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_counts(table(spark, sf_dir, "documents"), Scratch(spark, "alignment"))
