"""Packing documents into training sequences by their length histogram, shortest pack first.

Tokens are counted in one pass, which numbers the pieces of each length within their task. The histogram of lengths, at
most one row per length, is packed on the driver: lengths are placed longest first, each into the packs that have most
room, which splits off counts of packing patterns and never touches a document. A piece's rank among the pieces of its
length then says which slot of which pattern it fills.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, table
from lattica.llm.ragged import Ragged, Remembered, parts, runs

#: Tokens of a sequence.
LENGTH = 2048
#: The id that ends a document.
END_ID = 1
#: New words are given to the library so many at a time.
JOINED = 4000
#: Words whose runs the tokenizer's pattern surely tells apart: no apostrophe, which starts endings, and no bar, which special
#: tokens have.
PLAIN = re.compile(r"[0-9A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\[-`{}~]+")
RUN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{}~]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def drops_space(spec: dict) -> bool:
    """True if white space separates words for good and leaves no token, so that words can be encoded one by one: the
    normaliser works on characters or runs of white space, and only the pattern's matches, which hold none, are kept."""
    first = (spec.get("normalizer") or {}).get("normalizers") or []
    second = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    known = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} for x in first)
    split = second[0].get("type") == "Split" and second[0]["behavior"] == "Removed" and second[0]["invert"]
    pattern = second[0].get("pattern", {}).get("Regex", " ")
    negated = [x for x in pattern.split("[^")[1:] if "\\s" not in x.split("]")[0]]
    marks = [x["content"] for x in spec.get("added_tokens", []) if any(c.isspace() for c in x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"]]
    return bool(first) and known and split and " " not in pattern and "." not in pattern and not negated and not marks and not spec.get("post_processor")


class WordCoder:
    """ids(texts): the ids of many texts, one after the other, and how many each has, as the library gives them.

    Where words are independent, each distinct word is encoded once and remembered. Words of Latin letters, digits and
    signs go to the library joined by spaces, since it is known how many tokens with the end mark each has: one for each run
    of letters or signs and each digit. Others go one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.by_word = drops_space(spec)
        suffix = spec["model"].get("end_of_word_suffix")
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[k for x, k in vocab.items() if x.endswith(suffix)]] = True
        self.joins = bool(suffix)
        self.table = Ragged("<u4")
        self.memory = Remembered(self.learn, self.keep)

    def keep(self, rows: np.ndarray) -> None:
        self.table = self.table.only(rows)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in got for i in x], "<u4"), np.array([len(x) for x in got], np.int64)

    def learn(self, words: list[str]) -> None:
        marks = np.fromiter((len(RUN.findall(w)) if self.joins and PLAIN.fullmatch(w) else 0 for w in words), np.int64, len(words))
        plain, lengths, values = marks > 0, np.zeros(len(words), np.int64), []
        at = np.flatnonzero(plain)
        for k in range(0, len(at), JOINED):
            some = at[k : k + JOINED]
            ids, _ = self.whole([" ".join([words[i] for i in some])])
            last = np.flatnonzero(self.ends[ids])
            if len(last) != marks[some].sum() or len(ids) != last[-1] + 1:
                raise ValueError("a plain word doesn't have as many tokens with the end mark as runs")
            lengths[some] = np.diff(last[np.cumsum(marks[some]) - 1], prepend=-1)
            values.append(ids)
        at = np.flatnonzero(~plain)
        ids, n = self.whole([words[i] for i in at]) if len(at) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        lengths[at] = n
        # both lists are in order of the words, and are put together in that order
        of_plain = np.repeat(plain, lengths)
        out = np.zeros(lengths.sum(), "<u4")
        out[of_plain], out[~of_plain] = np.concatenate(values) if values else 0, ids
        self.table.extend(out, lengths)

    def ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """texts: an Arrow array of strings without nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_word:
            return self.whole(texts.to_pylist())
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words = lists.flatten().dictionary_encode()
        rows = self.memory.of(words.dictionary.to_pylist())
        values, lengths = self.table.take(rows[words.indices.to_numpy()])
        n_words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(n_words)])]
        return values, np.diff(ends)


@functools.lru_cache(maxsize=2)
def coder_of(path: str) -> WordCoder:
    """One for a Python worker, so that what it remembers serves all its tasks."""
    return WordCoder(path)


def token_pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, place[, ids]), a row per piece.

    A document's ids, ended by end_id, are cut after every `length` of them; the rest, if any, is a piece of its own. part
    is the number of the task that made the piece, place its number among that task's pieces of the same length. A null
    text counts as empty and has end_id alone; repeated rows are packed each, null ids kept, other columns not read.
    """
    path = path or default_tokenizer()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        coder, part = coder_of(path), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for begin, end in parts(pc.binary_length(texts).to_pylist()):
                ids, n = coder.ids(texts.slice(begin, end - begin))
                tokens = n + 1
                stream = np.full(tokens.sum(), end_id, "<u4")
                first = np.cumsum(tokens) - tokens
                stream[runs(first, n)] = ids
                pieces = -(-tokens // length)
                starts = runs(np.zeros_like(pieces), pieces) * length
                own = np.minimum(np.repeat(tokens, pieces) - starts, length)
                at = np.repeat(first, pieces) + starts
                cut = [stream[a : a + m] for a, m in zip(at.tolist(), own.tolist())]
                # the place of each piece among those of its length, in order of rows
                order = np.argsort(own, kind="stable")
                ordered = own[order]
                new = np.flatnonzero(np.diff(ordered, prepend=-1))
                place = np.empty(len(own), np.int64)
                place[order] = np.arange(len(own)) - np.repeat(new, np.diff(new, append=len(own))) + seen[ordered]
                seen += np.bincount(own, minlength=length + 1)
                columns = [
                    batch.column(0).slice(begin, end - begin).take(pa.array(np.repeat(np.arange(end - begin), pieces))),
                    *(pa.array(x) for x in (starts, own, np.fromiter(map(zlib.crc32, cut), np.int64, len(cut)), np.repeat(tokens, pieces), np.full(len(own), part, np.int64), place)),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32)), pa.array(stream.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place", *(["ids"] if with_ids else [])]
    schema = ", ".join(f"{x} {'array<int>' if x == 'ids' else 'long'}" for x in names)
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, schema)


@dataclass
class Pattern:
    """`count` sequences that hold pieces of these lengths, (length, how many), falling."""

    slots: tuple[tuple[int, int], ...]
    count: int

    @property
    def filled(self) -> int:
        return sum(length * n for length, n in self.slots)


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[Pattern]:
    """Packing patterns that hold every piece of the histogram (length -> pieces) exactly once.

    Lengths are placed longest first, each into the packs with most room, and into new ones when none has enough. One
    step moves as many packs as there are of one pattern, or as pieces are left: its cost follows the number of lengths
    and patterns, not of pieces.
    """
    if any(not 0 < x <= length for x in histogram):
        raise ValueError(f"lengths are from 1 to {length}")
    rooms: dict[int, list[Pattern]] = {}

    def put(slots: tuple[tuple[int, int], ...], count: int) -> None:
        made = Pattern(slots, count)
        rooms.setdefault(length - made.filled, []).append(made)

    for size in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[size]
        while left:
            most = max(rooms, default=0)
            if most < size:
                # a new pack is the one with most room, so it takes pieces of this length until it is full
                each = length // size
                if left >= each:
                    put(((size, each),), left // each)
                if left % each:
                    put(((size, left % each),), 1)
                break
            pack = rooms[most].pop()
            if not rooms[most]:
                del rooms[most]
            # all packs of the pattern take the same number of pieces, as long as that keeps them the emptiest
            again = max(1, min(left // pack.count, (most - max(rooms, default=0)) // size)) if pack.count <= left else 1
            moved = min(pack.count, left)
            if pack.count > moved:
                rooms.setdefault(most, []).append(Pattern(pack.slots, pack.count - moved))
            again = min(again, most // size)
            top = pack.slots[-1]
            slots = (*pack.slots[:-1], (size, top[1] + again)) if top[0] == size else (*pack.slots, (size, again))
            put(slots, moved)
            left -= moved * again
    return [p for _, some in sorted(rooms.items()) for p in some]


@dataclass
class Slots:
    """Where the pieces of each length and rank go. A row says that the ranks from `rank` on fill the slots of one length
    of one pattern: `count` sequences from `first` on get one each at `offset`, then one each behind it, and so on."""

    key: np.ndarray  # length and first rank in one number, rising
    rank: np.ndarray
    count: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int

    @staticmethod
    def keys(lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        return (lengths.astype(np.int64) << 48) + ranks

    @staticmethod
    def of(patterns: list[Pattern]) -> Slots:
        used: dict[int, int] = {}
        rows, first = [], 0
        for p in patterns:
            offset = 0
            for size, n in p.slots:
                rank = used.get(size, 0)
                rows.append((size, rank, p.count, first, offset))
                used[size] = rank + n * p.count
                offset += n * size
            first += p.count
        size, rank, count, begin, offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        return Slots(Slots.keys(size, rank), rank, count, begin, offset, first)

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        k = np.searchsorted(self.key, self.keys(lengths, ranks), "right") - 1
        layer, sequence = np.divmod(ranks - self.rank[k], self.count[k])
        return self.first[k] + sequence, self.offset[k] + layer * lengths


def packed(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces, as token_pieces() gives them and as a table that is read three times here, with sequence_id and offset.

    Pieces are ranked within their length by task and place: the counts per task and length, which are all that is sorted,
    give each task its first rank. A length that a third of all pieces have is spread over the tasks that made them. The
    table of slots has a row per pattern and length: at most 2 x `length` patterns of at most 64 different lengths at the
    contract's size, whatever the corpus; it goes to the tasks.
    """
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = Slots.of(shortest_pack_first(histogram, length))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, ranks = (batch.column(x).to_numpy() for x in ("length", "rank"))
            sequence, offset = slots.find(sizes, ranks)
            held = [x for x in batch.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in held), pa.array(sequence), pa.array(offset)], names=[*held, "sequence_id", "offset"])

    own = [x for x in pieces.columns if x not in ("part", "place")]
    ranked = pieces.join(starts, ["part", "length"]).select(*own, (F.col("begin") + F.col("place")).alias("rank"))
    kinds = dict(pieces.dtypes)
    return ranked.mapInArrow(run, ", ".join(f"{x} {kinds[x]}" for x in own) + ", sequence_id long, offset long")


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens, pieces) of packed pieces with ids: the row of ids that training reads, padded to
    `length` save where their number is a power of two, and the pieces (doc_id, start, length, offset) in order. A
    sequence holds at most `length` pieces."""
    one = F.struct("offset", "doc_id", "start", "length", "ids")
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(one)).alias("p")).withColumn("n_tokens", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]))
    whole = F.flatten(F.col("p.ids"))
    even = F.bit_count("n_tokens") == 1
    padded = F.when(even, whole).otherwise(F.concat(whole, F.array_repeat(F.lit(pad_id), (length - F.col("n_tokens")).cast("int"))))
    return rows.select("sequence_id", padded.alias("ids"), "n_tokens", F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset"))).alias("pieces"))


def pack_documents(docs: DataFrame, scratch: Scratch, length: int = LENGTH, **options) -> DataFrame:
    """Pieces of all documents with their sequence and offset. An empty table gives an empty result."""
    return packed(scratch.put(token_pieces(docs, length=length, **options)), length)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), Scratch(spark, "packing"))
