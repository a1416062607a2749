"""SentencePiece encoding and decoding with byte offsets.

The normaliser walks the model's compiled character map itself (longest prefix first) and records, for each byte of
the normalised text, the byte of the source it came from; pieces are projected to source spans through that record.
The library segments the normalised text and decodes.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import map_rows, table

SPACE_MARK = "▁"
#: Runs of marks with the text up to the next mark: no piece of a model that passes splits_at_marks() crosses their borders.
CHUNK = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
#: Encoded chunks that a task remembers; when full, it starts anew.
REMEMBERED = 250_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def splits_at_marks(model) -> bool:
    """True if no piece has a mark after another character, so that no segmentation crosses the start of a mark run."""
    return not model.trainer_spec.treat_whitespace_as_suffix and all(SPACE_MARK not in p.piece.lstrip(SPACE_MARK) for p in model.pieces if p.type in (1, 4, 5))


class CharacterMap:
    """The compiled map: a size, a double-array trie of 32-bit units, then replacement strings that end in a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes that the longest key at this place takes, and its replacement."""
        if not self.units:
            return None
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        node, best = step(self.units[0]), None
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(self.units) or (unit := self.units[node]) & 0x800000FF != text[k]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                best = (k + 1 - at, self.units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.strings[best[1] : self.strings.index(b"\0", best[1])]


class Normaliser:
    """normalise(text) gives the normalised text and, for each of its bytes and its end, the source byte."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.mark = SPACE_MARK.encode() if spec.escape_whitespaces else b" "

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        source = text.encode()
        if not source:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze and len(self.mark) == 3:
            widths = np.where(np.frombuffer(source, np.uint8) == 32, 3, 1)
            align = np.repeat(np.arange(len(source)), widths)
            head = np.zeros(3 * self.prefix, np.int64)
            return SPACE_MARK * self.prefix + text.replace(" ", SPACE_MARK), np.concatenate([head, align, [len(source)]])
        return self.walk(source)

    def walk(self, source: bytes) -> tuple[str, np.ndarray]:
        out, align, at, end = bytearray(), [], 0, len(source)
        if self.squeeze:
            while at < end:
                took, became = self.step(source, at)
                if became != b" ":
                    break
                at += took
            if at == end:
                return "", np.zeros(1, np.int64)
        if self.prefix:
            out += self.mark
            align += [at] * len(self.mark)
        blank = self.squeeze
        while at < end:
            took, became = self.step(source, at)
            if blank:
                became = became.lstrip(b" ")
            if became:
                for c in became:
                    piece = self.mark if c == 32 else bytes([c])
                    out += piece
                    align += [at] * len(piece)
                blank = self.squeeze and became.endswith(b" ")
            at += took
            if not self.squeeze:
                blank = False
        if self.squeeze:
            while out.endswith(self.mark):
                del out[-len(self.mark) :]
                at = align[-len(self.mark)]
                del align[-len(self.mark) :]
        return out.decode(), np.array([*align, at], np.int64)

    def step(self, source: bytes, at: int) -> tuple[int, bytes]:
        if found := self.map.longest(source, at):
            return found
        b = source[at]
        n = 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        return n, source[at : at + n]


@dataclass
class Encoded:
    ids: np.ndarray  # without begin and end
    begins: np.ndarray  # each piece's first source byte
    ends: np.ndarray


class PieceCoder:
    """encode() with spans, as the library encodes; decode() of ids is the library's."""

    def __init__(self, path: str):
        import sentencepiece

        model = read_model(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normaliser = Normaliser(model.normalizer_spec)
        self.begin, self.end, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        self.widths = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.by_chunk = model.trainer_spec.model_type == 2 and splits_at_marks(model)
        spec = model.normalizer_spec
        spec.name, spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", b"", False, False, False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.seen: dict[str, bytes] = {}

    def ids(self, normal: str, remember: bool = True) -> np.ndarray:
        """Of normalised text. Byte-pair merges never cross a chunk's border, so each chunk is segmented once; a caller that
        remembers results of its own has chunks remembered for this text alone."""
        if not self.by_chunk:
            return np.array(self.plain.encode(normal), np.uint32)
        seen = self.seen if remember else {}
        chunks = CHUNK.findall(normal)
        new = list({c for c in chunks if c not in seen})
        if new:
            if len(seen) + len(new) > REMEMBERED:
                seen.clear()
                new = list(set(chunks))
            for c, i in zip(new, self.plain.encode(new, num_threads=1)):
                seen[c] = np.array(i, "<u4").tobytes()
        return np.frombuffer(b"".join([seen[c] for c in chunks]), "<u4")

    def encode(self, text: str) -> Encoded:
        normal, align = self.normaliser.normalise(text)
        ids = self.ids(normal) if normal else np.zeros(0, "<u4")
        widths = self.widths[ids]
        if (ids == self.unknown).any():
            at = {k: len(p.surface.encode()) for k, p in enumerate(self.plain.encode(normal, out_type="immutable_proto").pieces) if p.id == self.unknown}
            widths[list(at)] = list(at.values())
        ends = np.cumsum(widths)
        return Encoded(ids, align[ends - widths], align[ends])

    def decode(self, ids) -> str:
        return self.library.decode(ids)


@functools.lru_cache(maxsize=2)
def coder_of(path: str) -> PieceCoder:
    """One for a Python worker, so that what it remembers serves all its tasks."""
    return PieceCoder(path)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, begins, ends, decoded for each row: piece ids with begin and end ids, source byte spans of the pieces
    between them, and the decoded text. A null text counts as empty and has the two ids alone; repeated rows are kept,
    other columns not read."""
    path = path or default_model()

    def make():
        coder = coder_of(path)

        def one(doc, text):
            e = coder.encode(text or "")
            ids = [coder.begin, *e.ids.tolist(), coder.end]
            return doc, ids, e.begins.tolist(), e.ends.tolist(), coder.decode(ids)

        return one

    return map_rows(docs.selectExpr(f"cast(`{id_col}` as long) as id", f"`{text_col}` as text"), make, "id long, ids array<int>, begins array<long>, ends array<long>, decoded string")


def encoding_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """As encode_documents, with digests in the place of the lists and the text, made in the same task; with_ids keeps
    the list of ids beside them, for training. carried: whole-number columns that come through as they are."""
    path = path or default_model()

    def make():
        coder = coder_of(path)
        head, tail = (np.array([i], "<u4").tobytes() for i in (coder.begin, coder.end))

        def one(doc, text, *more):
            e = coder.encode(text or "")
            ids = head + e.ids.tobytes() + tail
            spans = np.stack([e.begins, e.ends], 1).astype("<u4").tobytes()
            numbers = np.frombuffer(ids, "<i4")
            decoded = coder.decode(numbers.tolist())
            return doc, len(numbers), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), hashlib.sha256(spans).hexdigest(), *([numbers] if with_ids else []), *more

        return one

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string" + ", ids array<int>" * with_ids + "".join(f", {c} long" for c in carried)
    return map_rows(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text", *[f"`{c}`" for c in carried]), make, schema)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"))
