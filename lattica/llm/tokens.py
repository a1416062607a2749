"""Token counts of a unigram tokenizer without building tokens: Aho-Corasick matches and a count-only Viterbi."""

from __future__ import annotations

import functools
import math
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import map_rows, table
from lattica.llm.pieces import CHUNK, Normaliser, default_model, read_model, splits_at_marks

#: A character that no piece covers costs the worst piece's score and this much more, as in the library.
UNKNOWN_PENALTY = 10.0
#: Scores of the derived vocabulary are multiples of 1 / GRID, so that 32-bit sums are exact up to 2**24 / GRID.
GRID = 16
REMEMBERED = 400_000


def unigram_model(path: str | None = None) -> bytes:
    """A unigram model over the public vocabulary at path: its own pieces in their own order, scored by rank.

    The public files hold no unigram model and tokenizers are not trained here, so a piece of rank r gets
    -ln(r + 2), rounded to a multiple of 1 / GRID. The result is a model file that the library loads as it is.
    """
    model = read_model(path or default_model())
    rank = 0
    for p in model.pieces:
        if p.type == 1:
            p.score = -round(GRID * math.log(rank + 2)) / GRID
            rank += 1
    model.trainer_spec.model_type = 1
    return model.SerializeToString()


class TokenCounter:
    """count(text) is the number of ids that the library's Viterbi gives, without begin and end ids.

    The library's rules, kept exactly: scores add up in 32-bit floats from the start of the text; at each place the
    candidate that starts earliest wins a tie (a later one must be better); a character without a piece of its own
    is an unknown candidate, of as many ids as it has bytes if the model falls back to bytes, else runs of unknown
    characters count once; user-defined pieces score their length times the best score, less 0.1.
    """

    def __init__(self, model_bytes: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(model_bytes)
        if model.trainer_spec.model_type != 1:
            raise ValueError("not a unigram model")
        normal = [p.score for p in model.pieces if p.type == 1]
        best, worst = max(normal), min(normal)
        self.unknown = float(np.float32(worst) - np.float32(UNKNOWN_PENALTY))
        self.bytes = model.trainer_spec.byte_fallback
        self.normaliser = Normaliser(model.normalizer_spec)
        self.trie, scores = ahocorasick.Automaton(), []
        for p in model.pieces:
            if p.type in (1, 4):
                score = float(np.float32(p.score)) if p.type == 1 else float(np.float32(len(p.piece) * best - 0.1))
                self.trie.add_word(p.piece, (len(p.piece), score))
                scores.append(score)
        self.trie.make_automaton()
        # Sums of multiples of 1 / GRID are exact in 32 bits below this length, and then marks split a text for good.
        even = all(s * GRID == int(s * GRID) for s in [*scores, self.unknown])
        self.safe = int(2**24 / GRID / max(map(abs, [*scores, self.unknown]))) if even and splits_at_marks(model) else 0
        self.seen: dict[str, int] = {}

    def count(self, text: str) -> int:
        normal, _ = self.normaliser.normalise(text)
        n = len(normal)
        if n >= self.safe:  # compact columns, and each sum rounded to 32 bits
            return self.viterbi(normal, array("d", [-math.inf]) * (n + 1), array("q", [0]) * (n + 1), bytearray(n + 1), lambda x: float(np.float32(x)))
        total, seen = 0, self.seen
        for chunk in CHUNK.findall(normal):
            n = seen.get(chunk)
            if n is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                k = len(chunk) + 1
                n = seen[chunk] = self.viterbi(chunk, [-math.inf] * k, [0] * k, [0] * k, None)
            total += n
        return total

    def viterbi(self, text: str, score, count, loose, rounded) -> int:
        """Fills best score, its piece count and whether it ends in an unknown character, for each place.

        Matches come in order of their end, and of those with one end the longest comes first, which is the one that
        starts earliest. A place is settled once all matches that end there are seen.
        """
        score[0], settled, single = 0.0, 0, 0

        def unknowns(until: int) -> None:
            nonlocal settled
            while settled < until:
                settled += 1
                if single != settled:
                    got = score[settled - 1] + self.unknown
                    got = rounded(got) if rounded else got
                    if got > score[settled]:
                        more = len(text[settled - 1].encode()) if self.bytes else 0 if loose[settled - 1] else 1
                        score[settled], count[settled], loose[settled] = got, count[settled - 1] + more, 1

        for last, (length, s) in self.trie.iter(text):
            if settled < last:
                unknowns(last)
            end = last + 1
            got = score[end - length] + s
            if rounded:
                got = rounded(got)
            if got > score[end]:
                score[end], count[end] = got, count[end - length] + 1
            if length == 1:
                single = end
        unknowns(len(text))
        return count[len(text)]


@functools.lru_cache(maxsize=2)
def counter_of(model_bytes: bytes) -> TokenCounter:
    """One for a Python worker, so that what it remembers serves all its tasks."""
    return TokenCounter(model_bytes)


def token_counts(docs: DataFrame, model_bytes: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row. A null text counts as empty and has no tokens; repeated rows are kept,
    other columns not read. The vocabulary (a model file, well under a megabyte here) goes to each task."""

    def make():
        counter = counter_of(model_bytes)
        return lambda doc, text: (doc, len((text or "").encode()), counter.count(text or ""))

    return map_rows(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), make, "doc_id long, n_bytes long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), unigram_model())
