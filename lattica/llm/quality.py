"""Quality rules: fixed base rules, then boosted trees over document statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import trees
from lattica.llm.common import table

LEAST_WORDS = 50
#: Labelled rows that the trees are fitted on, at most so many of each class, in order of the hash of their id.
FIT_ROWS = 1500
#: A document stays if the trees give it this probability of good quality or more.
KEEP_FROM = 0.5
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!?.,;:\"'()[]{}-_/\\~^`@+="

FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share")
#: A document's score never rises with these.
MONOTONE = {2: -1, 3: -1, 4: -1}


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the trees' features."""
    return measured(text)[:2]


def measured(text: str | None) -> tuple[list[int], list[float], int]:
    """statistics(), and how often the most frequent word occurs."""
    text = text or ""
    data = text.encode()
    words = data.split()
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [line for line in data.split(b"\n") if line.strip()]
    counts = [n, chars, gone(data, SYMBOLS), len(lines) - len(set(lines)), repeated(codes, len(number))]
    some, size = max(n, 1), max(chars, 1)
    features = [math.log1p(n), chars / some, counts[2] / size, counts[3] / max(len(lines), 1), counts[4] / some, gone(data, _UPPER) / size, gone(data, _DIGITS) / size, gone(data, _MARKS) / size, len(number) / some]
    return counts, features, int(np.bincount(codes).max()) if n else 0


def gone(data: bytes, characters: bytes) -> int:
    return len(data) - len(data.translate(None, characters))


def repeated(codes: np.ndarray, different: int, window: int = 3) -> int:
    """Words, given as numbers, that lie in a window of so many words that the text has twice or more."""
    n = len(codes)
    if n <= window:
        return 0
    code = codes[: n - window + 1]
    for k in range(1, window):
        if k > 1 and different**window >= 1 << 62:
            # pairs are numbered anew, so that no product overflows
            _, code = np.unique(code, return_inverse=True)
        code = code * different + codes[k : n - window + 1 + k]
    v = np.sort(code)
    if not (v[1:] == v[:-1]).any():
        return 0
    _, code = np.unique(code, return_inverse=True)
    twice = np.bincount(code)[code] > 1
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + window, -1)
    return int((covered.cumsum()[:n] > 0).sum())


def base_failed(counts: list[int]) -> bool:
    return counts[0] < LEAST_WORDS or 100 * counts[4] > 50 * counts[0]


def judge(texts: list[str | None], forest: trees.Forest) -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base_failed, probability and kept of each text."""
    got = [statistics(t) for t in texts]
    counts = [c for c, _ in got]
    failed = np.array([base_failed(c) for c in counts], bool)
    p = 1 / (1 + np.exp(-forest.score(np.array([f for _, f in got], float).reshape(-1, len(FEATURES)))))
    return counts, failed, p, ~failed & (p >= KEEP_FROM)


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> trees.Forest:
    """Trees fitted on labelled documents: of each class the first `rows` in order of the hash of their id.

    Only these bounded samples, as statistics, come to the driver. Labels that are null or not of a document are
    passed over; without labels of both classes the trees keep every document.
    """
    known = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and i is not null")
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(rows) for y in (0, 1)]
    sample = F.broadcast(parts[0].union(parts[1]).groupBy("i").agg(F.min("y").alias("y")))
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).join(sample, "i").select("i", "t", "y")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                _, f = statistics(batch.column("t")[k].as_py())
                yield pa.RecordBatch.from_pydict({"i": [batch.column("i")[k].as_py()], "y": [batch.column("y")[k].as_py()], "x": [f]}, schema=pa.schema([("i", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))]))

    got = sorted((r.i, r.y, list(r.x)) for r in texts.mapInArrow(run, "i long, y int, x array<double>").collect())
    x = np.array([g[2] for g in got], float).reshape(-1, len(FEATURES))
    y = np.array([g[1] for g in got], float)
    if not 0 < y.sum() < len(y):
        return trees.Forest(20.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)), 0)
    return trees.fit(x, y, MONOTONE)


def quality_rules(docs: DataFrame, forest: trees.Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept) for each
    row. A null or empty text has no words and fails the base rules; repeated rows are kept, other columns not read."""

    def run(batches):
        import pyarrow as pa

        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                counts, failed, p, kept = judge([t.as_py() for t in part.column("text")], forest)
                columns = {n: pa.array([c[i] for c in counts], pa.int64()) for i, n in enumerate(names)}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | columns | {"base_failed": pa.array(failed), "probability": pa.array(p), "kept": pa.array(kept)})

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")


def keep_good(docs: DataFrame, forest: trees.Forest, text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, in one pass without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield part.filter(pa.array(judge([t.as_py() for t in part.column(at)], forest)[3]))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_rules(docs, table(spark, sf_dir, "labels")))
