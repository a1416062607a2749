"""Quality classifier from weak labels: EM over overlapping heuristic labellers, then a hashed linear scorer.

Two label models share the method. Quality: labellers judge a text's form. Toxicity: one labeller knows words of abuse,
the others are lexicons of word beginnings, each of another length, drawn from a bounded labelled sample in all
languages. For each, EM over the votes on all documents gives posterior labels, and a hashed linear scorer is trained
on the posteriors of a bounded sample. The scorers give the verdict; words of abuse have a feature of their own there.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import table
from lattica.llm.quality import gone, measured

#: Votes, and the first two also classes. Of the toxicity labellers BAD means toxic and GOOD clean.
BAD, GOOD, SILENT = 0, 1, 2
BUCKETS = 1 << 15
#: The quality scorer is fitted on so many documents, those with the least hashes of their ids.
FIT_ROWS = 3000
KEEP_FROM = 0.5
#: Short texts count as if they had so many features, so that few words give little evidence.
LEAST_LENGTH = 32
#: Words of abuse; their labeller votes on a text with ABUSE_FROM of them or more.
ABUSE = frozenset("""idiot idiots idiotic moron morons moronic stupid stupidity scum scumbag loser losers trash garbage pathetic worthless
disgusting clown clowns dumb dumbass imbecile cretin filth filthy vermin jerk bastard bitch slut whore asshole retard pig pigs freak
coward cowards degenerate""".split())
ABUSE_FROM = 2
#: Toxicity labellers and scorer are fitted on so many documents at most that are labelled 0 and 1, those with the least
#: hashes of their ids.
TOXIC_ROWS = (3000, 1500)
#: Lengths of the word beginnings of the lexicons, and how often a text must hold a beginning.
STEMS = (4, 5, 7)
TIMES = (1, 2, 4)
TOXIC_BUCKETS = 1 << 20
#: A lexicon votes clean if its log odds of a toxic text are under the first, toxic if they are over the second.
CLEAN_UNDER, TOXIC_OVER = -1.0, 0.0
_LETTERS = bytes(b if 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[str]:
    """Lower-cased runs of ASCII letters and of all characters beyond ASCII."""
    return text.lower().encode("utf-8", "replace").translate(_LETTERS).decode().split()


def beginnings(word: str, lengths: tuple[int, ...]) -> frozenset[int]:
    """Buckets of a word's beginnings of these lengths; a shorter word is one of its own. Where several lengths are
    asked for, as the scorer does, words of abuse share one more bucket."""
    found = {f"{k}{word[:k]}" for k in lengths} | ({"abuse"} if len(lengths) > 1 and word in ABUSE else set())
    return frozenset(zlib.crc32(f.encode("utf-8", "replace")) % TOXIC_BUCKETS for f in found)


@dataclass
class Beginnings:
    """Log odds of a toxic text from the word beginnings of some lengths that it holds.

    Only words count whose first letters, as many as the shortest length, begin a word of the sample that has a weight;
    so most words are passed over without hashing, and few by chance share a bucket with a weight.
    """

    lengths: tuple[int, ...]
    #: For each bucket its weight if it occurs TIMES[0] times or more, TIMES[1] times or more, and so on.
    weights: dict[int, tuple[float, ...]] = field(default_factory=dict)
    bias: float = -5.0
    first: frozenset[str] = frozenset()

    def score(self, words: Iterable[str]) -> float:
        k, first, found = STEMS[0], self.first, Counter()
        for w, n in Counter([w for w in words if w[:k] in first]).items():
            for b in beginnings(w, self.lengths):
                if b in self.weights:
                    found[b] += n
        return self.bias + sum(v for b, n in found.items() for v, t in zip(self.weights[b], TIMES) if n >= t)


class Sample:
    """Texts as counts of words: different words once, and for each text arrays of their numbers and counts."""

    def __init__(self, texts: Iterable[Iterable[tuple[str, int]]] = ()):
        number: dict[str, int] = {}
        self.rows = []
        for text in texts:
            pairs = [(number.setdefault(w, len(number)), n) for w, n in text]
            self.rows.append(tuple(np.array(pairs, np.int32).reshape(-1, 2).T))
        self.words = list(number)

    def __len__(self) -> int:
        return len(self.rows)

    def text(self, i: int) -> list[str]:
        """The words of a text, sorted by their numbers."""
        k, n = self.rows[i]
        return [self.words[j] for j in np.repeat(k, n).tolist()]


def learn_beginnings(sample: Sample, target: np.ndarray, odds: float, lengths: tuple[int, ...] = STEMS, steps: int = 300, decay: float = 1e-3, least: int = 5, strong: float = 4.0) -> Beginnings:
    """Logistic regression of soft labels on the beginnings of a sample's words, by Adam steps, over those that `least`
    toxic texts or more hold and whose share differs between the classes by `strong` standard errors. odds: of toxic
    texts to others among all labelled ones, for a sample that is richer in them."""
    y = np.asarray(target, float)
    n1, n0 = y.sum(), len(y) - y.sum()
    if n1 < 1e-9 or n0 < 1e-9 or not sample.words:
        return Beginnings(lengths)
    begins = [sorted(beginnings(w, lengths)) for w in sample.words]
    size = np.array([len(x) for x in begins])
    flat, start = np.concatenate([np.array(x, np.int64) for x in begins]), size.cumsum() - size
    text = np.repeat(np.arange(len(y)), [len(k) for k, _ in sample.rows])
    own = np.concatenate([k for k, _ in sample.rows])
    times = np.repeat(np.concatenate([n for _, n in sample.rows]), size[own])
    inside = np.arange(len(times)) - np.repeat(size[own].cumsum() - size[own], size[own])
    found, at = np.unique(np.repeat(text, size[own]) * TOXIC_BUCKETS + flat[np.repeat(start[own], size[own]) + inside], return_inverse=True)
    times = np.bincount(at.ravel(), times).astype(np.int64)
    text, bucket = found // TOXIC_BUCKETS, found % TOXIC_BUCKETS
    known = np.flatnonzero(np.bincount(bucket[y[text] > 0.5], minlength=TOXIC_BUCKETS) >= least)
    number = np.full(TOXIC_BUCKETS, -1, np.int64)
    number[known] = np.arange(len(known))
    row, column = (np.concatenate(x) for x in zip(*[(text[m], number[bucket[m]] * len(TIMES) + j) for j, t in enumerate(TIMES) for m in [(times >= t) & (number[bucket] >= 0)]]))
    size = len(known) * len(TIMES)
    held = np.bincount(column, minlength=size)
    toxic = np.bincount(column, y[row], size)
    share = held / len(y)
    apart = (toxic / n1 - (held - toxic) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    picked = (np.abs(apart) > strong) & (held >= least)
    row, column = row[picked[column]], column[picked[column]]
    w = np.append(np.zeros(size), np.log(n1 / n0))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        error = 1 / (1 + np.exp(-(np.bincount(row, w[column], len(y)) + w[-1]))) - y
        step = np.append(np.bincount(column, error[row], size) / len(y) + decay * w[:-1], error.mean())
        mean, square = 0.9 * mean + 0.1 * step, 0.999 * square + 0.001 * step * step
        w -= 0.03 * mean / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    picked = picked.reshape(-1, len(TIMES)).any(1)
    weights = {int(k): tuple(x) for k, x in zip(known[picked], w[:-1].reshape(-1, len(TIMES))[picked].tolist())}
    first = frozenset(x[: STEMS[0]] for x, at in zip(sample.words, begins) if any(k in weights for k in at))
    return Beginnings(lengths, weights, float(w[-1] + np.log(odds) - np.log(n1 / n0)), first)


def toxic_votes(words: list[str], lexicons: list[Beginnings]) -> list[int]:
    """One vote of the labeller that knows words of abuse, and of each lexicon."""
    k, first = STEMS[0], frozenset().union(*(x.first for x in lexicons))
    scores = [x.score(some) for some in ([w for w in words if w[:k] in first],) for x in lexicons]
    return [BAD if sum(w in ABUSE for w in words) >= ABUSE_FROM else SILENT, *[BAD if s > TOXIC_OVER else GOOD if s < CLEAN_UNDER else SILENT for s in scores]]


#: Bytes by make: small letters, among them all of which is no ASCII, large ones, digits, others as they are.
_MAKE = bytes(ord("a") if 97 <= b < 123 or b >= 128 else ord("A") if 65 <= b < 91 else ord("0") if 48 <= b < 58 else b for b in range(256))
_LOWER, _LEADS = bytes(range(97, 123)), bytes(range(0xC2, 0xF5))


def alphabetic(make: bytes) -> bool:
    return bool(make) and not make.strip(b"aA")


def shape(make: bytes) -> bytes:
    """Case, and what stands beside the letters, of a word given by its bytes' make: shared by words of one make."""
    case = b"U" if len(make) > 1 and b"a" not in make and b"A" in make else b"l"
    return case + (b"" if alphabetic(make) else make[-1:] if alphabetic(make[:-1]) else b"~" + make[-2:])


def votes(text: str | None) -> list[int]:
    """One vote of each labeller. The first four judge either way; the others each know one kind of defect, overlap
    with each other and with the first, and are silent on a text without it."""
    text = text or ""
    counts, f, most = measured(text)
    n, most = counts[0], most / max(counts[0], 1)
    _, length, symbols, dup_lines, repeats, upper, digits, marks, distinct = f
    data = text.encode("utf-8", "replace")
    ends = sum(text.count(c) for c in ".?!")
    lower = (gone(data, _LOWER) + gone(data, _LEADS)) / max(counts[1], 1)
    makes = Counter(data.translate(_MAKE).split())
    plain = sum(k for w, k in makes.items() if alphabetic(w) or alphabetic(w[:-1])) / max(makes.total(), 1)
    heard = n >= 5
    pick = lambda bad, good: BAD if bad else GOOD if good else SILENT
    flag = lambda bad: BAD if bad else SILENT
    return [
        pick(n == 0 or heard and lower < 0.75, heard and lower > 0.88),
        pick(n == 0 or heard and plain < 0.6, heard and plain > 0.9),
        pick(heard and (n > 30 and ends == 0 or ends > 0.5 * n), heard and 0.01 * n < ends < 0.4 * n),
        pick(n == 0 or heard and (length > 15 or length < 2), heard and 2.5 < length < 11),
        flag(symbols > 0.06),
        flag(sum(c in text for c in "#*$%&|<>") >= 3 and symbols > 0.02),
        flag(heard and upper > 0.4),
        flag(heard and marks > 0.15),
        flag(n > 20 and repeats > 0.5),
        flag(n > 20 and distinct < 0.2),
        flag(n > 20 and most > 0.2),
        flag(n > 20 and most > 0.2 and repeats > 0.2),
        flag(dup_lines > 0.3),
        flag(digits > 0.3),
    ]


LABELLERS = 14


@dataclass
class LabelModel:
    prior: float
    #: theta[labeller, class, vote]
    theta: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of GOOD for rows of votes."""
        at = np.arange(self.theta.shape[0])[None, :]
        good = np.log(self.prior) + np.log(self.theta[at, GOOD, v]).sum(1)
        bad = np.log(1 - self.prior) + np.log(self.theta[at, BAD, v]).sum(1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def expectation_maximisation(v: np.ndarray, weight: np.ndarray, rounds: int = 60, smooth: float = 1.0) -> LabelModel:
    """Accuracies of labellers that are independent given the class, from patterns of votes and their counts.

    Starts from labellers that are better than chance, which fixes which class is which. Without rows it stays there.
    """
    labellers = v.shape[1]
    start = np.array([[0.5, 0.15, 0.35], [0.1, 0.6, 0.3]])
    model = LabelModel(0.8, np.repeat(start[None], labellers, 0))
    for _ in range(rounds if weight.sum() else 0):
        good = model.posterior(v)
        mass = np.stack([(1 - good) * weight, good * weight])
        theta = np.empty_like(model.theta)
        for j in range(labellers):
            for c in (BAD, GOOD):
                got = np.bincount(v[:, j], mass[c], 3) + smooth * start[c]
                theta[j, c] = got / got.sum()
        model = LabelModel(float(np.clip((mass[GOOD].sum() + 1) / (weight.sum() + 2), 0.01, 0.99)), theta)
    return model


def hashed(text: str | None) -> np.ndarray:
    """Buckets of a text's words, case set aside, and of their shapes, each once."""
    text = text or ""
    crc = zlib.crc32
    found = {crc(w, 1) % BUCKETS for w in set(text.lower().encode("utf-8", "replace").split())}
    found |= {crc(shape(m), 2) % BUCKETS for m in set(text.encode("utf-8", "replace").translate(_MAKE).split())}
    return np.fromiter(found, np.int64, len(found))


@dataclass
class Scorer:
    weights: np.ndarray  # the bias last

    def score(self, features: np.ndarray) -> float:
        """Probability of good quality; features are scaled to length 1."""
        if not len(features):
            return 0.0
        return float(1 / (1 + np.exp(-(self.weights[features].sum() / np.sqrt(max(len(features), LEAST_LENGTH)) + self.weights[-1]))))


def fit_scorer(rows: list[np.ndarray], target: np.ndarray, steps: int = 200, rate: float = 20.0, decay: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels, by full gradient steps; rows without features are passed over."""
    keep = [i for i, r in enumerate(rows) if len(r)]
    w = np.zeros(BUCKETS + 1)
    if not keep:
        return Scorer(w)
    target = target[keep]
    sizes = np.array([len(rows[i]) for i in keep])
    column = np.concatenate([rows[i] for i in keep])
    row = np.repeat(np.arange(len(keep)), sizes)
    scale = np.repeat(1 / np.sqrt(np.maximum(sizes, LEAST_LENGTH)), sizes)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[column] * scale, len(keep)) + w[-1])))
        error = target - p
        step = np.bincount(column, error[row] * scale, BUCKETS + 1)
        step[-1] = error.sum()
        w += rate * (step / len(keep) - decay * w / rate)
    return Scorer(w)


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")


@dataclass
class Model:
    """What fit() learns: both label models, the labellers of toxicity, and both scorers."""

    quality: LabelModel
    scorer: Scorer
    toxicity: LabelModel
    lexicons: list[Beginnings]
    toxic_scorer: Beginnings


def fit_lexicons(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, label_col: str, rows: tuple[int, int]) -> tuple[Sample, list[Beginnings], float]:
    """The labelled sample as counts of words, which come to the driver, a lexicon for each length of STEMS, and the
    odds of toxic texts. Labels that are null or not of a document are passed over; of several for one id the greatest
    counts. Without labels of both classes there are no lexicons."""
    if labels is None:
        return Sample(), [], 1.0
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Sample(), [], 1.0
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows[y]) for y in (0, 1)]

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for i, y, t in zip(*[c.to_pylist() for c in batch.columns]):
                words = " ".join(f"{w} {n}" for w, n in sorted(Counter(words_of(t or "")).items()))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "y": pa.array([y], pa.int32()), "words": pa.array([words], pa.string())})

    texts = _columns(docs, id_col, text_col).join(F.broadcast(parts[0].union(parts[1])), "doc_id").select("doc_id", "y", "text")
    got = sorted(map(tuple, texts.mapInArrow(count, "doc_id long, y int, words string").collect()))
    sample = Sample(zip(w[::2], map(int, w[1::2])) for w in (words.split() for _, _, words in got))
    y, odds = np.array([g[1] for g in got], float), counts[1] / counts[0]
    if not 0 < y.sum() < len(y):
        return Sample(), [], odds
    return sample, [learn_beginnings(sample, y, odds, (k,)) for k in STEMS], odds


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS, toxic_rows: tuple[int, int] = TOXIC_ROWS) -> Model:
    """Label models over the votes on all documents, and scorers over bounded samples with their posteriors.

    All documents vote, in one pass; only the counts of vote patterns come to the driver (at most 3 ** LABELLERS and
    3 ** (1 + number of lexicons), whatever the input). Of the samples, hashed features and counts of words do. Without
    labels no text is toxic.
    """
    sample, lexicons, odds = fit_lexicons(docs, labels, id_col, text_col, label_col, toxic_rows)
    own, heard = _columns(docs, id_col, text_col), 1 + len(lexicons)

    def vote(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            form = [int("".join(map(str, votes(t))), 3) for t in texts]
            toxic = [int("".join(map(str, toxic_votes(words_of(t or ""), lexicons))), 3) if lexicons else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(form, pa.int32()), pa.array(toxic, pa.int32())], names=["form", "toxic"])

    patterns = own.select("text").mapInArrow(vote, "form int, toxic int").groupBy("form", "toxic").count().collect()

    def label_model(column: str, n: int) -> LabelModel:
        total: Counter = Counter()
        for r in patterns:
            total[r[column]] += r["count"]
        table_ = np.array([[int(c) for c in np.base_repr(p, 3).zfill(n)] for p in sorted(total)], np.int64).reshape(-1, n)
        return expectation_maximisation(table_, np.array([total[p] for p in sorted(total)], float))

    quality, toxicity = label_model("form", LABELLERS), label_model("toxic", heard)
    picked = own.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                t = batch.column("text")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("doc_id")[i].as_py()], pa.int64()), pa.array([votes(t)], pa.list_(pa.int32())), pa.array([sorted(hashed(t).tolist())], pa.list_(pa.int32()))], names=["doc_id", "v", "x"])

    got = own.join(F.broadcast(picked), "doc_id").mapInArrow(features, "doc_id long, v array<int>, x array<int>").collect()
    got = sorted((r.doc_id, list(r.v), list(r.x)) for r in got)
    target = quality.posterior(np.array([g[1] for g in got], np.int64).reshape(-1, LABELLERS))
    scorer = fit_scorer([np.array(g[2], np.int64) for g in got], target)
    return Model(quality, scorer, toxicity, lexicons, fit_toxic_scorer(sample, lexicons, toxicity, odds))


def fit_toxic_scorer(sample: Sample, lexicons: list[Beginnings], toxicity: LabelModel, odds: float) -> Beginnings:
    """The toxicity scorer, trained on the label model's posteriors of the sample."""
    if not lexicons:
        return Beginnings(STEMS)
    v = np.array([toxic_votes(sample.text(i), lexicons) for i in range(len(sample))], np.int64)
    return learn_beginnings(sample, 1 - toxicity.posterior(v), odds, strong=3.0)


def posteriors(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, good, toxic) for each row: what the label models say of its votes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [t.as_py() or "" for t in part.column("text")]
                good = model.quality.posterior(np.array([votes(t) for t in texts], np.int64))
                toxic = 1 - model.toxicity.posterior(np.array([toxic_votes(words_of(t), model.lexicons) for t in texts], np.int64)) if model.lexicons else np.zeros(len(texts))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "good": good, "toxic": toxic})

    return _columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, good double, toxic double")


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, toxic_score, toxic, kept) for each row: the scorers' probabilities of good quality and of a toxic
    text, and the verdicts from them.

    A null text counts as empty and scores 0, as does one of white space; neither is toxic. Repeated rows are kept,
    other columns not read. The weights, whose number is bounded whatever the input, go to each task.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [t.as_py() or "" for t in part.column("text")]
                score = np.array([model.scorer.score(hashed(t)) for t in texts])
                odds = np.array([model.toxic_scorer.score(words_of(t)) for t in texts])
                toxic = odds > 0
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": score, "toxic_score": 1 / (1 + np.exp(-np.clip(odds, -500, 500))), "toxic": toxic, "kept": (score >= KEEP_FROM) & ~toxic})

    return _columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, toxic_score double, toxic boolean, kept boolean")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
