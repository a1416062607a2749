"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import csv
import zlib
from collections.abc import Sequence
from importlib import resources
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import map_rows, table

#: (verdict, host and path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
GRAMS = (3, 4, 5)
BUCKETS = 1 << 14
_LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})

#: The small labelled table that the model is trained from by default: rows (url, block), made-up hosts of neutral words
#: and of words of gambling, drugs, pornography, fraud and advertising.
LABELLED = "labelled_urls.csv"


def labelled(path: str | None = None) -> list[tuple[str, int]]:
    """(url, 1 to block) rows of a CSV table with a header; by default the one beside this module."""
    text = Path(path).read_text() if path else resources.files(__package__).joinpath(LABELLED).read_text()
    return [(url, int(y)) for url, y in list(csv.reader(text.splitlines()))[1:]]


def parts(url: str | None) -> tuple[str, str]:
    """Host and path: the host runs from the first :// to the next /, ? or #, with A-Z lower-cased; the path from there
    to the next ? or #. Both are empty for a null url and for one without ://."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, marks: min([k for k in map(s.find, marks) if k >= 0], default=len(s))
    end = cut(rest, "/?#")
    path = rest[end:]
    return rest[:end].translate(_LOWER), path[: cut(path, "?#")]


class Rules:
    """The longest rule that fits, by a walk up the host's domains; ties of length go to the more special host."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, domain = None, host
        while True:
            for start, rule, verdict in self.by_host.get(domain, ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            if "." not in domain:
                return best or (None, None)
            domain = domain.split(".", 1)[1]


#: Length of the path's features beside the host's, which is 1: what a path says counts less, however long it is.
PATH_LENGTH = 0.3


def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of host and path, each once, and their values; the two parts hash apart and are scaled to
    a length of their own."""
    at, values = [], []
    for mark, text, length in (("h", f"^{host}$", 1.0), ("p", f"^{path}$", PATH_LENGTH)):
        found = {zlib.crc32((mark + text[i : i + n]).encode("utf-8", "replace")) % BUCKETS for n in GRAMS for i in range(max(1, len(text) - n + 1))}
        at += found
        values += [length / len(found) ** 0.5] * len(found)
    return np.array(at, np.int64), np.array(values)


#: Share of bad urls that a score reckons with; the small table is richer in them.
PRIOR = 0.3


def train(table_: Sequence[tuple[str, int]] | None = None, steps: int = 2000, rate: float = 10.0, decay: float = 1e-4, prior: float = PRIOR) -> np.ndarray:
    """Weights, the bias last: logistic regression by full gradient steps over the small table, its bias then moved from
    the table's share of bad urls to the prior. A table of one kind, or an empty one, gives weights of zero and a bias
    that lets every url pass."""
    rows = [(*features(*parts(u)), y) for u, y in (labelled() if table_ is None else table_)]
    y = np.array([r[2] for r in rows], float)
    w = np.zeros(BUCKETS + 1)
    if not 0 < y.sum() < len(y):
        w[-1] = -1.0
        return w
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    column, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    for _ in range(steps):
        error = y - 1 / (1 + np.exp(-(np.bincount(row, w[column] * value, len(y)) + w[-1])))
        step = np.bincount(column, error[row] * value, BUCKETS + 1)
        step[-1] = error.sum()
        w += rate * (step / len(y) - decay * w)
    w[-1] += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    return w


def score(w: np.ndarray, host: str, path: str) -> float:
    """Probability that the url is to be blocked."""
    at, x = features(host, path)
    return float(1 / (1 + np.exp(-(w[at] @ x + w[-1]))))


def held_out(table_: Sequence[tuple[str, int]], folds: int = 5, block_from: float = 0.5) -> dict[str, int]:
    """Counts of blocked and passed urls of both kinds, each judged by a model trained on the other folds."""
    out = {"blocked_bad": 0, "passed_bad": 0, "blocked_good": 0, "passed_good": 0}
    for k in range(folds):
        w = train([r for i, r in enumerate(table_) if i % folds != k])
        for u, y in table_[k::folds]:
            out[("blocked" if score(w, *parts(u)) >= block_from else "passed") + ("_bad" if y else "_good")] += 1
    return out


def filter_urls(pages: DataFrame, weights: np.ndarray, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", block_from: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, probability) for each row: the longest fitting rule decides, else the model
    blocks from the given probability on.

    A url of null or without :// has an empty host and path and is judged by the model on those. Repeated rows are
    kept, other columns not read; the weights (BUCKETS numbers, whatever the input) go to each task.
    """

    def make():
        known = Rules(rules)

        def one(page, url):
            host, path = parts(url)
            rule, verdict = known.find(host, path)
            p = score(weights, host, path)
            return page, host, path, rule, verdict or ("block" if p >= block_from else "allow"), p

        return one

    return map_rows(pages.selectExpr(f"cast(`{id_col}` as long) as page_id", f"`{url_col}` as url"), make, "page_id long, host string, path string, rule string, verdict string, probability double")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), train())
