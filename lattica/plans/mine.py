"""Level-wise mining: the lattice of patterns on the driver, one batch of Spark jobs per level."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.scalars import weight_text
from lattica.operators import index, match
from lattica.operators.pattern import Pattern, grow
from lattica.plans.strategies import Measured, Strategy, Unweighted, VertexBottleneck
from lattica.sources.graph import Graph, on_tables

log = logging.getLogger(__name__)

RESULT = "code string, n_vertices int, n_edges int, labels array<int>, edges array<struct<u:int,v:int,el:int>>, support long, bottleneck double, vertex_bottleneck double"


@dataclass(frozen=True)
class Options:
    """Each leaves the result as it is, but for max_edges, limit_s and vertex_weights.

    apriori: refuse candidates with an infrequent connected part of one edge less. reduce: list only core occurrences around
    which some candidate's leaves may be found. limit_s: after so many seconds the running job is cancelled, and the result
    says that it timed out. slow_s: levels that take longer are logged. vertex_weights: without, vertex weights may be None,
    and a strategy by them is refused.
    """

    max_edges: int | None = None
    apriori: bool = True
    reduce: bool = True
    limit_s: float | None = None
    slow_s: float | None = None
    vertex_weights: bool = True


@dataclass
class Counters:
    candidates: int = 0
    frequent: int = 0
    pruned_by_apriori: int = 0
    pruned_by_strategy: int = 0
    pruned_by_structure: int = 0
    pruned_by_weight: int = 0
    rows_listed: int = 0
    levels: int = 0
    seconds: float = 0.0


@dataclass
class Mined:
    patterns: list[tuple[Pattern, Measured]]
    counters: Counters
    timed_out: bool = False
    codes: set[str] = field(default_factory=set)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per pattern, sorted by edges and code."""
        rows = [(p.code, p.n_vertices, p.n_edges, list(p.labels), list(p.edges), m.mni, m.bottleneck, m.vertex_bottleneck) for p, m in self.patterns]
        return spark.createDataFrame(rows, RESULT).orderBy("n_edges", "code")


class Deadline:
    """Cancels the jobs of the enclosed block once its time is over."""

    def __init__(self, spark: SparkSession, limit_s: float | None):
        self.context, self.limit_s, self.over = spark.sparkContext, limit_s, False
        self.tag = f"mine-{uuid.uuid4().hex}"

    def __enter__(self) -> Deadline:
        self.context.addJobTag(self.tag)
        self.ends = None if self.limit_s is None else time.monotonic() + self.limit_s
        self.timer = None
        if self.limit_s is not None:
            self.timer = threading.Timer(self.limit_s, self.stop)
            self.timer.daemon = True
            self.timer.start()
        return self

    def stop(self) -> None:
        self.over = True
        self.context.cancelJobsWithTag(self.tag)

    def passed(self) -> bool:
        self.over |= self.ends is not None and time.monotonic() >= self.ends
        return self.over

    def __exit__(self, kind, error, trace) -> bool:
        if self.timer is not None:
            self.timer.cancel()
        self.context.removeJobTag(self.tag)
        # what a cancelled job raises is the end of mining in time, nothing else is
        return self.over and kind is not None and issubclass(kind, (PySparkException, Py4JError))


def mine(g: Graph, min_sup: int, strategy: Strategy | None = None, options: Options = Options(), known: dict[str, tuple] | None = None) -> Mined:
    """All connected patterns of one edge or more with support of at least min_sup that the strategy accepts.

    Per level, candidates of all frontier patterns are pruned on the driver and measured together on the graph's tables,
    which are written to the shared folder first; runs on one graph share them inside on_tables(). known: measures by code,
    which runs on one graph with one min_sup may share too, since they don't depend on the strategy; this run adds its own.
    """
    g.complete_to(options.max_edges and options.max_edges + 1)
    strategy = strategy or Unweighted()
    if isinstance(strategy, VertexBottleneck) and not options.vertex_weights:
        raise ValueError("the strategy needs vertex weights")
    began = time.monotonic()
    counters, result, found = Counters(), [], []
    with Deadline(g.adj.sparkSession, options.limit_s) as deadline, on_tables(g) as own:
        strategy.prepare(own, min_sup)
        known = {} if known is None else known
        if not options.vertex_weights:
            known.update({code: m for code, m in getattr(strategy, "measured", {}).items() if code not in known})
        _levels(own, min_sup, strategy, options, found, counters, result, deadline, known)
    for occurrences in found:
        occurrences.close()
    counters.frequent = len(result)
    counters.seconds = time.monotonic() - began
    result.sort(key=lambda x: (x[0].n_edges, x[0].code))
    return Mined(result, counters, deadline.over, {p.code for p, _ in result})


def _levels(g: Graph, min_sup: int, strategy: Strategy, options: Options, found: list[match.Measures], counters: Counters, result: list, deadline: Deadline, known: dict[str, tuple]) -> None:
    labels = {r["label"] for r in index.frequent_labels(g, min_sup).collect()}
    triples = {tuple(r) for r in index.edge_triples(g).collect()}
    edge_labels = {t[2] for t in triples}
    seen, frequent = set(), set()

    def considered(p: Pattern) -> bool:
        if p.code in seen:
            return False
        seen.add(p.code)
        if reason := strategy.pruned(p):
            setattr(counters, reason, getattr(counters, reason) + 1)
            return False
        if options.apriori and p.n_edges > 1 and any(q.code not in frequent for q in p.smaller()):
            counters.pruned_by_apriori += 1
            return False
        counters.candidates += 1
        return True

    first = [Pattern.single_edge(*t) for t in sorted(triples) if t[0] in labels and t[1] in labels]
    level = [p for p in first if considered(p)]
    # rows that no candidate wants may be wanted by later ones if candidates are known already
    found.append(match.Measures(g, labels, options.reduce and not known, options.vertex_weights))
    while level:
        counters.levels += 1
        at = time.monotonic()
        new = {k: p for k, p in enumerate(level) if p.code not in known}
        measured = found[0].measure(new, min_sup)
        known.update((p.code, measured.get(k, (0, None, None))) for k, p in new.items())
        counters.rows_listed = found[0].rows
        if options.slow_s is not None and time.monotonic() - at > options.slow_s:
            log.warning("level %d: %d candidates took %.1f s", counters.levels, len(level), time.monotonic() - at)
        frontier: list[Pattern] = []
        for k, p in enumerate(level):
            m = Measured(*known[p.code])
            if m.mni < min_sup:
                continue
            frequent.add(p.code)
            if strategy.extended(p, m):
                frontier.append(p)
            if strategy.accepted(p, m):
                result.append((p, m))
        if options.max_edges and counters.levels >= options.max_edges:
            return
        if frontier and deadline.passed():
            return
        level = [x.child for p in frontier for x in grow(p, labels, edge_labels, triples) if considered(x.child)]
    deadline.over = False


def pattern_rows(spark: SparkSession, mined: Mined) -> DataFrame:
    """Pattern text, in the order of the result."""
    rows = [(k, p.to_text(), m.mni) for k, (p, m) in enumerate(mined.patterns)]
    return spark.createDataFrame(rows, "no int, text string, support long")


def metrics_row(spark: SparkSession, name: str, dataset: str, min_sup: int, least: float | None, mined: Mined) -> DataFrame:
    c = mined.counters
    row = (name, dataset, min_sup, least, c.candidates, c.frequent, c.pruned_by_apriori, c.pruned_by_strategy, c.pruned_by_structure, c.pruned_by_weight, int(c.seconds * 1000))
    out = spark.createDataFrame([row], "algorithm string, dataset string, min_sup int, least double, candidates int, frequent int, pruned_by_apriori int, pruned_by_strategy int, pruned_by_structure int, pruned_by_weight int, time_ms long")
    return out.withColumn("min_weight", weight_text(F.col("least"))).drop("least")
