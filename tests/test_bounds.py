import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lattica.operators import dense, match, support
from lattica.plans import compare, strategies
from lattica.plans.mine import Options, mine
from lattica.plans.strategies import EdgeBottleneck
from lattica.sources.graph import graph_by_label


@pytest.fixture
def packed(spark, monkeypatch):
    """A large graph of three close blocks: a vertex's few heaviest neighbours tell all supports."""
    monkeypatch.setattr(dense, "SMALL", 100)
    rng = random.Random(3)
    rows = [(a, b, 0, float(rng.randint(20, 30) if a // 8 == b // 8 else rng.randint(1, 9))) for a, b in combinations(range(24), 2) if a // 8 == b // 8 or rng.random() < 0.9]
    edges = spark.createDataFrame(rows, "a long, b long, el int, w double")
    return graph_by_label(spark.range(24), edges, lambda x: F.pmod(x, F.lit(2)).cast("int")).cached()


def listed(monkeypatch, f):
    with monkeypatch.context() as small:
        small.setattr(dense, "SMALL", 1 << 40)
        return f()


def test_supports_that_bounds_settle_leave_the_whole_graph_alone(packed, monkeypatch):
    run = lambda: [(p, x.mni, x.bottleneck) for p, x in mine(packed, 6, EdgeBottleneck(12.0), Options(max_edges=3, vertex_weights=False)).patterns]
    want = listed(monkeypatch, run)
    asked, inner = [], match.Occurrences.list_at_least
    monkeypatch.setattr(match.Supports, "list_at_least", lambda self, n: asked.append(self.g.adj.count()) or inner(self, n))
    assert run() == want != []
    assert asked and max(asked) < packed.adj.count()


def test_two_edge_patterns_of_large_graphs_are_measured_once(packed, monkeypatch):
    run = lambda: compare.sweep(packed, 6, (0.0, 0.5, 1.0), Options(max_edges=2)).collect()
    want = listed(monkeypatch, run)
    asked, inner = [], match.Measures.measure
    monkeypatch.setattr(match.Measures, "measure", lambda self, patterns, n=1: asked.extend(p.code for p in patterns.values()) or inner(self, patterns, n))
    monkeypatch.setattr(strategies.support, "two_paths", lambda *_: pytest.fail("all two-paths are looked at"))
    assert run() == want
    assert len(asked) == len(set(asked)) > 0


def test_cycles_that_bounds_settle_make_no_tiles(packed, monkeypatch):
    want = {tuple(r) for r in support.listed_cycles(packed, 3).collect()}
    monkeypatch.setattr(dense, "cycle_corners", lambda *_: pytest.fail("tiles are made"))
    assert {tuple(r) for r in support.four_cycles(packed, 3).collect()} == want != set()
