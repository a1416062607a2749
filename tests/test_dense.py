import random
from dataclasses import replace
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from lattica.operators import dense, match, support
from lattica.operators.pattern import Pattern
from lattica.plans import catalogue
from lattica.plans.mine import Options, mine
from lattica.plans.strategies import VertexBottleneck
from lattica.sources.graph import graph_by_label


@pytest.fixture
def busy(spark, monkeypatch):
    """A graph of which a tenth is listed without thought, in four blocks of vertices."""
    rng = random.Random(11)
    rows = [(a, b, 0, float(rng.randint(1, 30))) for a, b in combinations(range(40), 2) if rng.random() < 0.25]
    monkeypatch.setattr(dense, "SMALL", len(rows) // 5)
    monkeypatch.setattr(dense, "TILE", 10)
    edges = spark.createDataFrame(rows, "a long, b long, el int, w double")
    return graph_by_label(spark.range(40), edges, lambda x: F.pmod(x, F.lit(3)).cast("int")).cached()


def test_cycles_by_tiles_equal_listed_ones(busy, monkeypatch):
    """The whole graph's two-paths are not written."""
    assert dense.worth_tiles(busy)
    want = {tuple(r) for r in support.listed_cycles(busy, 3).collect()}
    monkeypatch.setattr(support, "listed_cycles", lambda *_: pytest.fail("two-paths are written"))
    assert {tuple(r) for r in support.four_cycles(busy, 3).collect()} == want != set()


def test_heavy_parts_end_with_the_whole(busy):
    sizes = [g.adj.count() for g in dense.heavy_parts(busy, F.col("w"))]
    assert sizes == sorted(sizes) and len(sizes) > 1 and sizes[-1] == busy.adj.count()


def measured(m):
    return [(p, x.mni, x.bottleneck, round(x.vertex_bottleneck, 9)) for p, x in m.patterns]


def test_mining_by_parts_equals_listing(spark, busy, monkeypatch):
    """Large graphs: profiles don't list plenty of neighbours, triangles aren't listed; leaves of scarce vertices compete."""
    with monkeypatch.context() as small:
        small.setattr(dense, "SMALL", 1 << 40)
        want = measured(mine(busy, 4, options=Options(max_edges=3)))
    assert measured(mine(busy, 4, options=Options(max_edges=3))) == want != []


def test_rows_with_plenty_are_tried_once_for_their_labels(spark, monkeypatch):
    """Where no label is scarce around a row, what fits follows from the labels; supports equal those of listing."""
    rows = [(a, b, 0, 1.0) for a, b in combinations(range(40), 2) if a > 3 or b % 5 == 0]
    edges = spark.createDataFrame(rows, "a long, b long, el int, w double")
    g = graph_by_label(spark.range(40), edges, lambda x: F.pmod(x, F.lit(2)).cast("int")).cached()
    shapes = [[(0, 1, 0)], [(0, 1, 0), (1, 2, 0)], [(0, 1, 0), (1, 2, 0), (2, 3, 0)], [(0, 1, 0), (0, 2, 0), (0, 3, 0)]]
    patterns = dict(enumerate({p.code: p for e in shapes for own in product((0, 1), repeat=len(e) + 1) for p in [Pattern.of(own, e)]}.values()))
    listing, supports = match.Occurrences(g, (0, 1)), match.Supports(g, (0, 1))
    want = {k: n for k, (n, _, _) in listing.measure(patterns).items()}
    sizes, inner = [], match.Supports.tried
    monkeypatch.setattr(match.Supports, "tried", lambda self, cores, shapes: sizes.append(cores.count()) or inner(self, cores, shapes))
    assert {k: n for k, (n, _, _) in supports.measure(patterns).items()} == want != {}
    assert 0 < sum(sizes) < len(rows) / 2
    listing.close()
    supports.close()


def test_weights_that_no_one_asks_for_are_not_measured(busy, monkeypatch):
    """mine_edge_weight and mine_edge_weight_per_edge have no vertex weights in their result, mine_vertex_weight needs them."""
    assert Options().vertex_weights
    with pytest.raises(ValueError):
        mine(busy, 4, VertexBottleneck(1.0), Options(max_edges=1, vertex_weights=False))
    asked, by, cleared = [], [], []
    monkeypatch.setattr(match.Measures, "collect", lambda self: cleared.append(1))
    monkeypatch.setattr(match.Measures, "best", lambda self, patterns, name, *_: by.append(name) or {k: 20.0 for k in patterns})
    monkeypatch.setattr(catalogue, "mine", lambda g, n, strategy, options: asked.append(options) or mine(busy, 4, strategy, replace(options, max_edges=1)))
    monkeypatch.setattr(catalogue.derive, "event_graph", lambda *_, **__: busy)
    for name, want in (("mine_edge_weight_per_edge", {"w"}), ("mine_vertex_weight", {"w", "ends"})):
        by.clear()
        assert catalogue.QUERIES[name](busy.adj.sparkSession, "").count() > 0
        assert set(by) == want
    assert all(x.max_edges == 3 for x in asked) and len(cleared) == len(asked) == 2
