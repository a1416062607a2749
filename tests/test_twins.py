import random
from datetime import datetime, timedelta
from itertools import product

import pytest

from lattica.operators import dense, match, support
from lattica.operators.pattern import Pattern
from lattica.plans import catalogue, compare
from lattica.plans.mine import Options, mine
from lattica.plans.strategies import EdgeBottleneck
from lattica.sources import derive
from lattica.sources.graph import make_graph


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """Events of 9 users, some of them copied up to 7 times with the same hours; one user shares nothing, one is null."""
    rng, rows = random.Random(8), []
    for u in range(9):
        slots = [(rng.choice("xy"), rng.randrange(7)) for _ in range(rng.randrange(5, 12))]
        for copy in range((1, 7, 2, 5)[u % 4]):
            rows += [(u + 10 * copy, t, datetime(2024, 1, 1) + timedelta(hours=h, minutes=rng.randrange(60))) for t, h in slots]
    rows += [(777, "z", datetime(2024, 1, 1)), (None, "x", datetime(2024, 1, 1)), (778, "x", datetime(2024, 1, 1))]
    path = tmp_path_factory.mktemp("crowd")
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp").write.parquet(f"{path}/events.parquet")
    return str(path)


def rounded(rows):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in rows)


def test_vertices_left_out_are_counted(spark, crowd):
    whole, few = derive.event_graph(spark, crowd), derive.event_graph(spark, crowd, upto=4)
    assert few.edges.count() < whole.edges.count() / 1.5
    assert rounded(few.vertices.collect()) == rounded(whole.vertices.collect())
    both = [mine(g, 6, options=Options(max_edges=3)) for g in (whole, few)]
    assert both[0].patterns and [(p, round(m.mni, 9), m.bottleneck, round(m.vertex_bottleneck, 9)) for p, m in both[0].patterns] == [(p, m.mni, m.bottleneck, round(m.vertex_bottleneck, 9)) for p, m in both[1].patterns]
    for shape in (support.two_paths, support.four_cycles):
        assert rounded(shape(whole, 3).collect()) == rounded(shape(few, 3).collect()) != []


def test_larger_patterns_are_refused(spark, crowd):
    few = derive.event_graph(spark, crowd, upto=3)
    with pytest.raises(ValueError):
        mine(few, 6, options=Options(max_edges=3))
    with pytest.raises(ValueError):
        mine(few, 6)
    with pytest.raises(ValueError):
        support.four_cycles(few)


def test_edge_labels_of_a_crowd(spark, crowd, monkeypatch):
    """The query mines the edges of twins that two-edge patterns need, and no others."""
    seen = []
    original = catalogue.mine
    monkeypatch.setattr(catalogue, "mine", lambda g, *a, **k: seen.append(g.edges.count()) or original(g, *a, **k))
    found = rounded(catalogue.mine_edge_labels(spark, crowd).collect())
    whole = derive.event_graph(spark, crowd)
    assert seen[0] < whole.edges.count() / 2 and found
    odd = (whole.edges["w"] % 2).cast("int")
    m = original(make_graph(whole.vertices.select("id", "label"), whole.edges.withColumn("el", odd)), 6, options=Options(max_edges=2))
    assert found == rounded([(catalogue.labelled_text(p), p.n_edges, x.mni, x.bottleneck) for p, x in m.patterns])


def test_sweep_measures_a_pattern_once(spark, crowd, monkeypatch):
    """tau_sweep's three thresholds share measures; the counts are those of runs that don't."""
    seen, kept = [], []
    original = match.Measures.measure
    monkeypatch.setattr(match.Measures, "measure", lambda self, patterns, *a: seen.extend(p.code for p in patterns.values()) or original(self, patterns, *a))
    inner = compare.sweep
    monkeypatch.setattr(compare, "sweep", lambda g, *a: kept.append(g.twins.upto) or inner(g, *a))
    monkeypatch.setattr(catalogue, "EVENT_SUPPORT", 5)
    rows = catalogue.tau_sweep(spark, crowd).collect()
    assert kept == [3] and len(seen) == len(set(seen))
    monkeypatch.undo()
    whole = derive.event_graph(spark, crowd)
    for q, least, freq in rows:
        assert freq == len(mine(whole, 5, EdgeBottleneck(least), Options(max_edges=2)).patterns)
    assert rows[0]["freq"] > 0


def test_strategies_share_measures(spark, crowd, monkeypatch):
    """strategy_compare measures a pattern once; the numbers are those of runs of their own."""
    seen = []
    original = match.Measures.measure
    monkeypatch.setattr(match.Measures, "measure", lambda self, patterns, *a: seen.extend(p.code for p in patterns.values()) or original(self, patterns, *a))
    monkeypatch.setattr(catalogue, "EVENT_SUPPORT", 8)
    freq = {r["algorithm"]: r["freq"] for r in catalogue.strategy_compare(spark, crowd).collect()}
    assert len(seen) == len(set(seen)) > 0
    monkeypatch.undo()
    whole = mine(derive.event_graph(spark, crowd), 8, options=Options(max_edges=3)).patterns
    assert freq["none"] == len(whole)
    assert freq["edge"] == freq["lookup"] == sum(m.bottleneck >= 5 for _, m in whole)
    assert freq["vertex"] == sum(m.vertex_bottleneck >= 5 for _, m in whole)


def test_rows_have_twins_in_turn(spark, crowd, monkeypatch):
    """Of a class of twins a core row has the first, or the first two, and so on; supports are those of the whole graph, listed or
    by lists of patterns, and it is these rows that make a graph large."""
    whole, few = derive.event_graph(spark, crowd), derive.event_graph(spark, crowd, upto=4).cached()
    later = {r["v"]: set(r["before"]) for r in few.twins.members().where("v <> first").collect()}
    shapes = ([(0, 1, 0), (1, 2, 0), (2, 3, 0)], [(0, 1, 0), (0, 2, 0), (1, 2, 0)])
    patterns = dict(enumerate({p.code: p for e in shapes for own in product(range(2), repeat=len({x for y in e for x in y[:2]})) for p in [Pattern.of(own, e)]}.values()))
    listing, supports, every = match.Occurrences(few, range(5), False), match.Supports(few, range(5), False), match.Occurrences(whole, range(5))
    want = {k: n for k, (n, _, _) in every.measure(patterns).items()}
    assert {k: n for k, (n, _, _) in listing.measure(patterns).items()} == {k: n for k, (n, _, _) in supports.measure(patterns).items()} == want != {}
    rows = [r["m"] for _, table in listing.tables for r in table.collect()]
    assert later and {len(m) for m in rows} == {1, 2, 3} and all(later.get(v, set()) <= set(m) for m in rows for v in m)
    for x in (listing, supports, every):
        x.close()
    for most, large in ((0, False), (1, True)):
        monkeypatch.setattr(dense, "SMALL", dense.rows_to_list(few) - most)
        assert match.Measures(few, range(5)).large is large and match.Measures(whole, range(5)).large
