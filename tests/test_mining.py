import csv
import os
import random
import time
from itertools import permutations

import pytest

from lattica.operators import index, match, support
from lattica.operators.pattern import Pattern, grow
from lattica.__main__ import main
from lattica.plans import compare
from lattica.plans.mine import Options, mine
from lattica.plans.strategies import EdgeBottleneck, Measured, Unweighted, VertexBottleneck
from lattica.sources.graph import make_graph, on_tables
from lattica.sources.lg import read_lg


def graph(spark, labels, edges):
    v = spark.createDataFrame(list(labels.items()), "id long, label int")
    e = spark.createDataFrame([(min(a, b), max(a, b), el, float(w)) for a, b, el, w in edges], "a long, b long, el int, w double")
    return make_graph(v, e).cached()


def plain(labels, edges, p):
    """Support, smallest edge and smallest vertex of a pattern by trying all maps."""
    link = {}
    for a, b, el, w in edges:
        link[a, b] = link[b, a] = (el, float(w))
    own = {v: [w for (a, _), (_, w) in link.items() if a == v] for v in labels}
    weight = {v: sum(x) / len(x) if x else 0.0 for v, x in own.items()}
    images, bw, vbw = [set() for _ in p.labels], None, None
    for m in permutations(labels, p.n_vertices):
        if all(labels[v] == x for v, x in zip(m, p.labels)) and all(link.get((m[u], m[v]), (None,))[0] == el for u, v, el in p.edges):
            for s, v in zip(images, m):
                s.add(v)
            low = min(link[m[u], m[v]][1] for u, v, _ in p.edges)
            bw = low if bw is None else max(bw, low)
            end = min(weight[v] for v in m)
            vbw = end if vbw is None else max(vbw, end)
    return min(map(len, images)), bw, vbw


def plain_mine(labels, edges, min_sup, max_edges):
    """All frequent patterns by growing and measuring one at a time."""
    triples = {(*sorted((labels[a], labels[b])), el) for a, b, el, _ in edges}
    level, out = [Pattern.single_edge(*t) for t in triples], {}
    for _ in range(max_edges):
        following = {}
        for p in level:
            m = plain(labels, edges, p)
            if m[0] >= min_sup:
                out[p.code] = m
                following |= {x.child.code: x.child for x in grow(p, set(labels.values()), {t[2] for t in triples}, triples)}
        level = [p for c, p in following.items() if c not in out]
    return out


EXAMPLE = ({0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2}, [(0, 2, 0, 7), (1, 3, 0, 6), (2, 4, 0, 8), (3, 5, 0, 5), (0, 3, 0, 4), (2, 5, 0, 3), (0, 4, 0, 2), (1, 5, 0, 1)])


def made(seed):
    rng = random.Random(seed)
    labels = {v: rng.randrange(3) for v in range(9)}
    edges = {(a, b): (a, b, rng.randrange(2), rng.randrange(1, 10)) for a, b in (sorted(rng.sample(range(9), 2)) for _ in range(13))}
    return labels, list(edges.values())


@pytest.fixture(scope="module")
def example(spark):
    return graph(spark, *EXAMPLE)


def test_example_values(example):
    one = {(r.la, r.lb): (r.mni, r.max_w) for r in support.edges(example).collect()}
    assert one == {(0, 1): (2, 7), (0, 2): (2, 2), (1, 2): (2, 8)}
    two = {(r.a, r.b, r.c): (r.mni, r.max_w) for r in support.two_paths(example).collect()}
    assert two == {(0, 1, 0): (1, 4), (1, 0, 1): (1, 4), (1, 2, 1): (1, 3), (2, 1, 2): (1, 3), (0, 1, 2): (2, 7), (0, 2, 1): (2, 2), (1, 0, 2): (2, 2)}
    assert [tuple(r) for r in support.triangles(example).collect()] == [(0, 1, 2, 2, 2.0)]
    assert {(r.la, r.lb): round(r.max_vw, 4) for r in support.edge_vertex_weights(example).collect()} == {(0, 1): 4.3333, (0, 2): 4.3333, (1, 2): 5.0}


@pytest.mark.parametrize("seed", [1])
def test_mining_equals_brute_force(spark, seed):
    labels, edges = made(seed)
    g = graph(spark, labels, edges)
    want = plain_mine(labels, edges, 2, 3)
    for options in (Options(max_edges=3), Options(max_edges=3, reduce=False, apriori=False)):
        got = {p.code: (m.mni, m.bottleneck, m.vertex_bottleneck) for p, m in mine(g, 2, Unweighted(), options).patterns}
        assert got.keys() == want.keys()
        for c in want:
            assert got[c][:2] == want[c][:2] and abs(got[c][2] - want[c][2]) < 1e-9


def test_weighted_strategies_filter_the_unweighted_result(spark):
    labels, edges = made(3)
    g = graph(spark, labels, edges)
    everything = mine(g, 2, options=Options(max_edges=3)).patterns
    for least in (5,):
        want = {p.code for p, m in everything if m.bottleneck >= least}
        for s in (lambda: EdgeBottleneck(least), lambda: EdgeBottleneck(least, "edge"), lambda: EdgeBottleneck(least, "edge", cut=False)):
            assert mine(g, 2, s(), Options(max_edges=3)).codes == want
        assert mine(g, 2, VertexBottleneck(least), Options(max_edges=3)).codes == {p.code for p, m in everything if m.vertex_bottleneck >= least}


@pytest.mark.parametrize("seed", [4, 6])
def test_measures_equal_all_maps(spark, seed):
    """Trees, cycles and leaves that compete for vertices, of up to six positions, against trying all maps."""
    rng = random.Random(seed)
    labels = {v: rng.randrange(1 + seed % 3) for v in range(8)}
    edges = list({(a, b): (a, b, rng.randrange(2), rng.randrange(1, 10)) for a, b in (sorted(rng.sample(range(8), 2)) for _ in range(18))}.values())
    triples = {(*sorted((labels[a], labels[b])), el) for a, b, el, _ in edges}
    level, patterns = [Pattern.single_edge(*t) for t in sorted(triples)], {}
    for _ in range(5):
        following = {x.child.code: x.child for p in level for x in grow(p, set(labels.values()), {0, 1}, triples) if x.child.n_vertices <= 6}
        level = [following[c] for c in rng.sample(sorted(following), min(12, len(following)))]
        patterns |= {p.code: p for p in level}
    numbered = dict(enumerate(patterns.values()))
    assert any(match.Shape.of(p).rivals() for p in numbered.values()) and any(p.n_edges >= p.n_vertices for p in numbered.values())
    occurrences = match.Occurrences(graph(spark, labels, edges), set(labels.values()), reduce=False)
    got = occurrences.measure(numbered)
    occurrences.close()
    for k, p in numbered.items():
        want = plain(labels, edges, p)
        assert (got[k][:2] == want[:2] and abs(got[k][2] - want[2]) < 1e-9) if want[0] else k not in got, p


def test_patterns_of_one_core_go_in_batches(spark, monkeypatch):
    """A core row is tried with a batch of patterns at a time; the size of batches changes nothing."""
    labels, edges = {v: v % 3 for v in range(9)}, [(a, b, 0, 1 + (a * b) % 7) for a in range(9) for b in range(a + 1, 9) if (a + 2 * b) % 4]
    patterns = {k: Pattern.of([0, 1, x, y], [(0, 1, 0), (0, 2, 0), (1, 3, 0)]) for k, (x, y) in enumerate((x, y) for x in range(3) for y in range(3))}
    got = []
    for size in (32, 2):
        monkeypatch.setattr(match, "BATCH", size)
        occurrences = match.Occurrences(graph(spark, labels, edges), {0, 1, 2})
        got.append(occurrences.measure(patterns))
        occurrences.close()
    assert got[0] == got[1]
    for k, p in patterns.items():
        want = plain(labels, edges, p)
        assert got[0][k][:2] == want[:2] and abs(got[0][k][2] - want[2]) < 1e-9


def test_leaves_and_hubs_list_nothing(spark):
    """A hub of 300 leaves: stars and paths around it take a row per core, not per choice of leaves; 4-cycles and triangles
    through a hub are found from the side of few neighbours."""
    labels = {0: 0, **{v: 1 + v % 2 for v in range(1, 301)}}
    edges = [(0, v, 0, 1 + v % 7) for v in range(1, 301)] + [(1, 2, 0, 9), (3, 4, 0, 5)]
    g = graph(spark, labels, edges)
    m = mine(g, 2, options=Options(max_edges=4))
    found = {(p.n_vertices, p.n_edges, tuple(sorted(p.labels))): x for p, x in m.patterns}
    assert all(x.mni >= 2 for x in found.values())
    star = match.Occurrences(g, {0, 1, 2})
    got = star.measure({0: Pattern.of([0, 1, 1, 2, 2], [(0, k, 0) for k in range(1, 5)]), 1: Pattern.of([0, 1, 2], [(0, 1, 0), (0, 2, 0), (1, 2, 0)])})
    hub = sum(1 + v % 7 for v in range(1, 301)) / 300
    assert got == {0: (1, 7.0, pytest.approx(hub)), 1: (1, 4.0, pytest.approx(hub))}
    assert star.rows <= 301 * 2 + 8
    star.close()
    triangles = {(r.l0, r.l1, r.l2): r.mni for r in support.triangles(g).collect()}
    assert triangles == {(0, 1, 2): 1}


def test_reduction_lists_fewer_rows(spark):
    """Core edges that no candidate's leaves fit are not listed."""
    labels = {v: v % 2 for v in range(60)}
    edges = [(v, v + 1, 0, 1) for v in range(0, 60, 2)] + [(0, 3, 0, 1), (4, 7, 0, 2), (8, 11, 0, 2), (3, 4, 0, 1), (7, 8, 0, 5)]
    g = graph(spark, labels, edges)
    runs = {on: mine(g, 2, options=Options(max_edges=4, reduce=on)) for on in (True, False)}
    assert [(p.code, m) for p, m in runs[True].patterns] == [(p.code, m) for p, m in runs[False].patterns]
    assert runs[True].counters.rows_listed < runs[False].counters.rows_listed


def test_shapes_equal_mining(spark):
    labels, edges = made(5)
    edges = [(a, b, 0, w) for a, b, _, w in edges]
    g = graph(spark, labels, edges)
    shapes = {
        "path3": (support.three_paths(g), lambda r: Pattern.of(r[:4], [(0, 1, 0), (1, 2, 0), (2, 3, 0)])),
        "star3": (support.three_stars(g), lambda r: Pattern.of(r[:4], [(0, 1, 0), (0, 2, 0), (0, 3, 0)])),
        "cycle4": (support.four_cycles(g), lambda r: Pattern.of(r[:4], [(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 0)])),
        "triangle": (support.triangles(g), lambda r: Pattern.of(r[:3], [(0, 1, 0), (1, 2, 0), (0, 2, 0)])),
    }
    for name, (df, to_pattern) in shapes.items():
        rows = df.collect()
        assert len({to_pattern(r).code for r in rows}) == len(rows) > 0, name
        for r in rows:
            assert (r["mni"], r["max_w"]) == plain(labels, edges, to_pattern(r))[:2], (name, r)


def test_hand_made_supports(spark):
    star = graph(spark, {0: 1, 1: 0, 2: 0, 3: 0}, [(0, 1, 0, 30), (0, 2, 0, 70), (0, 3, 0, 90)])
    assert mine(star, 2).patterns == []
    one = {p.n_edges: m for p, m in mine(star, 1).patterns}
    assert one[1] == Measured(1, 90.0, pytest.approx(190 / 3)) and one[2].bottleneck == 70
    assert len(mine(star, 1, EdgeBottleneck(70)).patterns) == 2 and len(mine(star, 1, EdgeBottleneck(90.0001)).patterns) == 0
    triangle = graph(spark, {0: 0, 1: 0, 2: 0}, [(0, 1, 0, 1), (1, 2, 0, 1), (0, 2, 0, 1)])
    assert {p.n_edges: m.mni for p, m in mine(triangle, 1).patterns} == {1: 3, 2: 3, 3: 3}
    alone = graph(spark, {0: 0, 1: 1}, [(0, 1, 0, 5)])
    assert [p.n_edges for p, _ in mine(alone, 1).patterns] == [1]


def test_domains(example):
    p = Pattern.of([0, 1, 2], [(0, 1, 0), (1, 2, 0)])
    first = support.first_domains(example, p)
    assert sorted(map(tuple, first.collect())) == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4), (2, 5)]
    child = p.with_chord(0, 2)
    reduced = support.arc_consistent(example, p, first)
    assert reduced.count() == 6
    assert support.inherited_domains(reduced, support.first_domains(example, child)).count() == 6


def test_the_callers_cache_stays(spark):
    g = graph(spark, *EXAMPLE)
    mine(g, 2, options=Options(max_edges=2))
    assert g.adj.storageLevel.useMemory
    with on_tables(g) as own, on_tables(own) as same:
        assert own is same and sorted(map(tuple, own.edges.collect())) == sorted(map(tuple, g.edges.collect()))
        assert own.vertices.count() == g.vertices.count()
    g.released()


def test_deadline_and_limits(example):
    cut = mine(example, 2, options=Options(limit_s=0))
    assert cut.timed_out and {p.n_edges for p, _ in cut.patterns} <= {1}
    assert not mine(example, 2, options=Options(limit_s=600)).timed_out


def test_a_running_job_is_cancelled(spark, example, monkeypatch):
    class Slow(Unweighted):
        def prepare(self, g, min_sup):
            def wait(batches):
                import time

                for b in batches:
                    time.sleep(60)
                    yield b

            g.vertices.mapInPandas(wait, g.vertices.schema).count()

    began = time.monotonic()
    cut = mine(example, 2, Slow(), Options(limit_s=2))
    assert cut.timed_out and cut.patterns == [] and time.monotonic() - began < 30
    assert len(mine(example, 2).patterns) > 0


def test_commands(spark, example):
    rows = {r.algorithm: r for r in compare.compare(example, 2, 4).collect()}
    assert rows["edge"].freq == rows["lookup"].freq <= rows["none"].freq and rows["vertex"].weight_model == "vertex"
    freq = [r.freq for r in compare.sweep(example, 2, (0.0, 1.0)).collect()]
    assert freq == sorted(freq, reverse=True)
    assert compare.ablation(example, 2, 4).count() == 4
    assert compare.reduction_compare(example, 2).count() == 2
    pruned = {r.variant: r for r in compare.pruning_compare(example, 2, 4).collect()}
    assert pruned["nothing"].cand >= pruned["lookup"].cand and len({r.freq for r in pruned.values()}) == 1
    b = compare.bench(example, "example", 2, 4, ["lookup"], warmup=0, measured=1)
    assert b.first().timed_out == "-" and b.first().median_ms > 0 and b.first().peak_mem_mb > 0
    assert compare.csv_lines(b)[0].startswith("CSV,example,lookup,edge,2,4.0,0,0,")
    assert compare.largest_edges(mine(example, 2).to_df(spark)).first()[0] == 3
    with pytest.raises(AssertionError):
        compare.same_result({"a": mine(example, 2), "b": mine(example, 1)})
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", 5.0), (None, 7.0), (None, 7.0), ("c", None)], "k string, x double")
    assert {r.k: r.median for r in index.upper_median(df, ["k"], "x").collect()} == {"a": 3.0, "b": 5.0, None: 7.0}
    cols = "dataset string, algorithm string, min_sup int, min_weight double, budget long, limit_ms long, timed_out string"
    res = spark.createDataFrame([("a", "x", 1, 2.0, 0, 10, "1/1"), ("a", "x", 1, 2.0, 0, 20, "-"), ("b", "x", 1, 2.0, 0, 10, "1/1"), ("b", "x", 1, 2.0, 0, 30, "1/1")], cols)
    assert {(r.dataset, r.limit_ms) for r in compare.merged_results(res).collect()} == {("a", 20), ("b", 30)}
    assert [r.dataset for r in compare.late_cells(res, spark.createDataFrame([("b", 1)], "dataset string, min_sup int")).collect()] == ["a"]


TEXT = "t 1\n" + "".join(f"v {v} {x}\n" for v, x in EXAMPLE[0].items()) + "".join(f"e {a} {b} {w}\n" for a, b, _, w in EXAMPLE[1])


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "example.lg").write_text(TEXT)
    path = str(tmp_path / "example.lg")
    main(["mine", path, "2", "lookup", "4"], spark)
    assert "v 0 " in capsys.readouterr().out
    monkeypatch.setenv("LATTICA_CSV", "1")
    monkeypatch.setenv("LATTICA_ALGOS", "none,lookup")
    (tmp_path / "cells.csv").write_text("dataset,min_sup,least\nexample,2,4\nexample,2,7\n")
    main(["scenarios", str(tmp_path), str(tmp_path / "cells.csv"), "--warmup", "0", "--measured", "1"], spark)
    assert capsys.readouterr().out.count("CSV,example,") == 4
    for command in (["sweep", path, "2"], ["reduction", path, "2"], ["describe", path], ["bench", path, "2", "4", "--measured", "1", "--warmup", "0"]):
        main(command, spark)
        assert capsys.readouterr().out


def test_metrics_as_csv(spark, example, tmp_path):
    from lattica.plans.mine import metrics_row

    compare.write_csv(metrics_row(spark, "none", "example", 2, None, mine(example, 2)), str(tmp_path / "m"))
    rows = [r for f in sorted(os.listdir(tmp_path / "m")) if f.endswith(".csv") for r in csv.DictReader((tmp_path / "m" / f).open())]
    (row,) = rows
    assert row["algorithm"] == "none" and row["min_weight"] == "NA" and int(row["candidates"]) > 0


#: Published counts on public graphs, (graph, support, strategy, weight): (patterns, candidates or None).
PUBLISHED = {
    ("citeseer", 400, "none", 0.0): (5, 20),
    ("citeseer", 400, "lookup", 96.0): (4, 15),
    ("citeseer", 300, "lookup", 96.0): (5, 19),
    ("citeseer", 300, "none", 0.0): (9, None),
    ("citeseer", 250, "lookup", 96.0): (5, 19),
    ("email_eu", 20, "none", 0.0): (7, 90),
    ("email_eu", 20, "lookup", 336.0): (4, 78),
    ("email_eu", 15, "none", 0.0): (29, 240),
    ("email_eu", 15, "lookup", 336.0): (14, 171),
}
GRAPHS = os.environ.get("LATTICA_GRAPHS", "")


@pytest.mark.skipif(not os.path.isdir(GRAPHS), reason="LATTICA_GRAPHS names no folder of public graphs")
@pytest.mark.parametrize("cell", PUBLISHED)
def test_published_counts(spark, cell):
    name, min_sup, algorithm, least = cell
    m = mine(read_lg(spark, f"{GRAPHS}/{name}.lg").graph, min_sup, compare.strategy(algorithm, least, cut=algorithm == "lookup"))
    freq, cand = PUBLISHED[cell]
    assert m.counters.frequent == freq and cand in (None, m.counters.candidates)
