import json
import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import scalars
from lattica.operators import index
from lattica.plans import compare
from lattica.plans.mine import mine, metrics_row, pattern_rows
from lattica.sources import derive, lg


def load(spark, tmp_path, text, **options):
    path = tmp_path / "g.lg"
    path.write_text(text)
    return lg.read_lg(spark, str(path), **options)


HEAD = "t 1\n# c\n\nx y z\nv 5 1\nv 9 2\n"


@pytest.mark.parametrize(
    "lines,edges,want",
    [
        ("e 5 9 3\n", [(0, 1, 3.0)], {"ids_remapped": True, "n_edges": 1}),
        ("e 5 9 5\ne 9 5 5\n", [(0, 1, 5.0)], {"reciprocal_merged": 1, "conflicting_weights": 0}),
        ("e 5 9 5\ne 9 5 7\ne 5 9 8\ne 5 5 1\n", [(0, 1, 5.0)], {"reciprocal_merged": 1, "conflicting_weights": 1, "parallel_dropped": 1, "self_loops": 1, "edge_lines": 4}),
        ("e 5 9 0\nv 5 4\n", [(0, 1, 0.0)], {"non_positive": 1, "vertex_labels": [1, 2, 4], "mean_w": 0.0}),
    ],
)
def test_reader_rules(spark, tmp_path, lines, edges, want):
    got = load(spark, tmp_path, HEAD + lines)
    assert [(r.a, r.b, r.w) for r in got.graph.edges.collect()] == edges
    stats = got.stats.first().asDict()
    assert {k: stats[k] for k in want} == want
    assert got.warnings.count() == stats["self_loops"] + stats["conflicting_weights"] + stats["non_positive"]
    if "v 5 4" in lines:
        assert {r.id: r.label for r in got.graph.vertices.collect()} == {0: 4, 1: 2}


@pytest.mark.parametrize("lines", ["v 0\n", "e 5 9\n", "e 5 7 1\n", "e 5 x 1\n"])
def test_reader_refuses(spark, tmp_path, lines):
    with pytest.raises(ValueError, match="line"):
        load(spark, tmp_path, HEAD + lines)


def test_labelled_edges_round_trip_and_description(spark, tmp_path):
    got = load(spark, tmp_path, HEAD + "v 7 1\ne 5 9 2.5\ne 9 7 -2.5\n", edge_label=scalars.nearest_label)
    assert sorted((r.a, r.b, r.el) for r in got.graph.edges.collect()) == [(0, 1, 3), (1, 2, -2)]
    lg.write_lg(got.graph, str(tmp_path / "out"))
    again = lg.read_lg(spark, str(tmp_path / "out/*"))
    assert again.graph.edges.count() == 2 and again.graph.vertices.count() == 3
    assert compare.describe(spark, str(tmp_path / "g.lg"))["preview"].first()["line"] == "t 1"
    m = mine(got.graph, 1)
    assert pattern_rows(spark, m).first().text.startswith("v 0 ")
    row = metrics_row(spark, "none", "g", 1, None, m).first()
    assert row.frequent == len(m.patterns) == m.to_df(spark).count() and row.min_weight == "NA"


def test_numbers_over_splits_and_stored_patterns(spark, tmp_path):
    lines = [f"v {k} {k % 3}" for k in range(5000)]
    (tmp_path / "g.lg").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = sorted(map(tuple, lg.numbered_lines(spark, str(tmp_path / "g.lg")).collect()))
        assert spark.read.text(str(tmp_path / "g.lg")).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(lines, 1))
    (tmp_path / "p.txt").write_text("0.5\n2\n0:\nv 0 2\nv 1 2\ne 0 1 0\n1:\nv 3 1\nv 4 2\nv 7 1\ne 3 4 0\ne 4 7 5\n")
    assert [(p.labels, p.edges) for p in lg.read_patterns(spark, str(tmp_path / "p.txt"))] == [((2, 2), ((0, 1, 0),)), ((1, 2, 1), ((0, 1, 0), (1, 2, 5)))]


def test_dense_numbers_keep_the_order(spark):
    from lattica.sources.graph import numbered

    df = spark.createDataFrame([(k * 37 % 100,) for k in range(100)], "k long").repartition(7).selectExpr("k", "floor(k / 9) as part")
    assert {r.k: r.no for r in numbered(df, "part", ["k"], "no").collect()} == {k: k for k in range(100)}
    assert {r.key: r.id for r in derive.dense(spark.createDataFrame([("b",), ("a",), ("b",)], "key string")).collect()} == {"a": 0, "b": 1}


def test_trust_and_mail(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,2,10,0.5\n2,1,-4,0.6\n3,3,1,1\n2,3,-10,2\n")
    g = derive.read_trust_csv(spark, str(tmp_path / "t.csv"))
    assert {(r.a, r.b): r.w for r in g.edges.collect()} == {(1, 2): 14.0, (2, 3): 1.0}
    assert {r.id: r.label for r in g.vertices.collect()} == {1: 0, 3: 1, 2: 3}
    (tmp_path / "m.txt").write_text("1 2 0\n2 1 3\n1 1 4\n4 5 1\n")
    (tmp_path / "d.txt").write_text("1 7\n")
    g = derive.read_mail_log(spark, str(tmp_path / "m.txt"), str(tmp_path / "d.txt"), 2)
    assert [(r.a, r.b, r.w) for r in g.edges.collect()] == [(1, 2, 2.0)]
    assert {r.id: r.label for r in g.vertices.collect()} == {1: 7, 2: 0}


def test_features_and_proteins(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id_1,id_2\n0,1\n1,2\n")
    (tmp_path / "f.json").write_text(json.dumps({"0": [1, 2, 3], "1": [2, 3, 4], "2": []}))
    (tmp_path / "c.csv").write_text("id,name,ml_target\n0,a,5\n1,b,6\n2,c,5\n")
    g = derive.read_feature_graph(spark, *(str(tmp_path / n) for n in ("e.csv", "f.json", "c.csv")))
    assert {(r.a, r.b): r.w for r in g.edges.collect()} == {(0, 1): 50.0, (1, 2): 0.0}
    (tmp_path / "p.txt").write_text("a b 900\nb c 400\n")
    (tmp_path / "t.tsv").write_text("protein\tcategory\tid\tterm\na\tSubcellular localization (COMPARTMENTS)\t1\tCytosol\na\tSubcellular localization (COMPARTMENTS)\t2\tOuter Membrane\nb\tother\t3\tPeriplasm\n")
    g = derive.read_protein_network(spark, str(tmp_path / "p.txt"), str(tmp_path / "t.tsv"))
    assert sorted(r.label for r in g.vertices.collect()) == [0, 0, 4] and g.edges.count() == 2


def test_scalars(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.49,)], "x double")
    assert [r[0] for r in df.select(scalars.nearest_label(df.x)).collect()] == [3, -2, 0]
    assert [r[0] for r in df.select(scalars.one_decimal(df.x)).collect()] == ["2.5", "-2.5", "0.5"]
    from pyspark.sql import functions as F

    row = spark.range(1).select(scalars.weight_text(F.lit(float("nan"))).alias("a"), scalars.weight_model(F.lit("edge")).alias("b"), scalars.weight_model(F.lit("none")).alias("c"), scalars.shifted_trust(F.lit(-10)).alias("d"), scalars.priority_label(F.lit("Inner Membrane ; cytosol")).alias("e")).first()
    assert tuple(row) == ("NA", "edge", "none", 1, 2)


def test_index(spark):
    g = derive.make_graph(spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 9)], "id long, label int"), spark.createDataFrame([(0, 1, 0, 4.0), (1, 2, 0, 6.0)], "a long, b long, el int, w double"))
    assert {r.id: r.degree for r in index.degrees(g).collect()} == {0: 1, 1: 2, 2: 1, 3: 0}
    assert {r.id: r.weight for r in g.vertices.collect()} == {0: 4.0, 1: 5.0, 2: 6.0, 3: 0.0}
    assert {(r.la, r.lb): r.max_w for r in index.triple_max_weight(g).collect()} == {(1, 1): 4.0, (1, 2): 6.0}
    assert [tuple(r) for r in index.weighty_triples(g, 5.0).collect()] == [(1, 2, 0)]
    assert [r.w for r in index.weight_grid(g, [0.0, 0.5, 1.0]).orderBy("q").collect()] == [4.0, 4.0, 6.0]
    assert [r.w for r in index.distinct_weights(g).collect()] == [6.0, 4.0]


@pytest.mark.parametrize("key", [lambda k: f"one common beginning {k:04d}", lambda k: f"{k * 7919 % 1000:03d}"])
def test_text_keys_are_numbered_by_ranges(spark, key):
    keys = sorted(key(k) for k in range(1000))
    got = derive.dense(spark.createDataFrame([(k,) for k in keys[::-1]], "key string").repartition(5))
    assert {r.key: r.id for r in got.collect()} == {k: n for n, k in enumerate(keys)}
    assert derive.dense(spark.createDataFrame([], "key string")).collect() == []


def test_picked_places(spark):
    from lattica.sources.ranks import picked

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([1, 1, 1, 2, 5, rng.randrange(900)])) for _ in range(2000)]
    got = picked(spark.createDataFrame(rows, "k string, x int"), ["k"], "x", F.array(F.lit(0), F.floor(F.col("_n") / 2), F.col("_n") - 1))
    for k in "ab":
        own = sorted(x for c, x in rows if c == k)
        assert {r["rank"]: r["x"] for r in got.where(F.col("k") == k).collect()} == {n: own[n] for n in (0, len(own) // 2, len(own) - 1)}


def test_a_large_slot_is_paired_by_blocks(spark):
    rows = [("hot", u) for u in range(60)] + [("cold", u) for u in range(55, 65)]
    got = derive.slot_pairs(spark.createDataFrame(rows, "slot string, u long"), ["slot"], "u", block=8)
    want = sorted((a, b) for s in ("hot", "cold") for a in (u for c, u in rows if c == s) for b in (u for c, u in rows if c == s) if a < b)
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("tile", [7, 1000])
def test_large_slots_are_counted_in_tiles(spark, monkeypatch, tile):
    rng = random.Random(8)
    rows = sorted({(rng.choice("xyz"), rng.randrange(9), u) for u in range(60) for _ in range(12)})
    given = spark.createDataFrame([*rows, ("x", None, 5), (None, 3, 6), ("x", 3, None)], "slot string, h int, u long")
    of = {u: {r[:2] for r in rows if r[2] == u} for u in range(60)}
    want = sorted((a, b, len(of[a] & of[b])) for a in of for b in of if a < b and len(of[a] & of[b]) >= 4)
    monkeypatch.setattr(derive, "COUNTED", 50)
    with monkeypatch.context() as m:
        m.setattr(derive, "slot_pairs", lambda *_: pytest.fail("pairs are listed"))
        assert sorted(map(tuple, derive.shared_slots(given, ["slot", "h"], "u", 4, tile).collect())) == want
    assert sorted(map(tuple, derive.shared_slots(given, ["slot", "h"], "u", 4, 1).collect())) == want
    assert derive.shared_slots(given.limit(0), ["slot", "h"], "u", 4).collect() == []


def test_lists_are_read_in_splits(spark, tmp_path):
    given = {str(k): [k * j % 97 for j in range(k % 9)] for k in range(400)}
    (tmp_path / "one.json").write_text(json.dumps(given))
    (tmp_path / "wide.json").write_text(json.dumps(given, indent=2))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(before, ("700b", "0")):
            spark.conf.set(k, v)
        for name in ("one.json", "wide.json"):
            got = derive.read_lists(spark, str(tmp_path / name))
            assert got.rdd.getNumPartitions() > 3
            assert {r.id: r.f for r in got.collect()} == given
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_peaks_of_executors(spark):
    spark.range(1000).selectExpr("sum(id)").collect()
    assert compare.peak_memory_mb(spark) > 0
