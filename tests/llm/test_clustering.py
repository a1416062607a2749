import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from lattica.llm import clustering
from lattica.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<double>, near array<int>, cluster string"


def plain(rows, k, rounds, dimensions, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x * scale) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in named[:k]]
    for r in range(rounds + 1):
        found = [min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept] if centres else []
        if r == rounds:
            return sorted(((i, c, d if d < 1 << 63 else None) for (i, _), (d, c) in zip(kept, found)), key=str), centres
        for n in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own)]
    return [], []


def run(spark, rows, k, rounds, dimensions):
    df = spark.createDataFrame([(i, v, [1], "x") for i, v in rows], SCHEMA).repartition(3)
    found = clustering.cluster(df, Scratch(spark, "clustering"), k=k, rounds=rounds, dimensions=dimensions)
    return sorted(map(tuple, found.rows.collect()), key=str), found


@pytest.mark.parametrize("case", ["blobs", "ties", "large", "odd", "few", "none"])
def test_equals_plain(spark, case):
    rng = random.Random(case)
    k, rounds, dimensions = 12, 6, 3
    rows = [(i, [rng.gauss(10 * (i % 12), 2), rng.gauss(5 * (i % 7), 2), rng.random()]) for i in range(400)]
    if case == "ties":  # a small grid of repeated points, negative ones too, and rows repeated in full
        rows = [(i % 150, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(300)]
        rows += rows[:50]
    if case == "large":
        rows += [(1000 + i, [rng.choice([-1, 1]) * 10.0 ** rng.randint(0, 300) for _ in range(3)]) for i in range(40)]
    if case == "odd":
        rows += [(None, [1.0, 2.0, 3.0]), (2000, None), (2001, [1.0, None, 2.0]), (2002, [1.0]), (2003, []), (2004, [math.nan, 0.0, 0.0]), (2005, [math.inf, 0.0, 0.0]), (2006, [1e308, 0.0, 0.0]), (None, [9.0, 9.0, 9.0])]
    if case == "few":
        rows = rows[:5]
    if case == "none":
        rows = [(1, None)]
    got, found = run(spark, rows, k, rounds, dimensions)
    want, centres = plain(rows, k, rounds, dimensions)
    assert got == want and found.centroids.tolist() == centres
    assert len(found.inertia) == len(centres)


def test_bounds_save_distances(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(40 * (i % 32), 1), rng.gauss(17 * (i % 5), 1)]) for i in range(2000)]
    got, found = run(spark, rows, 32, 8, 2)
    assert got == plain(rows, 32, 8, 2)[0]
    assert sum(n for n, _ in found.work) < 0.5 * 2000 * 32 * 9
    kept = [n for _, n in found.work]
    assert kept[0] == 8 and kept[-1] < 8  # bounds are given up as they are not needed


def test_reassign_is_exact_under_wrong_looking_bounds():
    """Any bounds that are true give the nearest centroid, however loose they are."""
    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(0, 50, (500, 4)))
    old, new = (np.array([[int(x) for x in row] for row in np.floor(rng.normal(0, 50, (10, 4)))], object) for _ in range(2))
    b = clustering.scan(v, old, 4)
    b.lower[::3], b.rest[::5], b.upper[::7] = 0, 0, 1e9
    moved = clustering.roots(((new - old) ** 2).sum(1)) * (1 + clustering.SLACK)
    for kept in (4, 2, 1):
        got = clustering.reassign(v, new, clustering.shifted(b, moved, kept), np.zeros(2, np.int64))
        want = [min((sum((int(x) - y) ** 2 for x, y in zip(row, c)), n) for n, c in enumerate(new.tolist()))[1] for row in v.tolist()]
        assert got.near[:, 0].tolist() == want


def test_query_equals_sql(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 9, 0.5) for _ in range(64)]) for i in range(300)] + [(7, [0.5] * 64), (900, [1.0] * 63), (901, None), (902, [math.nan] * 64), (903, [None] * 64)]
    spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = clustering.op11_clustering(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({clustering.OP11_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
