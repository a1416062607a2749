import hashlib
import re

import pytest

from lattica.llm import exact, mixing
from lattica.llm.common import Scratch, n_words

ROWS = [
    (1, "a b c", "s", 1), (2, "abc", "s", 1), (3, "a  b  c", None, 1), (4, "a  b c ", "s", 1), (5, None, "t", 1), (6, "", "t", 1), (7, " \n", None, 1),
    (8, "unique text", "t", 1), (None, "abc", "t", 1), (9, "x" * 50_000, "t", 1), (9, "x" * 50_000, "t", 1), (10, "same length", "u", 1),
]
SCHEMA = "doc_id long, text string, source string, keep_id int"


@pytest.mark.parametrize("digest_all", [True, False])
def test_refinement_equals_the_definition(spark, digest_all):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = exact.refine(docs, Scratch(spark, "t"), digest_all=digest_all).collect()
    groups = {}
    for d, t, _, _ in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d if d is not None else -1))
    assert len(got) == len(ROWS)
    for norm, members in groups.items():
        best = min(members)
        for r in got:
            if (-r.n_chars, r.id if r.id is not None else -1) in members and r.digest in (None, hashlib.sha256(norm.encode()).hexdigest()):
                assert r.group_size == len(members)
                assert (r.keep_id if r.keep_id is not None else -1) == best[1]
                assert r.kept == ((-r.n_chars, r.id if r.id is not None else -1) == best)
    if digest_all:
        assert {r.digest for r in got} == {hashlib.sha256(n.encode()).hexdigest() for n in groups}


def test_drop_copies_keeps_one_row_and_all_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact.drop_copies(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8, 9, 10]
    assert exact.drop_copies(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_word_counts(spark):
    texts = [None, "", " ", "a", " a\tb\x0b c\n", "é b", "\x1f \x85"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(n_words(df.t)).collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def plain_targets(sizes):
    """The rule as it is worded: share by weight, cap, share the excess anew."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_plan_meets_targets_and_limits(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), ["a", "b", "é", None, "z", "tiny"][i * i % 6 if i % 50 else 5], 1.5) for i in range(400)] + [(3, "w " * 9, "a", 1.5), (None, "w", "b", 1.5), (900, None, "zero", 1.5), (901, "w " * 5000, "z", 1.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size double")
    got = mixing.plan(docs, Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = plain_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 1
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert all(list(r.times) == sorted(r.times) and all(0 <= t <= 1 for t in r.times) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(docs.repartition(3), Scratch(spark, "t")).collect()))


def test_curriculum_repeats_whole_documents_in_order(spark):
    rows = [(i, " ".join(["w"] * 10), "a" if i < 10 else "b", 1) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _x int")
    out = mixing.curriculum(docs, Scratch(spark, "t"))
    assert out.columns == docs.columns
    got = out.collect()
    plan = {r.id: r.taken for r in mixing.plan(docs, Scratch(spark, "t")).collect()}
    assert abs(len(got) * 10 - sum(plan.values())) <= 20
    for d, t in plan.items():
        assert abs(sum(r.doc_id == d for r in got) * 10 - t) <= 5
    assert mixing.curriculum(docs.limit(0), Scratch(spark, "t")).count() == 0
    assert mixing.plan(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_slopes_make_positions_and_order(spark, tmp_path):
    """Positions against a plain integration of the schedules in small steps, and the order that is written and read."""
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "abc"[i % 3]) for i in range(240)] + [(7, "other text", "b"), (240, "w w", None), (None, "w w", "240")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = {}
    for slopes in ((-0.5, 0.0, 0.5), (0.5, 0.5, -0.5)):
        got = mixing.plan(docs, Scratch(spark, "t"), slopes=slopes).collect()
        order = sorted({r.source for r in got}, key=lambda s: (s is None, s))
        for r in got:
            slope, steps, done, t = slopes[order.index(r.source) % 3], 4000, 0.0, 0
            for k, at in enumerate(r.times):
                while done < (k * r.source_size + r.offset) / r.target and t < steps:
                    done += (1 + slope * (2 * (t + 0.5) / steps - 1)) / steps
                    t += 1
                assert abs(at - t / steps) < 2 / steps
        seen[slopes] = sorted((str(r.id), r.times) for r in got)
        out = str(tmp_path / str(slopes[0]))
        mixing.curriculum(docs, Scratch(spark, "t"), slopes=slopes).write.parquet(out)
        read = mixing.in_training_order(spark.read.parquet(out)).collect()
        whole = lambda r: (r.taken + (r.size - 1) // 2) // r.size
        want = sorted((t, r.id or -1, r.size) for r in got for t in r.times[: whole(r)])
        assert len(read) == len(want)
        time = {(r.id or -1, r.size, k): t for r in got for k, t in enumerate(r.times)}
        copies, times = {}, []
        for r in sorted(read, key=lambda r: (r.train_file, r.train_row)):
            key = (r.doc_id or -1, len(r.text.split()))
            times.append(time[(*key, copies.setdefault(key, 0))])
            copies[key] += 1
        assert times == sorted(times)
    assert seen[(-0.5, 0.0, 0.5)] != seen[(0.5, 0.5, -0.5)]
    with pytest.raises(ValueError):
        mixing.in_training_order(docs.coalesce(1))


def test_training_order_under_clashing_names(spark, tmp_path):
    names = ["doc_id", "text", "train_row", "train_file", "_name", "_metadata", "name", "place", "doc"]
    path = str(tmp_path / "t")
    spark.createDataFrame([(k, f"w {k}", *"abcdefg") for k in range(20)], f"{names[0]} long, text string, " + ", ".join(f"`{c}` string" for c in names[2:])).repartition(3).write.parquet(path)
    got = mixing.in_training_order(spark.read.parquet(path))
    assert got.columns == [c for c in names if not c.startswith("train_")] + ["train_file", "train_row"]
    rows = got.collect()
    assert len({(r.train_file, r.train_row) for r in rows}) == 20 and {r["_metadata"] for r in rows} == {"d"}
    assert mixing.in_training_order(spark.read.parquet(path), ("doc_id",)).columns == ["doc_id", "train_file", "train_row"]


def test_op6_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(i, " ".join(["w"] * (i * 7 % 23)), ["a", "b", "é", None, "z"][i * i % 5]) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op6_mix_sources(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({mixing.OP6_SQL})").fetchall())


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1, 2, 3), (2, "a b", "s", 4, 5, 6)], "doc_id long, text string, source string, _mix_key int, _mix_time int, _stay_key int")
    assert sorted(r._mix_key for r in mixing.curriculum(docs, Scratch(spark, "t")).collect()) == [1, 4]
    assert [r._stay_key for r in exact.drop_copies(docs, Scratch(spark, "t")).collect()] == [3]


def test_demand_is_inverted(spark):
    from pyspark.sql import functions as F

    for slope in (-0.5, 0.0, 0.5):
        df = spark.range(11).select((F.col("id") / 10).alias("share"))
        for r in df.select("share", mixing.demand_time(F.col("share"), F.lit(slope)).alias("t")).collect():
            assert abs(slope * r.t**2 + (1 - slope) * r.t - r.share) < 1e-9


def test_one_of_fully_repeated_rows_is_kept(spark, tmp_path):
    rows = [(1, "a b c")] * 3 + [(2, "abc")] * 2 + [(3, "x y")] * 2 + [(None, "zz")] * 2 + [(4, None)] * 2 + [(5, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for digest_all in (True, False):
        got = exact.refine(docs, Scratch(spark, "t"), digest_all=digest_all, single=True).collect()
        assert len(got) == len(rows)
        assert sorted(str(r.id) for r in got if r.kept) == ["1", "3", "4", "5", "None"]
        assert sorted({(r.keep_id or 0, r.group_size) for r in got}) == [(0, 2), (1, 5), (3, 2), (4, 2), (5, 1)]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(str(r.doc_id) for r in exact.op10_exact_dedup(spark, str(tmp_path)).where("kept").collect()) == ["1", "3", "4", "5", "None"]
