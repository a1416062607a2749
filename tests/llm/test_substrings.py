import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import induced, substrings
from lattica.llm.common import Scratch


def order_of(text, limit, cap, span=None):
    disk = induced.Disk(limit)
    order, shared = [], []
    for p, v in induced.sort_suffixes(np.array(text), disk, cap, span):
        order += p.tolist()
        shared += v.tolist()
    disk.close()
    return order, shared, disk.written


def test_induced_order_and_common_prefixes_equal_plain_sorting():
    rng = random.Random(1)
    for _ in range(1500):
        text = [rng.randrange(1, 1 + rng.choice([1, 2, 3, 8, 200])) for _ in range(rng.randrange(1, 50))] * rng.choice([1, 1, 3]) + [0]
        cap = rng.choice([4, 200])
        order, shared, _ = order_of(text, rng.choice([3, 7, 1_000_000]), cap)
        assert order == sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
        for k in range(1, len(text)):
            a, b = text[order[k - 1] :], text[order[k] :]
            assert shared[k] == min(cap, next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


def test_sorting_on_disk_equals_sorting_in_memory():
    rng = np.random.default_rng(2)
    text = np.append(np.tile(rng.integers(1, 5, 500), 12) + (rng.random(6000) < 0.02), 0)
    plain, small = order_of(text, 1 << 20, 100), order_of(text, 200, 100)
    assert plain[:2] == small[:2] and plain[2] == 0 and small[2] > len(text)


def test_order_up_to_a_span():
    rng = random.Random(3)
    for _ in range(300):
        text = [rng.randrange(1, 3) for _ in range(rng.randrange(1, 30))] * 6 + [0]
        order, shared, _ = order_of(text, rng.choice([5, 1_000_000]), 10, 10)
        heads = [text[i : i + 10] for i in order]
        assert sorted(order) == list(range(len(text))) and heads == sorted(heads, reverse=True)
        assert all((v >= 10) == (x == y and len(x) == 10) for v, x, y in zip(shared[1:], heads, heads[1:]))


def plain(rows):
    """For each row its removed runs and kept bytes, window by window."""
    first = {}
    for d, t in rows:
        for p in range(len(t) - 99):
            w = t[p : p + 100]
            first[w] = min(first.get(w, (d, p)), (d, p))
    out = []
    for d, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - 99):
            if first[t[p : p + 100]] < (d, p):
                gone[p : p + 100] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), int((np.diff(np.append(False, gone).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def texts(rng):
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(4)]
    out = ["", "x" * 99, "x" * 100, "x" * 101, "x" * 1000, "ab" * 400, "abcdefg" * 90, passages[0][:100], passages[0][:140], passages[0][20:]]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts.append(p[a : a + rng.randrange(20, 300)] if rng.random() < 0.7 else " ".join(word() for _ in range(rng.randrange(60))))
        out.append("".join(parts))
    return out + out[10:20]


def test_documents_equal_brute_force(spark):
    rng = random.Random(5)
    rows = list(enumerate(texts(rng)))
    rng.shuffle(rows)
    rows = [(d, t) for d, t in rows]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows] + [(1000, None, 1)], "doc_id long, text string, start int").repartition(5)
    got = substrings.op3_digests(substrings.repeated_spans(docs, Scratch(spark, "t"))).collect()
    assert sorted(map(tuple, got)) == sorted(plain([(d, t.encode()) for d, t in rows] + [(1000, b"")]))


def test_repeated_rows_null_ids_and_empty_tables(spark):
    t = "".join(random.Random(6).choices("abcdefgh ", k=300))
    docs = spark.createDataFrame([(1, t), (1, t), (None, t[50:200]), (2, t + "x" * 250)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r for r in substrings.op3_digests(substrings.repeated_spans(docs, Scratch(spark, "t"))).collect()}
    assert got[(None, 150)].n_removed == 0 and got[(1, 300)].n_removed == 150 and got[(2, 550)].n_removed == 300 + 249
    full = {r.doc_id: r for r in substrings.remove_repeats(docs, Scratch(spark, "t")).collect()}
    assert full[1].spans == [50, 200] and bytes(full[1].kept) == (t[:50] + t[200:]).encode()
    assert substrings.remove_repeats(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_one_shard_with_little_memory():
    rng = random.Random(7)
    base = bytes(rng.choices(b"abc", k=400))
    texts = [base[a : a + 200] for a in (0, 50, 100)] + [bytes([255, 254]) * 80]
    rows = np.array([(0, 5, 0, 1), (1, 5, 50, 1), (2, 3, 0, 2), (0, 4, 7, 3), (3, 9, 0, 4), (0, 4, 7, 5)])
    small, large = substrings.repeats(texts, rows, 50), substrings.repeats(texts, rows)
    assert small[0].tolist() == large[0].tolist() and small[1].tolist() == large[1].tolist() == [False, True, True, True, True, True]
    windows, first = {}, {}
    for k, i, s, _ in rows.tolist():
        for o in range(len(texts[k]) - 99):
            w = texts[k][o : o + 100]
            first[w] = min(first.get(w, (99, 0)), (i, s + o))
            if (i, s) == min((r[1], r[2]) for r in rows.tolist() if r[0] == k):
                windows[(k, o)] = (i, s + o)
    want = sorted(ko for ko, place in windows.items() if first[texts[ko[0]][ko[1] : ko[1] + 100]] < place)
    assert [(k, a + j) for k, a, n in large[0].tolist() for j in range(n)] == want


def test_lone_periodic_texts(spark):
    rng = random.Random(8)
    rows = []
    for k, n in enumerate([101, 110, 127, 140, 160, 188, 200, 227, 300, 600]):
        for period in (1, 2, 7, 30, 59, 60, 61, 62):
            unit = "".join(chr(0x100 + rng.randrange(500)) if i % 9 == 8 else rng.choice("abcdefgh") for i in range(period))
            text = "".join(rng.choices("klmnop", k=40)) + (unit * n)[:n] if period % 2 else (unit * n)[:n]
            rows += [(len(rows) + i, text) for i in range(1 + (k % 3 == 2))]
    rows.append((len(rows), "abcdefg" * 20))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in substrings.op3_digests(substrings.repeated_spans(docs, Scratch(spark, "t"))).collect()}
    assert got[len(rows) - 1][2] == 133
    assert sorted(got.values()) == sorted(plain([(d, t.encode()) for d, t in rows]))


def test_hot_keys_are_split_and_the_sort_finds_every_repeat(spark, monkeypatch):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choices("abcdefé ", k=n))
    passage, borders = noise(160), [noise(50) for _ in range(12)]
    rows = [(d, noise(60) + rng.choice(borders)[rng.randrange(40) :] + passage + rng.choice(borders)[: rng.randrange(50)] + noise(60)) for d in range(300)]
    rows += [(300 + k, "ab" * (60 + k)) for k in range(40)] + rows[:5] + [rows[7]] * 200
    monkeypatch.setattr(substrings, "HOT", 3000)
    monkeypatch.setattr(substrings, "HOT_SHARE", 1)
    sizes, sorted_marks, shard_repeats = [], [], substrings.shard_repeats

    def watched(shards, rest=False):
        # the largest key's snippets, each once; a hot key's parts are of random sizes around HOT
        sizes.extend(r.n for r in shards.dropDuplicates(["dk", "start"]).selectExpr("key", "length(data) as n").groupBy("key").agg(F.sum("n").alias("n")).collect())
        out = shard_repeats(shards, rest)
        sorted_marks.extend((r.dk, r.start + k) for r in out.where("data is null").collect() for k in range(r.windows))
        return out

    monkeypatch.setattr(substrings, "shard_repeats", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = substrings.repeated_spans(docs, Scratch(spark, "t")).cache()
    got = substrings.op3_digests(spans).collect()
    assert sorted(map(tuple, got)) == sorted(plain([(d, t.encode()) for d, t in rows]))
    assert max(sizes) <= 4 * 3000 and len(sizes) > 100
    # of distinct rows, the windows that are marked are those that a plain count finds, each marked by a sort
    first, wanted = {}, 0
    for d, t in sorted(set((d, t.encode()) for d, t in rows)):
        for p in range(len(t) - 99):
            wanted += t[p : p + 100] in first
            first.setdefault(t[p : p + 100], (d, p))
    assert len(set(sorted_marks)) == wanted


def test_a_shard_larger_than_memory(tmp_path):
    rng = random.Random(10)
    parts = [bytes(rng.choices(b"abcdefgh ", k=rng.randrange(100, 300))) for _ in range(60)]
    texts = list({p[a:] + q[: rng.randrange(300)] for p in parts for q in rng.sample(parts, 6) for a in (0, rng.randrange(60)) if len(p) - a >= 100})
    rows = np.array([(k, k % 37, 1000 * k, k) for k in range(len(texts))])
    limit = 2000
    assert sum(map(len, texts)) > 50 * limit
    assert substrings.repeats(texts, rows, limit)[0].tolist() == substrings.repeats(texts, rows)[0].tolist()
