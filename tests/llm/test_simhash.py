import random

import numpy as np
import xxhash

from lattica.llm import simhash
from lattica.llm.common import Scratch


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Union-find over all pairs."""
    at = {f: f for _, f in rows}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    fps = list(at)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 4:
                at[top(a)] = top(b)
    least = {}
    for d, f in rows:
        least[top(f)] = min(least.get(top(f), d), d)
    return {(d, f): least[top(f)] for d, f in rows}


def test_fingerprints_equal_the_definition_and_spark(spark, monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "a B c", "a b c d", "É a b c d a b c d"] + [" ".join(rng.choices(["the", "Of", "é", "x1"], k=rng.randrange(60))) for _ in range(60)]
    want = [plain_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(simhash.word_blocks, "__defaults__", (16,))
    assert [simhash.fingerprint(t) for t in texts] == want
    assert spark.sql("select xxhash64('a b c d') h").first().h & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c d", 42)


def links_of(spark, fps, dense, huge=1024):
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    scratch = Scratch(spark, "t")
    from lattica.llm.common import connected_components

    got = connected_components(simhash.near_links(spark.createDataFrame(signed, "fp long"), scratch, dense, huge), scratch)
    found = {}
    for r in got.collect():
        found.setdefault(r.component, set()).add(r.node & (2**64 - 1))
    return {frozenset(x) for x in found.values()}


def wanted(fps):
    groups = {}
    for (_, f), c in plain_components([(f, f) for f in fps]).items():
        groups.setdefault(c, set()).add(f)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_components_equal_brute_force_in_sparse_and_crowded_buckets(spark):
    rng = random.Random(2)
    fps = {0, 1 << 63, rng.getrandbits(64)}
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 14)):
            f = centre
            for b in rng.sample(range(64), rng.randrange(7)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    assert links_of(spark, fps, 64) == wanted(fps)
    assert links_of(spark, fps, 2) == wanted(fps)
    assert links_of(spark, fps, 2, 3) == wanted(fps)


def test_fingerprints_that_share_a_half_are_not_paired(spark, monkeypatch):
    rng = random.Random(3)
    fps = {(0xABCDEF01 << 32) | rng.getrandbits(32) for _ in range(3000)}
    fps |= {f ^ 1 << rng.randrange(32) ^ 1 << rng.randrange(32) ^ 1 << rng.randrange(64) for f in list(fps)[:40]}
    compared, candidates = [], simhash.candidates
    monkeypatch.setattr(simhash, "candidates", lambda known: compared.append(candidates(known).count()) or candidates(known))
    found = links_of(spark, sorted(fps), 64, 100)
    assert compared[0] < 50 * len(fps) < len(fps) ** 2 / 50
    assert found == wanted(sorted(fps))


def test_rows_with_nulls_copies_ties_and_clashing_columns(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(4, text, 1), (3, text, 1), (3, text, 1), (9, None, 1), (8, "", 1), (None, "other words that stand alone here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.id, r.component_id) for r in simhash.near_groups(docs, Scratch(spark, "t")).collect()), key=str)
    assert got == sorted([(4, 3), (3, 3), (3, 3), (9, 8), (8, 8), (None, None)], key=str)
    kept = simhash.drop_near_copies(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 8, None]
    assert simhash.near_groups(docs.limit(0), Scratch(spark, "t")).count() == 0
