import random
import re

import numpy as np

from lattica.llm import quality, trees


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]


def test_counts_equal_the_definition():
    rng = random.Random(4)
    texts = [None, "", "  ", "a b c", "a b c a b c", "x x x x", "é é# é\n é\n\n é", "a b c"] + [" ".join(rng.choices(["a", "b", "é*", "c\n", "\n"], k=rng.randrange(40))) for _ in range(200)]
    for t in texts:
        counts, features = quality.statistics(t)
        assert counts == plain(t), repr(t)
        assert len(features) == len(quality.FEATURES) and np.isfinite(features).all()


def test_trees_learn_and_keep_their_constraints():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=1500) > 0).astype(float)
    forest = trees.fit(x[:1000], y[:1000], {0: 1, 1: -1})
    assert ((forest.score(x[1000:]) > 0) == (y[1000:] > 0)).mean() > 0.88
    for j, sign in ((0, 1), (1, -1)):
        for row in x[:40]:
            line = np.repeat(row[None], 50, 0)
            line[:, j] = np.linspace(-3, 3, 50)
            assert (np.diff(forest.score(line)) * sign >= -1e-12).all()
    assert len(set(trees.fit(x[:9], np.ones(9), {}).score(x))) == 1


def test_flat_walk_equals_a_walk_node_by_node():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(400, 4)), rng.integers(0, 2, 400).astype(float)
    f = trees.fit(x, y, {}, trees=6, depth=4)

    def walk(row):
        total = f.base
        for t in range(len(f.feature)):
            k = 0
            for _ in range(f.depth):
                k = 2 * k + 1 + (row[f.feature[t, k]] > f.threshold[t, k])
            total += f.value[t, k]
        return total

    assert np.allclose(f.score(x), [walk(r) for r in x])


def rows(rng, good, n):
    words = ["the", "tion", "of", "and", "here", "re", "thing", "was"]
    for _ in range(n):
        w = [rng.choice(words) + rng.choice(words) for _ in range(120)]
        yield " ".join(w if good else [x + rng.choice(["###", "&&&", "%%%"]) for x in w])


def test_held_out_documents_nulls_copies_and_clashing_columns(spark):
    rng = random.Random(9)
    texts = [*rows(rng, True, 120), *rows(rng, False, 80)]
    docs = [(i, t, True) for i, t in enumerate(texts)] + [(900, None, True), (901, "", True), (902, "short text", True), (903, "same words again " * 40, True), (None, texts[0], True), (0, texts[0], True)]
    table = spark.createDataFrame(docs, "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 200, 2)] + [(5000, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    forest = quality.fit_rules(table, labels)
    got = quality.quality_rules(table, forest).collect()
    assert len(got) == len(docs)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] == (i < 120) for i in range(1, 200, 2))
    assert not any(kept[i] for i in (900, 901, 902, 903)) and kept[None]
    stay = quality.keep_good(table, forest)
    assert stay.columns == table.columns and stay.count() == sum(r.kept for r in got)
    assert quality.quality_rules(table.limit(0), forest).count() == 0
    none = quality.fit_rules(table, labels.limit(0))
    assert sum(r.kept for r in quality.quality_rules(table, none).collect()) == sum(not r.base_failed for r in got)
