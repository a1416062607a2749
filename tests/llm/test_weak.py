import random
import re
import zlib

import numpy as np

from lattica.llm import weak


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.75
    right = [0.95, 0.8, 0.7, 0.6]
    v = np.stack([np.where(rng.random(6000) < 0.3, weak.SILENT, np.where(rng.random(6000) < r, y, ~y).astype(int)) for r in right], 1)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = weak.expectation_maximisation(patterns, counts.astype(float))
    assert abs(model.prior - 0.75) < 0.05
    for j, r in enumerate(right):
        heard = model.theta[j, weak.GOOD, :2]
        assert abs(heard[weak.GOOD] / heard.sum() - r) < 0.06
    assert ((model.posterior(v) > 0.5) == y).mean() > 0.85
    assert weak.expectation_maximisation(np.zeros((0, 4), int), np.zeros(0)).prior == 0.8


def made(rng, kind):
    words = [rng.choice(["the", "tion", "of", "and", "here", "re", "thing", "was"]) + rng.choice(["an", "er", "st"]) for _ in range(120)]
    if kind == "symbols":
        words = [w + rng.choice(["###", "&&&", "%%%"]) for w in words]
    if kind == "shouting":
        words = [w.upper() + "!!" for w in words]
    if kind == "repeats":
        words = words[:1] * 120
    if kind == "toxic":
        words[10] = words[50] = "idiot"
    return " ".join(w + ("." if i % 9 == 8 and kind in ("good", "toxic") else "") for i, w in enumerate(words))


def test_documents_nulls_copies_and_clashing_columns(spark):
    rng = random.Random(3)
    kinds = ["good"] * 200 + ["symbols"] * 20 + ["shouting"] * 20 + ["repeats"] * 20 + ["toxic"] * 20
    rows = [(i, made(rng, k), 0.5) for i, k in enumerate(kinds)]
    rows += [(1000, None, 0.5), (1001, "", 0.5), (None, rows[0][1], 0.5), (0, rows[0][1], 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(k == "toxic")) for i, k in enumerate(kinds)], "doc_id long, toxic int")
    model = weak.fit(docs, labels)
    got = weak.classify(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, k in enumerate(kinds):
        assert by[i].kept == (k == "good"), (k, by[i])
    assert not by[1000].kept and not by[1001].kept and by[None].kept
    assert not any(r.toxic for r in weak.classify(docs, weak.fit(docs)).collect())
    empty = docs.limit(0)
    assert weak.classify(empty, weak.fit(empty, labels)).count() == 0


def test_toxicity_is_learnt_in_every_language(spark):
    rng = random.Random(4)
    rows, labels, abuse = [], [], {"de": "schurkel", "fr": "crétinou", "ru": "негодяй"}
    for i in range(480):
        lang, toxic = rng.choice(list(abuse)), i % 4 == 0
        words = made(rng, "good").split()
        if toxic:
            words[7] = words[70] = abuse[lang] + rng.choice(["", "en", "s", "!"])
        rows.append((i, " ".join(words)))
        if i < 360:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([*labels, (None, 1), (1, None), (5000, 1)], "doc_id long, toxic int")
    model = weak.fit(docs, labels)
    got = {r.doc_id: r for r in weak.classify(docs, model).collect()}
    said = {r.doc_id: r for r in weak.posteriors(docs, model).collect()}
    for i in range(480):
        assert got[i].toxic == (i % 4 == 0) == (said[i].toxic > 0.5) and (got[i].kept or got[i].toxic), i
    assert not got[1000].toxic
    assert weak.fit(docs, labels.where("toxic = 0")).lexicons == [] == weak.fit(docs.limit(0), labels).lexicons


def test_fit_equals_brute_force(spark):
    """Votes, EM, posteriors and both scorers against plain loops over single documents and dense matrices."""
    rng = random.Random(5)
    rows = [(i, made(rng, rng.choice(["good", "good", "symbols", "shouting", "repeats", "toxic"]))) for i in range(150)]
    truth = {i: int("idiot" in t) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = weak.fit(docs, spark.createDataFrame(list(truth.items()), "doc_id long, toxic int"))
    v = [weak.votes(t) for _, t in rows]
    prior, theta = 0.8, [[[0.5, 0.15, 0.35], [0.1, 0.6, 0.3]] for _ in range(weak.LABELLERS)]
    for _ in range(60):
        good = []
        for x in v:
            a = b = 1.0
            for j, c in enumerate(x):
                a, b = a * theta[j][weak.GOOD][c], b * theta[j][weak.BAD][c]
            good.append(prior * a / (prior * a + (1 - prior) * b))
        for j in range(weak.LABELLERS):
            for k, share in ((weak.BAD, [1 - g for g in good]), (weak.GOOD, good)):
                got = [start + sum(s for s, x in zip(share, v) if x[j] == c) for c, start in enumerate([[0.5, 0.15, 0.35], [0.1, 0.6, 0.3]][k])]
                theta[j][k] = [g / sum(got) for g in got]
        prior = min(0.99, max(0.01, (sum(good) + 1) / (len(v) + 2)))
    assert np.allclose(model.quality.theta, theta, atol=1e-9) and abs(model.quality.prior - prior) < 1e-9
    x = np.zeros((len(rows), weak.BUCKETS))
    for i, (_, t) in enumerate(rows):
        makes = {re.sub("[a-zé]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", w))) for w in t.split()}
        at = sorted({zlib.crc32(w.lower().encode(), 1) % weak.BUCKETS for w in t.split()} | {zlib.crc32(weak.shape(m.encode()), 2) % weak.BUCKETS for m in makes})
        x[i, at] = 1 / np.sqrt(max(len(at), weak.LEAST_LENGTH))
    target, w, bias = model.quality.posterior(np.array(v)), np.zeros(weak.BUCKETS), 0.0
    for _ in range(200):
        error = target - 1 / (1 + np.exp(-(x @ w + bias)))
        # the bias decays with the weights
        w, bias = w + 20.0 * (x.T @ error / len(rows)) - 1e-4 * w, bias + 20.0 * error.mean() - 1e-4 * bias
    want = 1 / (1 + np.exp(-(x @ w + bias)))
    got = {r.doc_id: r for r in weak.classify(docs, model).collect()}
    assert np.allclose([got[i].score for i, _ in rows], want, atol=1e-6)
    for i, t in rows:
        held = {}
        for word in weak.words_of(t):
            if word[:4] in model.toxic_scorer.first:
                for b in weak.beginnings(word, weak.STEMS):
                    held[b] = held.get(b, 0) + 1
        odds = model.toxic_scorer.bias + sum(a for b, n in held.items() for a, least in zip(model.toxic_scorer.weights.get(b, ()), weak.TIMES) if n >= least)
        assert abs(got[i].toxic_score - 1 / (1 + np.exp(-odds))) < 1e-9 and got[i].toxic == (odds > 0) == bool(truth[i])
