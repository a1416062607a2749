import random
import re
import zlib

import numpy as np

from lattica.llm import urls


def plain(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url, re.S) if url and "://" in url else None
    if not m:
        return "", ""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


def plain_rule(host, path):
    fits = []
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_parts_and_rules_equal_the_definition():
    rng = random.Random(1)
    alphabet = ["http", "://", "www.", "Example.COM", "com", "net", "/", "/en/", "/fr/", "?", "#", "é", ".", "", "a://b"]
    cases = [None, "", "x", "://", "http://com/", "http://com", "http://notcom/", "http://WWW.example.com/en/1?x", "http://a.www.example.com/en/", "http://example.com/en/", "http://x.net/es/1"] + ["".join(rng.choices(alphabet, k=7)) for _ in range(500)]
    known = urls.Rules(urls.RULES)
    for u in cases:
        host, path = urls.parts(u)
        assert (host, path) == plain(u), u
        assert known.find(host, path) == plain_rule(host, path), u


def test_held_out_urls():
    table = urls.labelled()
    got = urls.held_out(table)
    assert sum(got.values()) == len(table) == len(set(table))
    assert got["blocked_bad"] >= 0.75 * sum(y for _, y in table) and got["blocked_good"] <= 0.03 * sum(1 - y for _, y in table)


def test_training_and_scores_equal_dense_matrices():
    table = urls.labelled()[::5]
    x = np.zeros((len(table), urls.BUCKETS))
    for i, (u, _) in enumerate(table):
        for mark, text, length in zip("hp", plain(u), (1.0, urls.PATH_LENGTH)):
            text = f"^{text}$"
            grams = {mark + text[a : a + n] for n in (3, 4, 5) for a in range(len(text)) if a + n <= len(text) or a == 0}
            at = sorted({zlib.crc32(g.encode()) % urls.BUCKETS for g in grams})
            for k in at:
                x[i, k] += length / len(at) ** 0.5
    y, w, bias = np.array([y for _, y in table]), np.zeros(urls.BUCKETS), 0.0
    for _ in range(2000):
        error = y - 1 / (1 + np.exp(-(x @ w + bias)))
        w, bias = w + 10.0 * (x.T @ error / len(y) - 1e-4 * w), bias + 10.0 * (error.mean() - 1e-4 * bias)
    learnt = urls.train(table)
    bias += np.log(urls.PRIOR / (1 - urls.PRIOR)) - np.log(y.mean() / (1 - y.mean()))
    assert np.allclose([urls.score(learnt, *urls.parts(u)) for u, _ in table], 1 / (1 + np.exp(-(x @ w + bias))), atol=1e-8)


def test_op5_equals_plain_loops(spark, tmp_path):
    rng = random.Random(2)
    urls_ = [None, "none", *[u for u, _ in urls.labelled()], *[f"http://{rng.choice(['a.example.com', 'www.example.com', 'x.net', 'b.org'])}/{rng.choice(['en', 'es', 'fr'])}/{k}?q" for k in range(60)]]
    spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in urls.op5_url_filter(spark, str(tmp_path)).collect()}
    w = urls.train()
    for k, u in enumerate(urls_):
        rule, verdict = plain_rule(*plain(u))
        assert (got[k].host, got[k].path, got[k].rule) == (*plain(u), rule)
        assert got[k].verdict == (verdict or ("block" if urls.score(w, *plain(u)) >= 0.5 else "allow"))


def test_rows_with_nulls_copies_and_clashing_columns(spark):
    rows = [(1, None, "h"), (2, "http://www.example.com/en/1", "h"), (2, "http://www.example.com/en/1", "h"), (3, "http://a.net/fr/2", "h"), (None, "nothing", "h"), (4, "http://x.org/" + "a" * 100_000, "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urls.filter_urls(pages, urls.train()).collect()
    assert len(got) == 6
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[1].rule) == ("", "", None)
    assert (by[2].rule, by[2].verdict) == ("www.example.com/en/", "allow") and (by[3].rule, by[3].verdict) == ("net/fr/", "block")
    assert urls.filter_urls(pages.limit(0), urls.train([])).count() == 0
