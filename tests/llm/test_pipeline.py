import hashlib
import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from lattica.llm import pieces, quality
from tests.llm.test_exact_and_mixing import plain_targets
from tests.llm.test_simhash import plain_components, plain_fingerprint


def fixture():
    rng = random.Random(11)
    words = [a + b for a in ("the", "tion", "of", "and", "re", "was") for b in ("an", "er", "st", "or", "in")]
    good = [" ".join(rng.choice(words) for _ in range(rng.randrange(60, 160))) for _ in range(50)]
    bad = [" ".join(rng.choice(words) + "###" for _ in range(80)) for _ in range(15)]
    copies = [good[0], good[0].replace(" ", "  "), good[1], good[2] + " end", None, "short"]
    texts = good + bad + copies
    return [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)], [(i, int(i < 50), 0) for i in range(0, 65, 2)]


def test_run_equals_the_stages_by_hand(spark, tmp_path):
    docs, labels = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    y.write.parquet(str(tmp_path / "labels.parquet"))
    forest = quality.fit_rules(d, y)
    kept = quality.judge([r[1] for r in docs], forest)[3]
    rows = [r for r, k in zip(docs, kept) if k]
    assert len(rows) < len(docs) and all(k == (i < 50) for i, k in enumerate(kept[:65]))
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1]), []).append(r)
    rows = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]
    fps = [(r[0], plain_fingerprint(r[1])) for r in rows]
    component = plain_components(fps)
    rows = [r for r, f in zip(rows, fps) if component[f] == r[0]]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    target = plain_targets(dict(sizes))
    want = Counter()
    for s in sizes:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
        rounds, at = int(target[s] // sizes[s]), 0
        rest = round(target[s] - rounds * sizes[s])
        for r in own:
            n = len(r[1].split())
            taken = rounds * n + max(0, min(n, rest - at))
            want[r[0]] += (taken + (n - 1) // 2) // n
            at += n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == +want
    coder, text = pieces.coder_of(pieces.default_model()), {r[0]: r[1] for r in docs}
    for r in got:
        ids = coder.library.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(coder.library.decode(ids).encode()).hexdigest()


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    docs, labels = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d.limit(0), str(tmp_path))
        assert out.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == d.columns, name
