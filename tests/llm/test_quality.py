import zlib

import numpy as np
import pyarrow as pa

from metaweave.llm import quality as Q


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.8
    out = []
    for t in y:
        w = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(rng.integers(5, 120))]
        out.append(" ".join(w) + "." if t else " ".join([w[0].upper() + "!!!"] * len(w)))
    return out, y


def test_measures_by_hand():
    m = Q.measures(pa.array(["a a B1.\na a B1.", None, "", "é!", "x"]))
    n = len(Q.CLASSES)
    assert m[1].sum() == 0 and m[2].sum() == 0
    assert np.isclose(m[0][0], 5 / 15) and np.isclose(m[0][1], 2 / 15) and np.isclose(m[0][n], np.log1p(6))
    assert np.isclose(m[0][n + 3], 4 / 6) and np.isclose(m[0][n + 4], 2 / 6) and np.isclose(m[0][n + 5], 0.5)
    assert np.isclose(m[3][6], 2 / 3) and m[4][n] == np.log1p(1)


def test_slicing_does_not_matter(monkeypatch):
    texts = pa.array(corpus(50, 4)[0] + [None, ""])
    whole = Q.measures(texts)
    monkeypatch.setattr(Q, "slices", lambda t: __import__("metaweave.llm._text", fromlist=["slices"]).slices(t, 100))
    assert np.allclose(whole, Q.measures(texts))


def test_query(spark):
    texts, y = corpus(600, 1)
    rows = [(i, t, "x", 0.5, 1) for i, t in enumerate(texts)] + [(None, "hello there", "", 0.0, 0), (900, None, "", 0.0, 0), (901, "", None, None, 0), (3, texts[3], "x", 0.5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, measures double, y int")
    labels = spark.createDataFrame([(i, int(t), 1) for i, t in enumerate(y)] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    right = [r.predicted == y[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert np.mean(right) > 0.97
    kept = Q.keep(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in got)
    assert {r.predicted for r in Q.classify(docs, labels.limit(0)).collect()} == {1}
    assert Q.classify(docs.limit(0), labels).count() == 0
