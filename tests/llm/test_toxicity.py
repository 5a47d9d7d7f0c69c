import zlib

import numpy as np
import pyarrow as pa

from metaweave.llm import toxicity as T


def test_grams_against_strings():
    offs, raw = T.folded(np.array([0, 7, 7, 12]), np.frombuffer("Ab.cd É éx!z".encode()[:12], dtype=np.uint8))
    text = bytes(raw)
    for s in T.SIZES:
        bucket, valid = T.grams(raw, s)
        by = {}
        for i, (b, v) in enumerate(zip(bucket, valid, strict=True)):
            g = text[i : i + s]
            assert v == (b" " not in g[1:-1])
            assert by.setdefault(g, b) == b


def test_window_means_are_means_of_window_ids():
    rng = np.random.default_rng(0)
    texts = ["one two three four five six", "", "x", "a b", "!!", "long" * 40 + " tail"]
    raw = b"".join(t.encode() for t in texts)
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    offs, buf = T.folded(offs, np.frombuffer(raw, dtype=np.uint8))
    weight = rng.normal(size=1 << T.BUCKET_BITS).astype(np.float32)
    lo, hi, text = T.windows(offs, buf, (1, 2))
    counts = [len(bytes(buf[offs[i] : offs[i + 1]]).split()) for i in range(6)]
    assert [int((text == i).sum()) for i in range(6)] == [0 if not c else c + max(1, c - 1) for c in counts]
    got = T.window_means(buf, lo, hi, weight)
    want = [weight[g].mean() if len(g := T.window_ids(buf, a, b)) else 0 for a, b in zip(lo, hi, strict=True)]
    assert np.allclose(got, want, atol=1e-5)
    assert set(text) == {0, 2, 3, 5}


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    base = np.random.default_rng(9)
    words = ["".join(base.choice(list("abcdefgh"), 5)) for _ in range(300)]
    y = rng.random(n) < 0.3
    bad = ["zwonky", "zwonk", "zwonki"]
    return [" ".join([*rng.choice(words, 60), *([rng.choice(bad)] * int(t)), *rng.choice(words, 30)]) for t in y], y


def test_learns_and_meets_misspellings():
    texts, y = corpus(400, 1)
    m = T.train(texts, y)
    held, z = corpus(200, 2)
    assert ((m.proba(pa.array(held)) >= 0.3) == z).mean() > 0.97
    assert m.proba(pa.array([held[0] + " zwonkyy"]))[0] > 0.3
    assert m.proba(pa.array([None, "", "  "])).max() < 0.3


def test_an_insult_beside_a_long_clean_word():
    texts, y = corpus(600, 4)
    m = T.train(texts, y)
    far = "abcdefgh" * 12
    assert m.proba(pa.array([f"{far} zwonk {far}", f"{far} ZWONKY!!! {far}"])).min() >= 0.3 > m.proba(pa.array([far, f"{far} {far}"])).max()


def test_recall_and_false_alarms_apart(spark):
    """Held-out labels of the larger documents, of which one in eight is toxic and a tenth of these hold no word that others share."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = T.classify(docs, labels).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").filter("toxic IS NOT NULL").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == y] for y in (1, 0))
    assert len(toxic) > 100 and np.mean(toxic) >= 0.92 and np.mean(clean) <= 0.02


def test_query_shape_and_nulls(spark):
    texts, y = corpus(800, 3)
    rows = [(i, t, "x", 0.0, 1) for i, t in enumerate(texts)] + [(None, "zwonky", "x", 0.0, 1), (900, None, "", 0.0, 0), (901, "", None, 0.0, 0), (0, texts[0], "x", 0.0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double, y int")
    labels = spark.createDataFrame([(i, int(t), 1) for i, t in enumerate(y)] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    got = T.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    right = [r.predicted == y[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 800 and r.held_out]
    assert np.mean(right) > 0.95
    none = T.classify(docs, labels.limit(0)).collect()
    assert all(r.predicted == 0 for r in none)
    one = T.classify(docs, labels.filter("toxic = 1")).collect()
    assert max(r.score for r in one) < 1e-9
    long = spark.createDataFrame([(1, "plain words " * 100_000 + texts[int(np.argmax(y))]), (2, "plain words " * 100_000)], "doc_id long, text string")
    far = {r.doc_id: r.score for r in T.score(long, T.learn(docs, labels)).collect()}
    assert far[1] >= 0.3 > far[2]
    assert T.classify(docs.limit(0), labels).count() == 0
