import zlib

import numpy as np
import pyarrow as pa

from metaweave.llm import language as L

STEMS = {"aa": ["ka", "lo", "mi", "tra", "ßu"], "bb": ["sch", "ung", "keit", "lich"], "cc": ["ción", "ado", "mente", "ñ"]}


def corpus(n, seed, names=("aa", "bb", "cc")):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = names[int(rng.integers(0, len(names)))]
        words = ["".join(rng.choice(STEMS[lang], int(rng.integers(1, 4)))) for _ in range(int(rng.integers(2, 60)))]
        rows.append((i, " ".join(words).capitalize() + ".", lang))
    return rows


def test_bags_and_scores_agree():
    rng = np.random.default_rng(0)
    texts = ["Çedilla über alles", "", "x", "?? !!", "one two, three", "É", None, "long" * 3000]
    weight = rng.normal(size=(1 << L.BUCKET_BITS, 3))
    got = L.Model(["a", "b", "c"], weight).logits(pa.array(texts))
    for row, text in zip(got, texts, strict=True):
        b = (text or "").lower().encode()
        ids, share = L.bag(L.folded(np.array([0, len(b)]), np.frombuffer(b, dtype=np.uint8))[1])
        assert np.allclose(row, share @ weight[ids], atol=1e-5)


def test_calibration_and_rejection():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 4000)
    z = rng.normal(0, 1, (4000, 3))
    z[np.arange(4000), y] += 1.5
    t, bound = L.calibrate(9 * z, y, np.ones(4000), 0.05)  # nine times too sure
    p = L.softmax(9 * z / t)
    right = p.argmax(1) == y
    for low in (0.4, 0.6, 0.8):
        some = (p.max(1) >= low) & (p.max(1) < low + 0.2)
        assert abs(right[some].mean() - p.max(1)[some].mean()) < 0.05
    assert 0.03 < 1 - right[p.max(1) >= bound].mean() <= 0.05


def test_query_held_out_and_defined_cases(spark):
    rows = corpus(600, 2)
    odd = [(None, rows[0][1], rows[0][2]), (1000, None, "aa"), (1001, "", "bb"), (1002, "1234 --- ??", "cc"), (1003, "schungkeit", None), rows[0], (1004, "kalo " * 60_000, "aa")]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows + odd], "doc_id long, text string, lang string, score double, lang_pred string").repartition(4)
    got = L.classify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    lang = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert r.lang_pred == "und" and r.score == 0 and r.rejected
        else:
            assert r.lang_pred in STEMS
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97 and np.mean([r.score for r in held]) > 0.9
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1003] == "bb" and by[1004] == "aa"


def test_rejection_is_asked_for(spark):
    model = L.train([r[1] for r in corpus(500, 3)], [r[2] for r in corpus(500, 3)])
    model.bound = 0.9
    docs = spark.createDataFrame([(1, "schungkeit lichung", "a"), (2, "qqqq xxxx wwww", "b"), (3, None, "c")], "doc_id long, text string, rejected string")
    plain, strict = ({r.doc_id: r for r in L.identify(docs, model, reject=x).collect()} for x in (False, True))
    assert [plain[i].rejected for i in (1, 2, 3)] == [False, True, True] and plain[2].lang_pred != "und"
    assert [strict[i].lang_pred for i in (1, 2, 3)] == ["bb", "und", "und"] and set(strict[1].asDict()) == {"doc_id", "text", "rejected", "lang_pred", "score"}


def test_few_languages_or_none(spark):
    docs = spark.createDataFrame([(i, "ka lo mi", None) for i in range(5)] + [(9, None, "aa")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in L.classify(docs).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(i, "ka lo mi" if i else "77", "aa") for i in range(12)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in L.classify(one).collect()} == {("aa", 1.0), ("und", 0.0)}
    assert L.classify(docs.limit(0)).count() == 0


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows = corpus(300, 5)
    flipped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, t, x in rows]
    a, b = (sorted(L.classify(spark.createDataFrame(r, "doc_id long, text string, lang string").coalesce(1)).collect()) for r in (rows, flipped))
    assert a == b
