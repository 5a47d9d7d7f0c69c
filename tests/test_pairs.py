"""Queries that meet vectors in blocks, against every distance."""

import inspect

import numpy as np
import pytest

from metaweave import catalogue, catalogue_more  # noqa: F401
from metaweave.operators import evaluate, pairs, ranks, validate


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_of_blocks(spark, metric, monkeypatch):
    monkeypatch.setattr(pairs, "PACK", 32)
    monkeypatch.setattr(pairs, "QUERY_PACK", 8)
    monkeypatch.setattr(pairs, "MOST_SENT", 30)
    x = np.round(np.random.default_rng(1).normal(size=(200, 5)), 1) + 0.05
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, None), (None, [1.0] * 5)], "nd long, v array<double>").repartition(3)
    got = evaluate.nearest(v.filter("nd % 3 = 0 OR nd IS NULL"), v, 7, metric)
    assert "BroadcastNestedLoopJoin" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "MapInArrow" in plan
    rows = {}
    for r in got.collect():
        rows.setdefault(r.q, []).append((r["rank"], r.nd, r.d))
    norm = np.sqrt((x * x).sum(1))
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 6) if metric == "l2" else np.round(1 - x @ x.T / np.outer(norm, norm), 6)
    assert sorted(rows) == list(range(0, 200, 3))
    for q, found in rows.items():
        found = sorted(found)
        assert [k for k, *_ in found] == list(range(7)) and np.allclose([f[2] for f in found], np.sort(d[q])[:7], atol=2e-6)
        if metric == "l2":
            assert [f[1] for f in found] == np.argsort(d[q], kind="stable")[:7].tolist()
    # ids of other kinds meet row by row
    named = v.filter("nd IS NOT NULL AND v IS NOT NULL").selectExpr("concat('n', nd) AS nd", "v")
    assert evaluate.nearest(named.filter("nd = 'n4'"), named, 3, metric).count() == 3


def test_areas_of_scores_are_those_of_rows(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PACK", 32)
    monkeypatch.setattr(pairs, "MOST_HELD", 50)
    x = np.random.default_rng(2).integers(0, 3, size=(150, 4)).astype(float)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "nd long, v array<double>").repartition(3)
    ids = v.select("nd")
    q = v.filter("nd % 5 = 0")
    known = spark.createDataFrame([(i, j, float(i % 4)) for i in range(150) for j in range(i + 1, min(150, i + 6))] + [(5, 5, 1.0), (7, 999, 2.0)], "n1 long, n2 long, w double")
    rows = evaluate.distances(q, v).filter("q <> nd").selectExpr("q AS n1", "nd AS n2", "-d AS score")
    of = pairs.scores(q, v)
    assert of.total.agg({"n": "sum"}).first()[0] == rows.count()
    same = lambda a, b: all((p == r) or abs(p - r) < 1e-12 for x, y in zip(a, b, strict=True) for p, r in zip(x, y, strict=True))
    got = lambda f: [sorted(map(tuple, f(s).collect())) for s in (rows, of)]
    assert same(*got(lambda s: validate.characterised(ids, known, s)))
    assert same(*got(lambda s: validate.metanode_characterised(ids, known, s)))
    assert same(*got(lambda s: validate.intra_characterised(ids, known, s, {"max": 0.0, "half": 0.5, "all": 1.0})))
    none = validate.characterised(ids, known.filter("n1 = 7 AND n2 = 999"), of).first()
    assert none.auroc is None and none.n_known == 1


def test_steps_of_a_product_round_as_differences_do():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x[50:100] = x[:50] + rng.choice([0.0, 1e-7, 5e-7, 1.5e-6, 3e-3], size=(50, 6))
    x[100:] = np.round(x[100:], 1)
    x[200:250] = np.arange(50)[:, None] * np.array([3e-6, 0, 0, 0, 0, 0])  # halves of a step
    for a in (x * 0.5, x * 0.01, (x * 0.5).astype(np.float32).astype(float)):
        assert (pairs._steps(a, a, 6) / 1e6 == ranks._apart(a, a, "l2", 6)).all()
    assert pairs._steps(x * 1e4, x, 6) is None and pairs._steps(np.full((1, 6), np.nan), x, 6) is None


def test_metanode_scores_all_pairs_and_keeps_all_known(spark, tmp_path):
    n = 70
    x = np.round(np.random.default_rng(4).normal(size=(n, 4)), 2)
    spark.createDataFrame([(i, r.tolist(), i % 2) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label long").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalogue.QUERIES["characterise_metanode"](spark, str(tmp_path)).first()
    known = {(i, j) for i in range(n) for j in range(i + 1, min(n, i + 26)) if i % 2 == j % 2}
    up = lambda i: {i, i - i % 10, i - i % 100}
    above = {(p, q) for i, j in known for p in up(i) for q in up(j) if (p, q) != (i, j)}
    kept = known - above
    f = x.astype(np.float32).astype(float)
    score = -np.round(np.sqrt(((f[:, None] - f[None]) ** 2).sum(2)), 6)
    pos = [score[i, j] for i in range(n) for j in range(n) if (i, j) in kept or (j, i) in kept]
    neg = [score[i, j] for i in range(n) for j in range(n) if i != j and (i, j) not in kept and (j, i) not in kept]
    area = np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg])
    assert (got.n_known, got.n_kept) == (len(known), len(kept)) and abs(got.auroc - area) < 2e-8
    assert inspect.signature(validate.metanode_characterised).parameters["most"].default is None
