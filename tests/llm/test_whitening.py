import math

import numpy as np
from pyspark.sql import functions as F

from metaweave.llm import whitening as W


def frame(spark, v, ids=None):
    rows = [(i, None if x is None else [None if e is None else float(e) for e in x], 1.0) for i, x in zip(ids or range(len(v)), v, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened double").repartition(4)


def test_equals_numpy(spark):
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) + 5).astype(np.float32)
    run = W.Whitening(frame(spark, v), components=8, most_pairs=30)  # 78 pairs: three aggregations
    x = np.floor(64 * v.astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    z = (n * x - s) / n
    cov = z.T @ z / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:8], vectors.T[::-1][:8]
    assert [int(a) for a in s] == run.sums and np.allclose(run.values, values, rtol=1e-10)
    assert np.allclose(np.abs((run.vectors * vectors).sum(1)), 1, atol=1e-12)
    got = run.digest().collect()
    assert len(got) == n * 8 and {r.component for r in got} == set(range(1, 9))
    sign = np.sign((run.vectors * vectors).sum(1))
    want = z @ (vectors * sign[:, None]).T / np.sqrt(values)
    for r in got:
        assert r.n == n and r.deviation == int(((n * x[r.vec_id] - s) ** 2).sum())
        assert math.isclose(r.whitened, want[r.vec_id, r.component - 1], rel_tol=1e-8, abs_tol=1e-9)
        assert math.isclose(r.explained, values[r.component - 1] / np.trace(cov), rel_tol=1e-9)
    w = np.zeros((n, 8))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    error = np.abs(np.cov(w.T, bias=True) - np.eye(8)).max()
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10 and error < 1e-10


def test_unusable_rows_ties_and_extra_columns(spark):
    rng = np.random.default_rng(2)
    good = [list(x) for x in rng.normal(size=(40, 3))]
    bad = [None, [], [0.1, None, 0.1], [0.1, float("nan"), 0.2], [float("-inf"), 0, 0], [1e20, 0, 0], [1.0, 2.0], [1.0] * 5]
    df = frame(spark, good + good[:3] + bad, [*range(40), 0, 0, None, *range(100, 108)])
    run = W.Whitening(df)
    got = run.digest().collect()
    assert run.n == 43 and run.dims == 3 and len(got) == 43 * 3 and {r.vec_id for r in got} == {None, *range(40)}
    again = run.transform(df).collect()
    assert len(again) == 51 and all((r.whitened is None) == (r.vec_id is not None and r.vec_id >= 100) for r in again)
    by = {r.vec_id: r.whitened for r in again if r.vec_id is not None}
    assert all(math.isclose(by[r.vec_id][r.component - 1], r.whitened, rel_tol=1e-12) for r in got if r.vec_id)


def test_components_without_variance(spark):
    rng = np.random.default_rng(3)
    v = np.repeat(rng.normal(size=(50, 1)), 4, 1)  # rank 1
    run = W.Whitening(frame(spark, v))
    got = run.digest().collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got) and got[0].identity_error < 1e-9
    one = W.Whitening(frame(spark, [[0.5, 0.25]])).digest().collect()
    assert [r.whitened for r in one] == [None, None] and one[0].deviation == 0 and one[0].explained == 0 and one[0].identity_error is None


def test_empty_tables(spark):
    df = frame(spark, [[1.0, 2.0], None])
    for none in (df.limit(0), df.filter("embedding IS NULL")):
        run = W.Whitening(none)
        assert run.digest().count() == 0 and run.digest().columns == W.Whitening(df).digest().columns
        assert run.transform(df).filter(F.col("whitened").isNotNull()).count() == 0


def test_deviations_beyond_64_bits():
    x = np.array([[5, -7], [1 << 40, 3]], dtype=np.int64)
    sums = [(1 << 40) + 5, -4]
    exact = [sum((2 * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    assert W.deviations(x, 2, sums) == [v if v < 1 << 63 else None for v in exact]
    small = np.random.default_rng(4).integers(-1000, 1000, (50, 9))
    s = [int(v) for v in small.sum(0)]
    assert W.deviations(small, 50, s) == [sum((50 * int(v) - t) ** 2 for v, t in zip(r, s, strict=True)) for r in small]
