import hashlib

import numpy as np

from metaweave.llm import exponion as X


def brute(ids, x, k, rounds, seed=1):
    """Clusters, squared distances and centroids by looking at every centroid in every round."""
    order = sorted((i for i in range(len(ids)) if ids[i] is not None), key=lambda i: (hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), x[i].tolist()))[:k]
    c = x[order].copy()
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        if r < rounds:
            for j in range(len(c)):
                if (a == j).any():
                    c[j] = [int(s) // int((a == j).sum()) for s in x[a == j].sum(0)]
    return a, d.min(1), c


def blobs(n, dims, groups, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 3, (groups, dims))
    return centres[rng.integers(0, groups, n)] + rng.normal(0, spread, (n, dims))


def frame(spark, ids, v):
    return spark.createDataFrame([(i, None if x is None else [None if e is None else float(e) for e in x], 0) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>, cluster int").repartition(5)


def check(spark, ids, v, k, rounds=3, **more):
    x = np.floor(64 * np.asarray(v)).astype(np.int64)
    a, d, c = brute(ids, x, k, rounds)
    run = X.Exponion(frame(spark, ids, v), k=k, rounds=rounds, dims=x.shape[1], **more)
    got = run.digest().collect()
    assert np.array_equal(run.centroids, c)
    want = sorted(zip(map(str, ids), a.tolist(), d.tolist(), strict=True))
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == want
    per = {j: int(d[a == j].sum()) for j in set(a.tolist())}
    names = {j: hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest() for j in per}
    assert all(r.inertia == d.sum() and r.cluster_inertia == per[r.cluster] and r.centroid_sha256 == names[r.cluster] for r in got)
    return got


def test_equals_brute_force_and_looks_at_few_centroids(spark):
    v = blobs(2000, 8, 24, 0.05, 1)
    got = check(spark, list(range(2000)), v, 24, 5)
    assert sum(r.scanned for r in got) < 0.5 * 2000 * 24 * 6


def test_evenly_spread_vectors(spark):
    v = np.random.default_rng(2).normal(0, 0.2, (1500, 64))
    check(spark, list(range(1500)), v, 16)


def test_ties_repeats_and_equal_centroids(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (900, 2)) / 64  # 25 places: equal vectors, equal centroids and ties everywhere
    for k in (1, 2, 7, 16, 40):
        check(spark, list(range(900)), v, k)
    ids = [i // 3 if i % 11 else None for i in range(300)]
    check(spark, ids, rng.integers(-9, 9, (300, 3)) / 64, 5)


def test_ball_scan_from_any_centroid_and_stale_bounds():
    rng = np.random.default_rng(4)
    x, c = rng.integers(-50, 50, (400, 5)), rng.integers(-50, 50, (30, 5))
    want = ((x[:, None] - c[None]) ** 2).sum(2)
    start = rng.integers(0, 30, 400)
    a, upper, lower, seen = X.assign(x, start, np.full(400, np.inf), np.zeros(400), X.Centroids(c))
    assert np.array_equal(a, want.argmin(1)) and (seen <= 30).all()
    for _ in range(6):
        new = c + rng.integers(-4, 5, c.shape)
        a, upper, lower, _ = X.assign(x, a, upper, lower, X.Centroids(new, c))
        c, d = new, ((x[:, None] - new[None]) ** 2).sum(2)
        assert np.array_equal(a, d.argmin(1))
        own = np.sqrt(d[np.arange(400), a])
        rest = np.sqrt(np.where(np.arange(30) == a[:, None], np.inf, d).min(1))
        assert (upper >= own).all() and (lower <= rest + 1e-9).all()


def test_unusable_vectors_and_empty_tables(spark):
    good = [[0.1] * 4, [0.2] * 4, [0.9] * 4, [1e5] * 4]
    bad = [None, [0.1] * 3, [], [0.1, None, 0.1, 0.1], [0.1, float("nan"), 0.1, 0.1], [0.1, float("inf"), 0, 0], [1e30, 0, 0, 0]]
    df = frame(spark, range(len(good + bad)), good + bad)
    run = X.Exponion(df, k=16, dims=4)
    got = run.digest().collect()
    assert sorted(r.vec_id for r in got) == [0, 1, 2, 3] and len(run.centroids) == 4 and {r.distance for r in got} == {0}
    assert X.Exponion(df.filter("vec_id > 3"), k=16, dims=4).digest().count() == 0
    assert X.Exponion(df.limit(0), dims=4).digest().count() == 0
    nameless = df.filter("vec_id < 3").withColumn("vec_id", df.vec_id * None)
    assert X.Exponion(nameless, dims=4).digest().count() == 0
