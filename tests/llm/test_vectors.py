import numpy as np

from metaweave.llm import vectors as V


def corpus(seed, n=500, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(40)] + rng.choice([0, 0.02, 0.05, 0.3]) * rng.normal(size=dim)
        rows.append((i * 7, [float(np.float32(x)) for x in v], int(rng.integers(3)), 0))
    rows += [(9001, None, 1, 0), (9002, [0.0] * dim, 1, 0), (9003, rows[0][1], None, 0), (9004, [float("nan"), *rows[0][1][1:]], 1, 0), (9005, [None, *rows[0][1][1:]], 1, 0), (9006, rows[0][1], rows[0][2], 0), (9007, [float("inf"), *rows[0][1][1:]], 1, 0), (None, rows[0][1], rows[0][2], 0)]
    return rows


def brute(rows, t):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    x = np.array([r[1] for r in ok])
    hit = (V.unit_products(x) >= t) & (np.array([r[2] for r in ok])[:, None] == np.array([r[2] for r in ok])[None])
    np.fill_diagonal(hit, False)
    lab = V.labelled(hit)
    ids = np.array([r[0] for r in ok])
    least = {k: int(ids[lab == k].min()) for k in set(lab)}
    return {int(i): (int(n), least[k]) for i, n, k in zip(ids, hit.sum(1), lab, strict=True)}


def test_prune_keeps_the_nearest_and_search_reaches_all_within_range():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8))
    x[100:] = x[:100] + 0.01 * rng.normal(size=(100, 8))
    s = V.unit_products(x)
    g = V.robust_prune(s, 16, 64, 1.2)
    off = s - 2 * np.eye(200)
    assert all(o[0] == off[i].argmax() for i, o in enumerate(g)) and max(map(len, g)) <= 16
    seen = V.search(s, g, int(s.sum(1).argmax()), 24, 0.9)
    assert (seen & (off >= 0.98)).sum() / (off >= 0.98).sum() > 0.97


def beside(group, pairs=100, dim=64):
    """A group of distinct near vectors, and pairs of near vectors far from it."""
    rng = np.random.default_rng(group)
    one = rng.normal(size=(pairs, dim))
    near = rng.normal(size=dim) + 0.03 * rng.normal(size=(group, dim))
    return np.concatenate([near, one, one + 0.05 * rng.normal(size=(pairs, dim))])


def test_search_leaves_and_fills_a_group_of_near_vectors():
    for group in (4, 80, 200, 400):
        s = V.unit_products(beside(group))
        g = [np.union1d(o, t[t >= 0]) for o, t in zip(V.robust_prune(s, 16, 64, 1.2), V.strongest_tree(s)[:, None], strict=True)]
        want = (s >= 0.98) & ~np.eye(len(s), dtype=bool)
        seen = V.search(s, g, int(s.sum(1).argmax()), 24, 0.9)
        assert want[:group].sum() == group * (group - 1) and want[group:].sum() == 200
        assert (seen & want).sum() == want.sum()


def test_strongest_tree():
    s = V.unit_products(np.random.default_rng(3).normal(size=(30, 4)))
    to = V.strongest_tree(s)
    tree = np.zeros((30, 30), dtype=bool)
    tree[np.arange(1, 30), to[1:]] = True
    assert to[0] == -1 and not V.labelled(tree | tree.T).any()
    for cut in (0.5, 0.8, 0.9):
        assert (V.labelled((tree | tree.T) & (s >= cut)) == V.labelled((s >= cut) & ~np.eye(30, dtype=bool))).all()


def test_links_beside_groups_of_near_vectors(spark):
    for group in (80, 1000):
        x = beside(group)
        rows = [(i, [float(f) for f in v], 1) for i, v in enumerate(x)]
        got = V.Near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).rows().collect()
        s = V.unit_products(x)
        want = {i: int(n) - 1 for i, n in enumerate((s >= 0.98).sum(1))}
        assert sum(r.n_links for r in got if r.vec_id >= group) == sum(n for i, n in want.items() if i >= group) == 200


def test_shards_fit_and_groups_that_centres_cannot_divide_are_whole(spark):
    rng = np.random.default_rng(6)
    one = rng.normal(size=16)
    x = np.concatenate([beside(300, 100, 16), one * np.linspace(1, 2, 250)[:, None]])
    rows = [(i, [float(f) for f in v], 1) for i, v in enumerate(x)]
    near = V.Near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3), shard=60, most_centres=40)
    assert near.members.groupBy("shard").count().agg({"count": "max"}).first()[0] <= 60
    want = (V.unit_products(x) >= 0.98).sum(1) - 1
    got = {r.vec_id: r.n_links for r in near.rows().collect()}
    assert all(got[i] == want[i] for i in (*range(300), *range(500, 750)))
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) / want.sum() > 0.99


def test_met_before():
    shards = [np.array(x, dtype=np.int64) for x in ([1, 3, 5], [3, 5], [2, 5], [1, 5])]
    met = V.met_before(shards, 5)
    assert met[0, 1] and met[0, 3] and not met[0, 2] and not met[1, 3] and not V.met_before(shards, 1).any()


def test_labelled():
    a = np.zeros((6, 6), dtype=bool)
    for i, j in ((5, 4), (4, 1), (3, 2)):
        a[i, j] = a[j, i] = True
    assert V.labelled(a).tolist() == [0, 1, 2, 2, 1, 1]


def test_against_brute_force(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, m int").repartition(3)
    want = brute([(r[0], None if r[1] is None else [None if v is None else float(np.float32(v)) for v in r[1]], *r[2:]) for r in rows], 0.98)
    for shard in (1000, 60):
        got = V.Near(df, shard=shard).rows().collect()
        assert len(got) == len(rows)
        found = sum(min(r.n_links, want[r.vec_id][0]) for r in got if r.vec_id in want)
        assert found / sum(n for n, _ in want.values()) > 0.95
        assert all(r.n_links <= want[r.vec_id][0] for r in got if r.vec_id in want)
        for r in got:
            if r.vec_id is not None and r.vec_id not in want:
                assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
            assert r.kept == (r.vec_id == r.component_id if r.vec_id is not None else None)
        assert np.mean([r.component_id == want[r.vec_id][1] for r in got if r.vec_id in want]) > 0.95
        assert V.audit(df.filter("vec_id < 9000"), V.Near(df.filter("vec_id < 9000"), shard=shard).rows(), every=50) > 0.9


def test_empty(spark):
    assert V.Near(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).rows().count() == 0
