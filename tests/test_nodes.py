"""Node operators and the validation bundle on small made tables."""

import numpy as np

from metaweave.operators import evaluate, nodes, numbering, stats, swap, validate
from metaweave.operators.components import components


def test_numbered_is_dense_and_in_order(spark):
    df = spark.range(0, 5000, 1, 13).selectExpr("id * 7 % 5003 AS x", "id")
    got = [(r.x, r.p) for r in numbering.numbered(df, ["x"], "p").orderBy("p").collect()]
    assert [p for _, p in got] == list(range(5000)) and [x for x, _ in got] == sorted(x for x, _ in got)


def test_negatives_of_a_saturated_source(spark):
    e = spark.createDataFrame([("a", f"t{i}") for i in range(9)] + [("b", "t0"), ("c", "t9")], "n1 string, n2 string")
    got = {}
    for r in evaluate.negatives(e, 3).collect():
        got.setdefault(r.n1, []).append(r.n2)
    assert got["a"] == ["t9"] and len(got["b"]) == 1 and got["b"][0] != "t0" and len(got["c"]) == 1 and got["c"][0] != "t9"


def test_places_count_all_vectors(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(200, 4)), 1)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "nd long, v array<double>").repartition(5)
    pairs = spark.createDataFrame([(i, (i * 7 + 3) % 200) for i in range(0, 200, 3)], "q long, nd long")
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 6)
    for most in (2_000_000, 20):
        got = {(r.q, r.nd): r["rank"] for r in evaluate.places(pairs, v, "l2", most=most).collect()}
        assert got == {(i, j): sum((d[i, k], k) < (d[i, j], j) for k in range(200)) for i in range(0, 200, 3) for j in [(i * 7 + 3) % 200]}


def test_components_of_many_links_by_both_ways(spark, monkeypatch):
    from metaweave.operators import components as C

    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40) if i % 10] + [("z", "z")], "a string, b string")
    few = sorted(map(tuple, components(links).collect()))
    monkeypatch.setattr(C, "PER_TASK", 0)
    assert sorted(map(tuple, components(links).collect())) == few and len({c for _, c in few}) == 5


def test_near_duplicates_of_a_dense_bucket(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + 1e-6 * rng.normal(size=16)).tolist()) for i in range(12)] + [(100 + i, rng.normal(size=16).tolist()) for i in range(20)] + [(200, rng.normal(size=16).tolist())] * 2
    got = {}
    for r in nodes.without_near_duplicates(spark.createDataFrame(rows, "nd long, v array<double>"), 16).collect():
        got[r.nd] = r.kept
    assert [i for i in range(12) if got[i]] == [0] and all(got[100 + i] for i in range(20)) and got[200]


def test_tree_by_indentation(spark):
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(["a", "--b", "----c", "----d", "--e", "----f", "g", "--h"])], "doc int, line int, text string")
    assert {tuple(r) for r in nodes.indented(lines).collect()} == {("b", "a"), ("c", "b"), ("d", "b"), ("e", "a"), ("f", "e"), ("h", "g")}


def test_characterised_depropagates_first(spark):
    ids = spark.createDataFrame([(x,) for x in "abcp"], "nd string")
    known = spark.createDataFrame([("a", "b"), ("p", "b")], "n1 string, n2 string")
    closure = spark.createDataFrame([("a", "p"), *[(x, x) for x in "abcp"]], "node string, anc string")
    scored = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("p", "b", 0.2), ("b", "a", 0.8)], "n1 string, n2 string, score double")
    r = validate.characterised(ids, known, scored, closure).first()
    assert (r.n_known, r.n_inside, r.auroc, r.coverage) == (1, 1, 1.0, 1.0)


def test_swapped_edges_keep_degrees(spark):
    from collections import Counter

    rng = np.random.default_rng(4)
    banned = spark.createDataFrame([("a1", "b1"), ("a2", "b2")], "n1 string, n2 string")
    # even degrees, and hubs joined to nearly all, whose edges cannot all be swapped
    for first in (lambda: int(rng.integers(0, 60)), lambda: int(rng.zipf(1.6)) % 60):
        e = sorted({(f"a{first()}", f"b{int(rng.integers(0, 80))}") for _ in range(700)})
        df = spark.createDataFrame(e + e[:9] + [(None, "b1"), ("x", "x")], "n1 string, n2 string").repartition(4)
        got = [tuple(r) for r in swap.swapped(df, tries=8, banned=banned).collect()]
        pairs = [r[:2] for r in got]
        assert len(set(pairs)) == len(pairs) <= len(e) and not set(pairs) & (set(e) | {("a1", "b1"), ("a2", "b2")})
        exact = [r[:2] for r in got if r[2]]
        for side in (0, 1):
            have, want = Counter(p[side] for p in exact), Counter(p[side] for p in e)
            assert all(have[n] <= want[n] for n in have)
        degree, others = Counter(p[0] for p in e), len({p[1] for p in e})
        reachable = sum(min(d, others - d) for d in degree.values())
        assert 0.8 * reachable < len(exact) <= reachable
        assert sorted(got) == sorted(tuple(r) for r in swap.swapped(df, tries=8, banned=banned).collect())
    ring = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 40}") for i in range(40)], "n1 string, n2 string")
    both = [(r.n1, r.n2) for r in swap.swapped(ring, undirected=True, fill=False).collect()]
    assert all(a < b for a, b in both) and max(Counter(x for p in both for x in p).values()) <= 2
    full = spark.createDataFrame([(f"a{i}", f"b{j}") for i in range(3) for j in range(3)], "n1 string, n2 string")
    assert swap.swapped(full, tries=3).count() == 0 and swap.swapped(full.limit(0)).count() == 0


def test_coverage_against_its_definition(spark):
    rng = np.random.default_rng(3)
    rows = [(f"{k}{i}", k, int(rng.zipf(1.5)) % 30) for k in "pq" for i in range(150)] + [("r0", "r", 3)]
    got = {r.kind: (r.c1, r.auc) for r in stats.component_coverage(spark.createDataFrame(rows, "node string, kind string, component long")).collect()}
    all_ = {c for *_, c in rows}
    for kind in "pqr":
        own = [c for _, k, c in rows if k == kind]
        share = sorted((own.count(c) / len(own) for c in all_), reverse=True)
        y = np.concatenate([[0], np.cumsum(share)])
        assert np.allclose(got[kind], (share[0], ((y[1:] + y[:-1]) / 2).sum() / len(y)))
    one = spark.createDataFrame([("a", "x", 1), ("b", "x", 1)], "node string, kind string, component long")
    assert tuple(stats.component_coverage(one).first()) == ("x", 1.0, 1.0)


def test_swaps_shuffle_numbers_instead_of_pairs(spark, monkeypatch):
    from metaweave.operators import swap as W

    kept, save = [], W.saved
    monkeypatch.setattr(W, "saved", lambda df, name="t": (kept.append((name, df.columns)), save(df, name))[1])
    rows = sorted({(f"a{(i * 7) % 23}", f"b{(i * i) % 31}") for i in range(150)})
    e = spark.createDataFrame(rows, "n1 string, n2 string")
    for few in (0, 100_000):  # known pairs shuffled, and narrowed by the mates
        monkeypatch.setattr(W, "FEW", few)
        got = [(r.n1, r.n2) for r in W.swapped(e, tries=8, fill=False).filter("exact").collect()]
        assert len(got) > len(rows) // 2 and len(got) == len(set(got)) and not set(got) & set(rows)
        for end in (0, 1):
            for x in {r[end] for r in got}:
                assert sum(g[end] == x for g in got) <= sum(r[end] == x for r in rows)
    assert ("new", ["a", "b", "id"]) in kept
