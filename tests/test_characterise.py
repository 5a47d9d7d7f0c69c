"""Cycles, universes by rule, perturbations, interruptions and characterisation on small made-up tables."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaweave.operators import edges, nodes, ontology, ranks, text, validate, walks


def test_cycles_are_skipped_and_the_rest_closed(spark):
    # a > b > c > a is a cycle, p > q too; x and y hang below it, u > v > w is apart, s points at itself
    h = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("p", "q"), ("q", "p"), ("x", "a"), ("y", "x"), ("u", "v"), ("v", "w"), ("y", "w"), ("s", "s")], "child string, parent string")
    assert {tuple(r) for r in ontology.cyclic(h).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("p", "p"), ("q", "p")}
    with pytest.warns(UserWarning, match="5 terms"):
        c = {tuple(r) for r in ontology.closure(h, cycles="skip").collect()}
    assert c == {("y", "x"), ("u", "v"), ("u", "w"), ("v", "w"), ("y", "w"), *((t, t) for t in "yxuvw")}
    with pytest.raises(ValueError):
        ontology.closure(h)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert ontology.closure(h.filter("child IN ('u', 'v')"), cycles="skip").count() == 6
        assert ontology.closure(h.limit(0)).count() == 0 and ontology.cyclic(h.limit(0)).count() == 0


def test_universes_by_rule(spark):
    t = ontology.vocabularies({"one": ontology.closure(spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a"), ("e", "d")], "child string, parent string")), "two": ontology.closure(spark.createDataFrame([("b", "z"), ("y", "z")], "child string, parent string"))})
    spaces = spark.createDataFrame([("b", "f"), ("c", "g"), ("e", "g"), ("y", "g")], "node string, namespace string")
    R = ontology.Rule
    got = lambda *rules: sorted(tuple(r) for r in ontology.universes(rules, t, spaces).collect())
    assert got(R("k", "one", ("a",), ("d",))) == [("k", "a"), ("k", "b"), ("k", "c")]
    assert got(R("k", "one", ("a",), with_roots=False, namespace="g"), R("k", "two", namespace="g")) == [("k", "c"), ("k", "e"), ("k", "y")]
    assert got(R("k", "one", skip=("b",)), R("m", "two", ("z",))) == [("k", "a"), ("k", "d"), ("k", "e"), ("m", "b"), ("m", "y"), ("m", "z")]
    assert got(R("k", "none"), R("k", "one", ("nothing",))) == [] and ontology.universes([], t).count() == 0


def test_perturbations_merge_equal_sets(spark):
    m = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (2, "x"), (2, "x"), (3, "x"), (None, "x"), (4, None)], "g int, m string")
    hits = spark.createDataFrame([("x", "c1"), ("y", "c1"), ("y", "c2"), ("w", "c3"), ("x", None)], "m string, cell string")
    got = nodes.perturbations(m, "g", "m", hits, "cell").collect()
    by = {}
    for r in got:
        by.setdefault(r.n1, set()).add((r.metaedge, r.n2))
    assert len(got) == 6 and sorted(map(sorted, by.values())) == [[("has", "x"), ("has", "y"), ("hits", "c1"), ("hits", "c2")], [("has", "x"), ("hits", "c1")]]
    assert nodes.perturbations(m.limit(0), "g", "m", hits, "cell").count() == 0


def test_interruptions_by_quarter(spark):
    rows = [("a", 1, 1), ("a", 2, 30), ("b", 1, 24), ("b", 2, 25), ("c", 1, 99), ("c", 2, 100), ("d", 1, 100), ("e", 1, 0)]
    w = spark.createDataFrame([(s, r, ["x"] * n) for s, r, n in rows], "start string, rep int, walk array<string>")
    got = {r.quarter: (r.below, r.walks, r.nodes) for r in walks.interruptions(w, 100).collect()}
    assert got == {1: (25, 3, 3), 2: (50, 2, 2), 4: (100, 1, 1)}
    place = {r.nd: (r.walks, r.place) for r in walks.interrupted_nodes(w, 100).collect()}
    assert place == {"a": (2, 1), "b": (2, 1), "c": (1, 3), "e": (1, 3)}
    assert walks.interruptions(w.limit(0), 100).count() == 0 and walks.interrupted_nodes(w.limit(0), 4).count() == 0


def test_metanode_cap_and_depropagation(spark):
    ids = spark.createDataFrame([(i,) for i in range(60)], "nd long")
    known = spark.createDataFrame([(i, j) for i in range(40) for j in range(i + 1, 40)] + [(100, 1), (3, 3)], "n1 long, n2 long")
    scored = spark.createDataFrame([(i, j, float(-abs(i - j))) for i in range(0, 60, 5) for j in range(60) if i != j], "n1 long, n2 long, score double")
    whole = validate.metanode_characterised(ids, known, scored).first()
    assert (whole.n_known, whole.n_covered, whole.n_kept, whole.coverage) == (781, 780, 780, 780 / 781) and 0.5 < whole.auroc < 1
    some = validate.metanode_characterised(ids, known, scored, most=200).first()
    assert 150 < some.n_kept < 250 and some.n_covered == 780
    closure = ontology.closure(spark.createDataFrame([(1, 0), (2, 0)], "child long, parent long"))
    few = spark.createDataFrame([(1, 2), (0, 2), (0, 7), (1, 7)], "n1 long, n2 long")
    less = validate.metanode_characterised(ids, few, scored, closure).first()
    assert less.n_kept == 3  # (0, 2) is above (1, 2); pairs with 7, outside the closure, stay


def test_intra_tiers_and_coverage(spark):
    ids = spark.createDataFrame([(i,) for i in range(10)], "nd long")
    known = spark.createDataFrame([(0, 1, 3.0), (0, 2, 2.0), (0, 3, 1.0), (4, 99, 9.0)], "n1 long, n2 long, w double")
    scored = spark.createDataFrame([(0, j, float(-j)) for j in range(1, 10)], "n1 long, n2 long, score double")
    got = {r.tier: r for r in validate.intra_characterised(ids, known, scored, {"max": 0.0, "all": 1.0}).collect()}
    assert got["max"].auroc == 1.0 and got["all"].auroc == 1.0 and (got["max"].pairs, got["all"].pairs) == (4, 6)
    assert (got["all"].nodes_cov, got["all"].val_nodes_cov, got["all"].val_edges_cov) == (0.4, 4 / 6, 0.75)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_ranks_of_blocks_against_all_distances(spark, metric, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 3)), 1) + 0.05
    v = spark.createDataFrame([(i * 3, r.tolist()) for i, r in enumerate(x)] + [(None, [1.0] * 3), (5000, None)], "nd long, v array<double>").repartition(4)
    if metric == "l2":
        d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 6)
    else:
        norm = np.sqrt((x * x).sum(1))
        d = np.round(1 - x @ x.T / np.outer(norm, norm), 6)
    monkeypatch.setattr(ranks, "PACK", 64)
    order = np.argsort(d, axis=1, kind="stable")[:, :40]
    got = ranks.ranked(v, 40, metric, what="all", most=60_000).collect()
    assert len(got) == 300 * 40
    place = {(r.q, r.nd): (r["rank"], r.d) for r in got}
    same = sum(place.get((3 * i, 3 * int(j)), (-1,))[0] == k for i in range(300) for k, j in enumerate(order[i]))
    assert same == 12_000 if metric == "l2" else same > 11_900  # rounded ties of cosines may fall either way
    asked = spark.createDataFrame([(3 * i, 3 * ((i * 11) % 300)) for i in range(300)] + [(3, 3 * 33), (7, 0), (None, 0)], "q long, nd long")
    some = {(r.q, r.nd): (r["rank"], r.d) for r in ranks.ranked(v, 40, metric, asked=asked).collect()}
    want = {k: r for k, r in place.items() if k in {(3 * i, 3 * ((i * 11) % 300)) for i in range(300)} | {(3, 99)}}
    assert some.keys() == want.keys() and all(some[k][0] == want[k][0] for k in some)
    sums = ranks.ranked(v, 40, metric, what="sums").collect()
    kept = np.sort(d, axis=1)[:, :40]
    assert len(sums) == 300 and all(np.allclose((r.n, r.s, r.s2, r.most), (40, kept[r.q // 3].sum(), (kept[r.q // 3] ** 2).sum(), kept[r.q // 3].max()), atol=1e-4) for r in sums)
    far = validate.farthest(ranks.ranked(v, 40, metric, what="sums")).first().far
    assert abs(far - (kept.max() + kept.std())) < 1e-4
    assert ranks.ranked(v.limit(0), 5, metric, what="all").count() == 0 and ranks.ranked(v, 5, metric, asked=asked.filter(F.col("q") == 7)).count() == 0


@pytest.mark.parametrize(("metric", "held"), [("l2", 500), ("cosine", 500), ("cosine", 50_000)])
def test_places_are_counted_by_thousands_of_queries(spark, metric, held, monkeypatch):
    monkeypatch.setattr(ranks, "PACK", 16)
    monkeypatch.setattr(ranks, "HELD", held)
    x = np.repeat(np.round(np.random.default_rng(6).normal(size=(150, 4)), 1) + 0.05, 2, axis=0)  # every vector twice
    x[::7] = x[0]
    x = x.astype(np.float32).astype(np.float64)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "nd long, v array<double>").repartition(4)
    norm = np.sqrt((x * x).sum(1))
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 6) if metric == "l2" else np.round(1 - x @ x.T / np.outer(norm, norm), 6) + 0.0
    place = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1, kind="stable")
    asked = spark.createDataFrame([(q, nd) for q in range(300) for nd in range(0, 300, 10 if q % 2 else 90)], "q long, nd long")  # few and many partners
    df = ranks.ranked(v, 300, metric, asked=asked)
    got = {(r.q, r.nd): r["rank"] for r in df.collect()}
    assert len(got) == asked.count() and np.mean([got[p] == place[p] for p in got]) > (0.999 if metric == "l2" else 0.98)
    assert {r.q for r in ranks.ranked(v, 0, metric, what="sums").collect()} == set()


def test_distances_in_units_are_those_pair_by_pair():
    x = np.random.default_rng(7).normal(size=(60, 64)).astype(np.float32).astype(np.float64)
    y = np.concatenate([x[:20], x[20:40] + 1e-7, np.random.default_rng(8).normal(size=(60, 64)), np.zeros((1, 64))])
    for metric in ("l2", "cosine"):
        got = ranks._units(x, y, metric, 6)
        want = np.array([ranks._whole(ranks._one_by_one(np.repeat(a[None], len(y), 0), y, metric, 6)) for a in x])
        assert (got == want).all() and (got[np.arange(20), np.arange(20)] == 0).all()
        assert metric == "l2" or (got[:, -1] == ranks.NO_NUMBER).all()


def test_cross_references_are_normalised_once(spark):
    pairs = spark.createDataFrame([("omim_12", "DOID:7"), ("OMIM:12", "doid:7"), ("mesh:D1", "HP_0003"), ("what", "DOID:1"), (None, "DOID:1"), ("DOID:8", "DOID_7")], "n1 string, n2 string")
    alt = spark.createDataFrame([("DOID:8", "DOID:7"), ("HP:0003", "HP:9"), ("HP:0003", "HP:8")], "src string, dst string")
    got = sorted(tuple(r) for r in edges.cross_references({"one": pairs, "two": pairs.limit(0)}, alt).collect())
    assert got == [("one", "MESH:D1", "HP:8"), ("one", "OMIM:12", "DOID:7")]


def test_xrefs_are_oriented_and_curated_ones_win(spark):
    curated = spark.createDataFrame([("R:1", "A:1"), ("A:1", "R:1"), ("A:2", "B:2"), ("R:1", "R:2"), (None, "R:3")], "n1 string, n2 string")
    predicted = spark.createDataFrame([("A:1", "R:9", 0.1), ("R:5", "B:2", 0.25), ("B:2", "R:5", 0.5), ("A:3", "A:4", 0.0)], "n1 string, n2 string, dist double")
    got = sorted(tuple(r) for r in text.assembled_xrefs(curated, predicted, "R").collect())
    assert got == [("A:1", "R:1", "curated", 1.0), ("B:2", "R:5", "predicted", 0.75)]
