"""Hand-checked micro-cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from metaweave.operators import edges as E
from metaweave.operators import evaluate as V
from metaweave.operators import matrix as M
from metaweave.operators import ontology as O
from metaweave.operators import stats as S
from metaweave.operators import walks as K
from metaweave.operators.components import components
from metaweave.plans import metapath, network


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "n1 string, n2 string" + (", w double" if pairs and len(pairs[0]) > 2 else ""))


def hierarchy(spark, pairs):
    return O.closure(spark.createDataFrame(pairs, "child string, parent string"))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_hop_product(spark):
    table = {"A-x-B": [("a1", "b1"), ("a1", "b2"), ("a2", "b2")], "B-y-C": [("b1", "c1"), ("b2", "c1"), ("b2", "c2"), ("b3", "c3")]}
    get = lambda e, d: edges(spark, table[e])
    all_ = network.query(metapath.parse("metapath\tA-x-B-y-C\ndatasets\td||d"), get)
    assert [(r, c, round(w, 6)) for r, c, w in got(all_.cells)] == [("a1", "c1", 0.75), ("a1", "c2", 0.353553), ("a2", "c1", 0.353553), ("a2", "c2", 0.5)]
    few = network.query(metapath.parse("metapath\tA-x-B-y-C\ndatasets\td||d\npruning_cutoffs\t0.5,1,1"), get)
    assert [x[:2] for x in got(few.cells)] == [("a1", "c1"), ("a2", "c2")]


def test_empty_lines_go_in_one_pass(spark):
    hops = [M.matrix(edges(spark, p)) for p in ([("a1", "b1"), ("a2", "b2")], [("b1", "c1"), ("b2", "c2")], [("c1", "d1")])]
    hops = M.drop_empty(M.fit(hops))
    assert hops[0].rows.count() == 2 and got(hops[0].cells) == [("a1", "b1", 1.0)] and got(hops[0].cols) == [("b1",)]


def test_self_loop_cell_and_symmetry(spark):
    m = M.Matrix(M.matrix(edges(spark, [("x", "z")])).cells, spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("y",), ("z",)], "id string"))
    assert got(M.set_diagonal(m, 1).cells) == [("x", "z", 1.0), ("y", "y", 1.0)]
    assert got(M.matrix(edges(spark, [("x", "z"), ("z", "x"), ("x", "x")]), undirected=True).cells) == [("x", "z", 1.0), ("z", "x", 1.0)]


def test_diamond(spark):
    c = hierarchy(spark, [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")])
    up = O.propagate(edges(spark, [("d", "x"), ("b", "x"), ("c", "y")]), c)
    assert got(up) == [("a", "x"), ("a", "y"), ("b", "x"), ("c", "x"), ("c", "y"), ("d", "x")]
    assert got(O.depropagate(up, c)) == [("c", "y"), ("d", "x")]
    assert got(O.youngest(spark.createDataFrame([("a",), ("b",), ("c",)], "node string"), c)) == [("b",), ("c",)]
    with pytest.raises(ValueError):
        hierarchy(spark, [("a", "b"), ("b", "a")])


def test_both_sides_dispatch(spark):
    c1, c2 = hierarchy(spark, [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")]), hierarchy(spark, [("p", "q")])
    e = edges(spark, [("d", "p"), ("b", "z"), ("k", "p"), ("k", "z")])
    strict = got(O.dispatch(e, c1, c2))
    assert strict == sorted([(x, y) for x in "dbca" for y in "pq"] + [("k", "z")])
    assert len(got(O.dispatch(e, c1, c2, strict=False))) > len(strict)


def test_propagation_on_random_hierarchies(spark):
    rng = random.Random(3)
    h = [(f"n{i}", f"n{rng.randrange(i)}") for i in range(1, 40) for _ in range(2)]
    c = hierarchy(spark, h)
    e = edges(spark, [(f"n{rng.randrange(40)}", f"t{rng.randrange(6)}") for _ in range(60)])
    up = O.propagate(e, c)
    assert got(O.propagate(O.depropagate(e, c), c)) == got(up) == got(O.propagate(up, c))


def test_dataset_merge(spark):
    e = spark.createDataFrame([("p", "q", 2.0, 1), ("p", "q", 5.0, 2), ("p", "r", 1.0, 2)], "n1 string, n2 string, w double, ordinal int")
    assert got(E.merge_conservative(e)) == [("p", "q", 2.0), ("p", "r", 1.0)] and got(E.merge_sum(e)) == [("p", "q", 7.0), ("p", "r", 1.0)]


def test_auroc_with_ties(spark):
    s = spark.createDataFrame([(0.9, 1), (0.4, 1), (0.5, 0), (0.4, 0)], "score double, label int")
    assert V.auroc(s, []).first().auroc == 0.625


def test_gini(spark):
    for x, want in (([0, 0, 0, 1], 0.75), ([1, 1, 1, 1], 0.0)):
        assert math.isclose(S.gini(spark.createDataFrame([(v,) for v in x], "degree int")).first().gini, want, abs_tol=1e-5)


def test_component_retention(spark):
    big = [(f"r{i}", f"c{j}") for i in range(50) for j in (i, (i + 1) % 50)]
    small = [(f"r{50 + i}", f"c{50 + j}") for i in range(2) for j in range(5)]
    m = M.matrix(edges(spark, big + small))
    assert m.rows.count() == 52 and m.cols.count() == 55
    assert network.retained(m, 0.05).count() == 100 and network.retained(m, 0.03).count() == 107


def test_components_are_those_of_a_union_find(spark):
    rng = random.Random(2)
    links = [(f"v{rng.randrange(80)}", f"v{rng.randrange(80)}") for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got(components(spark.createDataFrame(links, "a string, b string"))) == sorted((x, find(x)) for x in {y for p in links for y in p})


def test_walks_follow_edges(spark):
    e = edges(spark, [("a", "b", 3.0), ("b", "c", 1.0), ("d", "e", 2.0)])
    known = {frozenset(x[:2]) for x in e.collect()}
    w = K.random_walks(e, 4, 6, seed=5).collect()
    assert len(w) == 20 and all(len(r.walk) == 6 and all(frozenset(p) in known for p in zip(r.walk, r.walk[1:], strict=False)) for r in w)
    assert sorted(map(str, w)) == sorted(map(str, K.random_walks(e, 4, 6, seed=5).collect()))
    share = [r.walk[1] for r in K.random_walks(e, 400, 2).filter("start = 'b'").collect()]
    assert 0.68 < share.count("a") / len(share) < 0.82
    assert got(K.step_shortcuts(edges(spark, [("1", "2"), ("2", "3")]), 2)) == [("1", "3")]


def test_negatives_are_no_partners(spark):
    rng = random.Random(1)
    e = edges(spark, sorted({(f"s{rng.randrange(8)}", f"t{rng.randrange(60)}") for _ in range(80)}))
    neg = got(V.negatives(e, 3))
    assert not set(neg) & set(got(e)) and len(neg) == len(set(neg)) == e.count()


def test_name_resolution_and_mapping(spark):
    p, s = (spark.createDataFrame(x, "src string, dst string") for x in ([("ABC", "CVCL_1")], [("XYZ", "CVCL_2")]))
    bad = spark.createDataFrame([("BAD",)], "name string")
    e = spark.createDataFrame([("abc", 1), ("xyz", 2), ("bad", 3), ("CVCL_9", 4), ("none", 5)], "name string, k int")
    assert got(E.resolve_names(e, "name", p, s, bad, "CVCL_")) == [("CVCL_1", 1), ("CVCL_2", 2), ("CVCL_9", 4)]
    x = spark.createDataFrame([("k", "MESH:1"), ("k", "DOID:7"), ("m", "HP:2")], "key string, xref string")
    assert got(E.preferred_xref(x, "key", "xref", ["DOID", "MESH", "HP"])) == [("k", "DOID:7"), ("m", "HP:2")]
    assert E.normalise_id(F.lit("x")) is not None
