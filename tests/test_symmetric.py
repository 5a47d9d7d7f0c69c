"""Products of a hop with itself turned over: half is made, and the result is that of the whole product."""

import random

import pytest

from metaweave.operators import matrix as M
from metaweave.plans import metapath, network


def edges_of(spark):
    rng = random.Random(5)
    rows = sorted({(f"A{rng.randrange(40)}", f"B{rng.randrange(25)}", rng.choice(["1", "2", "0.5"])) for _ in range(220)})
    ab = spark.createDataFrame(rows, "n1 string, n2 string, w string")
    own = spark.createDataFrame(sorted({(f"G{rng.randrange(30)}", f"G{rng.randrange(30)}") for _ in range(150)}), "n1 string, n2 string")
    cb = spark.createDataFrame(sorted({(f"C{rng.randrange(9)}", f"A{rng.randrange(45)}") for _ in range(60)}), "n1 string, n2 string")
    turned = ab.select(ab.n2.alias("n1"), ab.n1.alias("n2"), "w")
    known = {"A-x-B": ab, "B-x-A": turned, "C-y-A": cb, "GEN-ppi-GEN": own}
    return lambda edge, dataset: known[edge].limit(40) if dataset == "part" else known[edge]


@pytest.mark.parametrize(
    "text, halves",
    [
        ("metapath\tA-x-B-x-A\ndatasets\td||d\npruning_cutoffs\t0.1,1,4", 1),
        ("metapath\tA-x-B-x-A\ndatasets\td||d\nis_weighted\tTrue\npruning_method\tintersection\nremove_intra_selfloops\tTrue", 1),
        ("metapath\tGEN-ppi-GEN-ppi-GEN\ndatasets\td||d", 1),
        ("metapath\tC-y-A-x-B-x-A\ndatasets\td||d||part", 0),
    ],
)
def test_half_products(spark, monkeypatch, text, halves):
    edges, made, half = edges_of(spark), [], M.square_half
    monkeypatch.setattr(M, "square_half", lambda a: made.append(1) or half(a))
    got = sorted(map(tuple, network.query(metapath.parse(text), edges).cells.collect()))
    assert len(made) == halves
    monkeypatch.setattr(M, "transposed", lambda a, b: False)
    assert got == sorted(map(tuple, network.query(metapath.parse(text), edges).cells.collect())) and got


def test_sums_in_any_order_round_alike(spark):
    df = spark.createDataFrame([(2.0**-9 + e,) for e in (0.0, 4e-19, -4e-19, 1e-17, -1e-17)], "w double")
    assert [r.w for r in df.select(M.rounded("w", 8).alias("w")).distinct().collect()] == [0.00195313]


def test_turned_over(spark):
    a = M.of(spark.createDataFrame([("a", "b", 1.0), ("c", "b", 2.0)], "r string, c string, w double"))
    b = M.of(spark.createDataFrame([("b", "a", 1.0), ("b", "c", 2.0)], "r string, c string, w double"))
    c = M.of(spark.createDataFrame([("b", "a", 2.0), ("b", "c", 1.0)], "r string, c string, w double"))
    assert M.transposed(a, b) and not M.transposed(a, c) and not M.transposed(a, a)
    none = M.Matrix(a.cells.limit(0), a.rows.limit(0), a.cols.limit(0))
    assert M.transposed(none, none)
