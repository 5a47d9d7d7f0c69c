"""Products, paths and steps whose pairs are made where they are summed up; lists carry them through the shuffle."""

import random
import re

from metaweave.operators import edges, matrix as M, nodes, walks
from metaweave.plans import metapath, network


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def names(text):
    return sorted(re.sub(r"#\d+L?", "", x).strip() for x in text.split(",") if not x.strip().isdigit() and "REPARTITION" not in x and "ENSURE" not in x and "plan_id" not in x)


def test_long_lines_are_cut_and_whole(spark, monkeypatch):
    monkeypatch.setattr(M, "LINE", 10)
    cells = spark.createDataFrame([("a", f"c{i}", float(i)) for i in range(95)] + [("b", "c1", 2.0)], "k string, c string, y double")
    got = M.lines(cells, "k", "c", "y").collect()
    assert sorted((r.k, c, y) for r in got for c, y in zip(r.c, r.y)) == sorted(map(tuple, cells.collect()))
    assert len([r for r in got if r.k == "a"]) > 5 and max(len(r.c) for r in got) < 40


def test_no_row_a_pair_is_shuffled(spark):
    rng = random.Random(3)
    ab = sorted({(f"A{rng.randrange(30)}", f"B{rng.randrange(20)}") for _ in range(200)})
    bc = sorted({(f"B{rng.randrange(20)}", f"C{rng.randrange(30)}") for _ in range(200)})
    one = spark.createDataFrame([(*x, 2.0) for x in ab], "r string, c string, w double")
    two = spark.createDataFrame([(*x, 0.5) for x in bc], "r string, c string, w double")
    p = M.product(M.of(one), M.of(two)).cells
    want = {}
    for a, b in ab:
        for b2, c in bc:
            if b == b2:
                want[a, c] = want.get((a, c), 0) + 1.0
    assert {(r.r, r.c): r.w for r in p.collect()} == want
    assert ["c", "r"] not in [names(x) for x in exchanges(p)]
    e = lambda rows: spark.createDataFrame(rows, "n1 string, n2 string")
    b = edges.bridge_paths(e(ab), e(bc))
    assert {tuple(r) for r in b.collect()} == {k for k, n in want.items() if n == 1}
    assert ["n1", "n2"] not in [names(x) for x in exchanges(b)] and ["n1", "n3"] not in [names(x) for x in exchanges(b)]


def test_steps_and_perturbations_dealt_by_their_first_node(spark):
    rng = random.Random(4)
    pairs = sorted({(f"A{rng.randrange(25):02}", f"A{rng.randrange(25):02}") for _ in range(60)})
    e = spark.createDataFrame(pairs, "n1 string, n2 string")
    for n in (1, 2, 3):
        seen = set(pairs)
        for _ in range(n - 1):
            seen |= {(a, d) for a, b in seen for c, d in pairs if b == c}
        got = walks.step_shortcuts(e, n)
        assert sorted(map(tuple, got.collect())) == sorted(x for x in seen if x[0] != x[1] and x not in pairs and x[::-1] not in pairs)
    m = spark.createDataFrame([(i % 9, f"m{rng.randrange(12)}") for i in range(40)], "g int, m string")
    hits = spark.createDataFrame([(f"m{i % 12}", f"c{i % 7}") for i in range(60)], "m string, cell string")
    to = nodes.perturbations(m, "g", "m", hits, "cell")
    assert to.count() == to.distinct().count() > 0 and ["n1", "n2"] not in [names(x) for x in exchanges(to)]


def test_rows_that_keep_all_are_not_ranked(spark):
    rng = random.Random(6)
    ab = spark.createDataFrame(sorted({(f"A{rng.randrange(30)}", f"B{rng.randrange(20)}") for _ in range(150)}), "n1 string, n2 string")
    bc = spark.createDataFrame(sorted({(f"B{rng.randrange(20)}", f"C{rng.randrange(30)}") for _ in range(150)}), "n1 string, n2 string")
    get = lambda edge, dataset: {"A-x-B": ab, "B-y-C": bc}[edge]
    whole = network.query(metapath.parse("metapath\tA-x-B-y-C\ndatasets\td||d\npruning_cutoffs\t1.0,3,100000000"), get).cells
    cut = network.query(metapath.parse("metapath\tA-x-B-y-C\ndatasets\td||d\npruning_cutoffs\t0.1,1,2"), get).cells
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(whole) and "Window" in plan(cut)
    assert 0 < cut.count() < whole.count()
