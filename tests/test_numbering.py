"""The k-th free node of a source, at hubs and over spans of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaweave.operators import evaluate, numbering


@pytest.mark.parametrize("span", [1, 3, 8, 1 << 16])
def test_every_free_node_is_found(spark, span):
    rng = np.random.default_rng(span)
    nodes = [f"n{i:03d}" for i in range(60)]
    taken = {s: set(rng.choice(nodes, n, replace=False)) for s, n in (("few", 3), ("half", 30), ("most", 58), ("all", 60))}
    taken["first"], taken["last"], taken["none"] = set(nodes[:40]), set(nodes[40:]), set()
    rows = [(s, x) for s, xs in taken.items() for x in xs] + [("few", "stranger"), ("half", min(taken["half"]))]
    asked = [(s, i, f"tag{i}") for s in taken for i in range(60)]
    got = numbering.nth_free(spark.createDataFrame(rows, "n1 string, nd string"), spark.createDataFrame([(x,) for x in nodes + nodes[:5]], "nd string"), spark.createDataFrame(asked, "n1 string, i int, span string"), lambda free: F.col("i"), span).collect()
    want = sorted((s, i, f"tag{i}", x) for s in taken for i, x in enumerate(n for n in nodes if n not in taken[s]))
    assert sorted((r.n1, r.i, r.span, r.nd) for r in got) == want


def test_asked_twice_and_without_further_columns(spark):
    taken, nodes = spark.createDataFrame([("a", 1), ("a", 2)], "n1 string, nd long"), spark.createDataFrame([(i,) for i in range(5)], "nd long")
    asked = spark.createDataFrame([("a",), ("a",), ("b",)], "n1 string")
    got = numbering.nth_free(taken, nodes, asked, lambda free: free - 1).collect()
    assert sorted(tuple(r) for r in got) == [("a", 4), ("a", 4), ("b", 4)]
    assert numbering.nth_free(taken, nodes.limit(0), asked, lambda free: F.lit(0)).count() == 0


def test_negatives_of_a_hub(spark):
    n = 100_000
    hub = spark.range(n).select(F.lit("hub").alias("n1"), F.format_string("t%06d", "id").alias("n2"))
    other = spark.range(2 * n).select(F.lit("other").alias("n1"), F.format_string("t%06d", "id").alias("n2")).filter("n2 >= 't199990'")
    rest = spark.range(n, 2 * n).select(F.concat(F.lit("s"), (F.col("id") % 50).cast("string")).alias("n1"), F.format_string("t%06d", "id").alias("n2"))
    e = hub.unionByName(other).unionByName(rest)
    neg = evaluate.negatives(e, 1)
    count = {r.n1: (r.n, r.d) for r in neg.groupBy("n1").agg(F.count("*").alias("n"), F.count_distinct("n2").alias("d")).collect()}
    assert count["hub"] == (n, n) and count["other"] == (10, 10) and neg.join(e, ["n1", "n2"], "left_semi").count() == 0


def test_running_totals_over_ranges(spark):
    rng = np.random.default_rng(9)
    keys = rng.permutation(3000)
    df = spark.createDataFrame([(int(k), int(k) % 7) for k in keys], "k long, n long").repartition(6)
    got = {r.k: r.total for r in numbering.running_total(df, "k", "n", "total").collect()}
    want = np.cumsum([k % 7 for k in range(3000)])
    assert got == {k: int(want[k]) for k in range(3000)}
    assert numbering.running_total(df.limit(0), "k", "n", "total").count() == 0


def test_negatives_read_their_edges_once(spark, monkeypatch):
    from metaweave.operators import evaluate as V

    kept, save = [], V.saved
    monkeypatch.setattr(V, "saved", lambda df, name="t": (kept.append(name), save(df, name))[1])
    rows = [(f"a{i % 5}", f"b{(i * i) % 7}") for i in range(30)]
    out = V.negatives(spark.createDataFrame(rows, "n1 string, n2 string"), 3).collect()
    targets, own = {b for _, b in rows}, {(a, b) for a, b in rows}
    for a in {a for a, _ in rows}:
        got, has = [r.n2 for r in out if r.n1 == a], {b for x, b in own if x == a}
        assert len(got) == len(set(got)) == min(len(has), len(targets - has)) and not has & set(got)
    assert kept == ["edges"]
