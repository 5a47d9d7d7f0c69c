"""Components by the star steps and within one task."""

import numpy as np

from metaweave.llm import _graph
from metaweave.llm._work import Work


def union_find(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_both_ways_agree_with_union_find(spark, monkeypatch):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(300, 380)]
    star = [(1000, 1000 + i) for i in range(1, 120)]
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 250, (160, 2))]
    links = chain + star + pairs + pairs[:9] + [(5, 5), (None, 3), (7, None), (999, 999)]
    df = spark.createDataFrame(links, "x long, y long").repartition(5)
    want = union_find(links)
    for most in (_graph.PER_TASK, 0):
        monkeypatch.setattr(_graph, "PER_TASK", most)
        got = _graph.components(Work(spark, "graph"), df, "x", "y").collect()
        assert len(got) == len(want) and {r.node: r.component for r in got} == want
        assert _graph.components(Work(spark, "graph"), df.limit(0), "x", "y").count() == 0
