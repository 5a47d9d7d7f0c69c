"""Links joined up in chunks before the rounds give the components of all links."""

import random

import pytest

from metaweave.operators import components as C


@pytest.mark.parametrize("kind, per_task", [("string", 5), ("long", 5), ("string", 10_000)])
def test_chunks_then_rounds(spark, monkeypatch, kind, per_task):
    rng = random.Random(8)
    # groups of near ids, and links across some of them
    rows = [(g * 20 + rng.randrange(20), g * 20 + rng.randrange(20)) for g in range(30) for _ in range(60)] + [(20 * k + 3, 20 * k + 203) for k in range(6)]
    rows += [(900, 900), (40, 40)]
    if kind == "string":
        rows = [(f"n{a}", f"n{b}") for a, b in rows]
    monkeypatch.setattr(C, "PER_TASK", per_task)
    monkeypatch.setattr(C, "CHUNK", 400)
    made = []
    keep = C.saved
    monkeypatch.setattr(C, "saved", lambda d, name="t", *x: made.append((name, (out := keep(d, name, *x)).count())) or out)
    parent = {x: x for r in rows for x in r}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in C.components(spark.createDataFrame(rows, f"a {kind}, b {kind}")).collect()}
    assert got == {x: root(x) for x in parent}
    sizes = dict(made)
    if per_task == 5:
        assert sizes["joined"] < sizes["links"] / 2


def test_nothing_to_link(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert C.components(none).count() == 0
    assert [tuple(r) for r in C.components(spark.createDataFrame([("x", "x")], "a string, b string")).collect()] == [("x", "x")]
