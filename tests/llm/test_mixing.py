import math
import re
from collections import Counter, defaultdict

import numpy as np

from metaweave.llm import mixing


def test_targets():
    assert mixing.targets([10, 10, 10], (5, 2, 1), 3) == [30 * 5 / 8, 30 * 2 / 8, 30 / 8]
    assert mixing.targets([1, 100, 100], (5, 2, 1), 3) == [3.0, 132.0, 66.0]
    assert mixing.targets([0, 5], (5, 2), 3) == [0.0, 5.0]


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 17, 1000):
        p = mixing.Permutation(n, n * 7)
        x = p(np.arange(n))
        assert sorted(x) == list(range(n)) and (p(x, back=True) == np.arange(n)).all()


def test_tree_sums_to_totals():
    t = mixing.Tree([1000, 30, 0, 777], 64, 3)
    all_ = [t.shard(k) for k in range(t.shards)]
    assert sum(c for c, _ in all_).tolist() == [1000, 30, 0, 777]
    assert all(c.sum() == 64 for c, _ in all_[:-1])
    run = np.zeros(4, dtype=int)
    for c, b in all_:
        assert (b == run).all()
        run += c


def test_draws_follow_the_distribution():
    rng = np.random.default_rng(5)
    for good, bad, n in ((5, 7, 4), (1, 9, 5), (40, 3, 20), (300, 500, 200)):
        times, got = 4000, Counter()
        for _ in range(times):
            got[mixing.hypergeometric(rng, good, bad, n)] += 1
        want = {k: times * math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)}
        assert set(got) <= set(want)
        some = {k: w for k, w in want.items() if w >= 5}
        assert sum((got[k] - w) ** 2 / w for k, w in some.items()) < len(some) + 6 * math.sqrt(2 * len(some))


def test_draws_beyond_a_thousand_million():
    rng, good, bad, n = np.random.default_rng(6), 3 * 10**12, 5 * 10**12, 4 * 10**12
    sd = math.sqrt(n * (3 / 8) * (5 / 8) * ((good + bad - n) / (good + bad - 1)))
    z = (np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(3000)]) - n * 3 / 8) / sd
    assert abs(z.mean()) < 0.1 and abs(z.std() - 1) < 0.06 and abs((np.abs(z) < 1).mean() - 0.6827) < 0.04


def test_draws_without_choice():
    rng = np.random.default_rng(7)
    assert [mixing.hypergeometric(rng, *x) for x in ((0, 0, 0), (5, 0, 3), (0, 5, 3), (5, 7, 0), (5, 7, 12))] == [0, 3, 0, 0, 5]


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, size int, target int")


def test_taken(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), rng.choice(["a", "b", "é", "z"]), 0, 1, 1) for i in range(400)]
    rows += [(900, None, "a", 0, 0, 0), (901, "one", None, 0, 0, 0), (None, "x y", "b", 0, 0, 0), (3, rows[3][1], rows[3][2], 0, 1, 1), (905, "t " * 20000, "z", 0, 0, 0)]
    got = mixing.Mix(make(spark, rows)).taken().collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((r[0] is None, r[0] or 0, len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows)
    by = defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size
        by[r.source_size, r.target] += r.taken
    for (_, target), n in by.items():
        assert n == round(target)
    again = mixing.Mix(make(spark, rows).repartition(5)).taken().collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_taken_against_brute_force(spark):
    """Every word of every slot counted one by one."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 200))), rng.choice(["a", "a", "a", "b", "z"]), 0, 1, 1) for i in range(300)]
    rows += [(901, "one", None, 0, 0, 0), (902, None, "a", 0, 0, 0), rows[3]]
    mix = mixing.Mix(make(spark, rows), block=16, shard_slots=100)
    sizes, slots = mix.sizes.collect(), mix.slots().collect()
    owner = defaultdict(list)  # a source's words in their order, each as its row
    for r in sorted(sizes, key=lambda r: (r.source_index, r.start, r.size)):
        assert len(owner[r.source_index]) == r.start
        owner[r.source_index] += [(r.source_index, r.chunk, r.n)] * r.size
    shards = defaultdict(list)
    for s in slots:
        shards[s.shard].append(s.slot)
    assert all(sorted(x) == list(range(100 if k < max(shards) else len(x))) for k, x in shards.items())
    used = Counter((s.source_index, s.turn, s.block) for s in slots)
    assert set(used.values()) == {1}
    last = {i: max(s.turn for s in slots if s.source_index == i) for i in {s.source_index for s in slots}}
    assert all(sum(s.source_index == i and s.turn == t for s in slots) == -(-len(owner[i]) // 16) for i, m in last.items() for t in range(m))
    took = Counter(w for s in slots for w in owner[s.source_index][s.block * 16 : s.block * 16 + s.words])
    want = sorted((r.doc_id, r.size, r.source_size, r.target, took[r.source_index, r.chunk, r.n]) for r in sizes)
    assert sorted(tuple(r) for r in mix.taken().collect()) == want and sum(took.values()) == sum(round(t) for t in mix.targets)


def test_texts_hold_the_taken_words(spark):
    rows = [(i, f"  a{i} b\nc " + "d " * (i % 90), "s" + str(i % 3), 9, 1, 1) for i in range(200)]
    mix = mixing.Mix(make(spark, rows), keep=True)
    taken = {r.doc_id: r.taken for r in mix.taken().collect()}
    got = defaultdict(int)
    for r in mix.texts().collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == {k: v for k, v in taken.items() if v}


def test_empty(spark):
    assert mixing.Mix(make(spark, [])).taken().count() == 0
    assert mixing.Mix(make(spark, [(1, None, None, 0, 0, 0)])).taken().first().taken == 0
