import random
from fractions import Fraction

import numpy as np

from metaweave.llm import ngram_join as J


def shingles(text, n):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def corpus(seed, docs=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([2, 3, 5, 8, 20, 60, 120, 300]))] for _ in range(30)]
    rows = []
    for d in range(docs):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            i = rng.randrange(len(w))
            w[i : i + rng.choice([0, 1])] = [rng.choice(words)]
        rows.append((d * 3 + 1, rng.choice([" ", "\n", "  "]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return rows


def test_signatures_meet_for_every_similar_pair(monkeypatch):
    t = Fraction(85, 100)
    sizes, rng = J.Sizes(t), np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        k = int(rng.integers(0, max(1, int(0.1 * n)) + 1))
        b = np.unique(np.concatenate([a[k:], rng.integers(0, 2**63, int(rng.integers(0, max(1, int(0.1 * n)) + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert set(J.signatures(a, len(a), sizes)) & set(J.signatures(b, len(b), sizes)), (len(a), len(b), both)
    monkeypatch.setattr(J, "SLACK", (0, 1))  # a single part or so: no set has enough of them, so empty parts count
    tight = J.Sizes(t)
    tight.parts = tight.differ + 1
    monkeypatch.setattr(J, "TURNS", 2)
    for n in range(8, 60):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        k = max(1, int(0.07 * n))
        b = np.unique(np.concatenate([a[k:], rng.integers(0, 2**63, k).astype(np.uint64)]))
        if 100 * (n - k) >= 85 * (n + k):
            assert set(J.signatures(a, n, tight)) & set(J.signatures(b, n, tight)), n


def test_unrelated_sets_rarely_meet():
    sizes, rng = J.Sizes(Fraction(4, 5)), np.random.default_rng(5)
    keys = [set(J.signatures(rng.integers(0, 2**63, 200).astype(np.uint64), 200, sizes).tolist()) for _ in range(300)]
    assert not any(a & b for i, a in enumerate(keys) for b in keys[:i])


def test_bound_never_undercuts_overlap():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 3000, 500).astype(np.uint64)) for _ in range(2))
        a, b = J.mix(a), J.mix(b)
        p, q = (np.frombuffer(J.point(x), dtype=np.uint8) for x in (a, b))
        groups = min(len(p), len(q))
        bound = np.minimum(*(x.reshape(-1, groups).sum(0) for x in (p, q))).sum()
        assert bound >= len(np.intersect1d(a, b)) == J.overlap(a, b)


def test_search_in_boxes_finds_all_that_the_bound_leaves():
    rng, t = np.random.default_rng(6), Fraction(85, 100)
    base = rng.integers(0, 4, (5, 64))
    points = np.maximum(base[rng.integers(0, 5, 200)] + rng.integers(-1, 2, (200, 64)) * (rng.random((200, 64)) < 0.1), 0).astype(np.uint8)
    n, comp = points.sum(1).astype(np.int64), rng.integers(0, 60, 200)
    none = (np.zeros(201, dtype=np.int32), np.zeros(0, dtype=np.int64))
    a = J.Tree(n, comp, np.arange(200), points, none)
    need = J.overlap_needed(n[:, None], n[None], t)
    want = {(i, j) for i, j in np.argwhere(np.minimum(points[:, None], points[None]).sum(2, dtype=int) >= need).tolist() if i < j and comp[i] != comp[j]}
    i, j, _ = J.search(a, a, t, True, most=1 << 14)
    assert {tuple(sorted(x)) for x in zip(a.set[i].tolist(), a.set[j].tolist())} == want and len(i) == len(want) > 100
    keep = J.forest(a.component[i], a.component[j], rng.integers(0, 9, len(i)))
    assert 0 < keep.sum() <= 59


def test_against_brute_force(spark):
    rows = corpus(1) + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "Solo"), (1004, "solo"), (1005, "a b c"), (1006, "a b c d")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, keys string").repartition(4)
    for n, t, num, den in ((4, "0.85", 85, 100), (5, "0.8", 4, 5)):
        got = sorted(tuple(r) for r in J.Join(df, n=n, t=t, box=8).classes().collect())
        assert got == sorted(brute(rows, n, num, den))


def test_tree_finds_what_stars_leave(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in J.Join(df, n=4, t="0.85", box=16, star_rounds=1).classes().collect())
    assert got == sorted(brute(rows, 4, 85, 100))


def test_pairs_verified_grow_with_the_members_of_a_group(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    asked = []
    verify = J.Join._verify

    def counted(self, pairs):
        pairs = self.work.save(pairs.distinct(), "counted")
        asked.append(pairs.count())
        return verify(self, pairs)

    monkeypatch.setattr(J.Join, "_verify", counted)
    rows = []
    for d in range(2000):
        w = list(base)
        for _ in range(rng.choice([1, 2])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    got = J.Join(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), n=4, t="0.85").classes().collect()
    assert sum(asked) < 5 * len(rows)
    assert sorted((r.doc_id, r.component_id) for r in got) == [(d, c) for d, _, c in sorted(brute(rows[:2000], 4, 85, 100))]


def test_sets_of_equal_first_names_stay_apart(spark):
    rows = corpus(4, 60)
    got = sorted(tuple(r) for r in J.Join(spark.createDataFrame(rows, "doc_id long, text string"), n=4, t="0.85", name_bits=4).classes().collect())
    assert got == sorted(brute(rows, 4, 85, 100))


def test_keep_one_with_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 4, 5, 6), (3, "x y", 7, 8, 9), (3, "x y", 7, 8, 9), (None, "a b c d e f", 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id int, twice_id int, count int")
    got = J.keep_one(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, df.filter("doc_id IS NULL").collect() + df.filter("doc_id = 1").collect() + df.filter("doc_id = 3").limit(1).collect()))


def test_repeats_and_nulls(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "x y")]
    got = sorted(map(str, J.Join(spark.createDataFrame(rows, "doc_id long, text string"), n=4, t="0.85").classes().collect()))
    assert got == sorted(["Row(doc_id=1, n_shingles=3, component_id=1)"] * 2 + ["Row(doc_id=2, n_shingles=3, component_id=1)", "Row(doc_id=3, n_shingles=1, component_id=3)", "Row(doc_id=None, n_shingles=3, component_id=None)"])
    assert J.Join(spark.createDataFrame([], "doc_id long, text string")).classes().count() == 0


def test_sql_twin(spark):
    import duckdb

    from metaweave.llm.queries import ORACLE_SQL, QUERIES

    d = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view documents as select * from '{d}/documents.parquet'")
    want = sorted(duckdb.sql(ORACLE_SQL["op1_ngram_join"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op1_ngram_join"](spark, d).collect()) == want


def test_keys_are_not_stored_and_keys_of_many_sets_are_kept(spark, monkeypatch):
    saved, save = [], J.Work.save
    monkeypatch.setattr(J.Work, "save", lambda self, df, name="t": (saved.append((name, df.columns)), save(self, df, name))[1])
    same = " ".join(f"c{i}" for i in range(60))
    rows = [(d, f"{same} x{d % 700} y{d % 350} z") for d in range(2_500)] + [(5_000, "a b"), (5_001, None)]
    got = {r.doc_id: r.component_id for r in J.Join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), n=4, t="0.85", box=64).classes().collect()}
    assert all(got[d] == 0 for d in range(2_500)) and got[5_000] == 5_000 and got[5_001] == 5_001
    assert not any("keys" in columns for _, columns in saved)
