import hashlib
import random
import tempfile
from collections import Counter

from metaweave.llm import column_bwt, repeats


def test_column_bwt_against_sorting():
    rng = random.Random(1)
    for trial in range(120):
        s = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 12))]
        with tempfile.TemporaryDirectory() as d:
            bwt, lcp, start = column_bwt.build(s, d if trial % 5 == 0 else None)
        text = b"\xff".join([*s, b""])
        got = [text[x : text.index(b"\xff", x)] for x in start]
        assert got == [x for x, _ in sorted((w[i:], j) for j, w in enumerate(s) for i in range(len(w) + 1))]
        assert list(lcp) == [0] + [next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b))) for a, b in zip(got, got[1:], strict=False)]
        assert all(c == (0 if x == 0 or text[x - 1] == 255 else text[x - 1] + 1) for c, x in zip(bwt, start, strict=True))
        n = Counter(w[i : i + 5] for w in s for i in range(len(w) - 4))
        assert [list(r) for r in column_bwt.repeated(s, 5)] == [[i for i in range(len(w) - 4) if n[w[i : i + 5]] > 1] for w in s]


def brute(texts, length):
    b = [(t or "").encode() for t in texts]
    n = Counter(x[i : i + length] for x in b for i in range(len(x) - length + 1))
    out = []
    for x in b:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if n[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(x)) if gone[i] and (i == 0 or not gone[i - 1]))
        rest = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        out.append((len(x), sum(gone), spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace")))
    return out


def corpus(seed):
    rng = random.Random(seed)
    passage = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(20, 120))) for _ in range(8)]
    texts = []
    for _ in range(50):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passage)
            a = rng.randrange(len(p))
            parts.append(rng.choice([p, p[a:], p[:a], "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60)))]))
        texts.append("".join(parts))
    return [*texts, None, "", "aaaa" * 40, "ab" * 70, texts[0], "short"]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "RUN", 37)
    texts = corpus(3)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, context string, n int").repartition(3)
    want = brute(texts, 24)
    for more in ({}, {"most_group": 2}, {"batch": 3}, {"file_bytes": 0}):
        got = {r.doc_id: tuple(r)[1:] for r in repeats.Repeats(df, length=24, gram=9, **more).digest().collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 500


def test_check_tells_apart_what_powers_of_two_cannot():
    import numpy as np

    word = np.array([bin(i).count("1") % 2 for i in range(4096)], dtype=np.uint8)  # this kind of word and its complement collide under any odd base
    both = [np.where(w > 0, ord("a"), ord("b")).astype(np.uint8) for w in (word, 1 - word)]
    ends = [np.array([0]), np.array([len(word)])]
    plain = [int(repeats.span_hash(repeats.prefix_hash(b, repeats.TABLE), *ends)[0]) for b in both]
    check = [int(repeats.CHECK.spans(repeats.CHECK.prefix(b), *ends)[0]) for b in both]
    assert plain[0] == plain[1] and check[0] != check[1]
    raw = np.frombuffer(b"xyzzyabcxyzzy", dtype=np.uint8)
    c = repeats.CHECK.prefix(raw)
    a, b, d = repeats.CHECK.spans(c, np.array([0, 8, 1]), np.array([5, 13, 6]))
    assert a == b != d


def test_repeated_rows_and_empty(spark):
    t = "0123456789" * 3
    df = spark.createDataFrame([(1, t), (1, t), (None, "q" + t[:15]), (2, None)], "doc_id long, text string")
    got = sorted(map(str, (tuple(r)[:4] for r in repeats.Repeats(df, length=10, gram=4).digest().collect())))
    assert got == sorted(map(str, [(1, 30, 30, 1), (1, 30, 30, 1), (None, 16, 15, 1), (2, 0, 0, 0)]))
    assert repeats.Repeats(df.limit(0)).digest().count() == 0
