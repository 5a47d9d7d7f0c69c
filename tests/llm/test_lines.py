import hashlib
import random

from metaweave.llm import lines
from metaweave.llm.queries import ORACLE_SQL


def within_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(rows, least):
    seen, out = [], {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        kept, n = [], 0
        for line in (text or "").split("\n") if text is not None else []:
            s = line.strip(" \t\r")
            if s:
                gone = s in seen or len(s) >= least and any(within_one(s, t) for t in seen if len(t) >= least)
                seen.append(s)
                if gone:
                    n += 1
                    continue
            kept.append(line)
        out[doc] = (len(text.split("\n")) if text is not None else 0, n, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé ñ") for _ in range(rng.randint(18, 40))).strip() or "x" for _ in range(25)]

    def edit(s):
        k, i = rng.random(), rng.randrange(len(s))
        return s if k < 0.3 else s[:i] + s[i + 1 :] if k < 0.5 else s[:i] + "z" + s[i:] if k < 0.7 else s[:i] + "y" + s[i + 1 :] if k < 0.9 else s[:i] + "qq" + s[i:]

    rows = []
    for d in range(60):
        rows.append((d, "\n".join(rng.choice([" ", "", "\t"]) + edit(rng.choice(base)) for _ in range(rng.randint(1, 6)))))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, base[0]), (7, rows[7][1]), (103, "short\nshort\nshort"), (104, "a" * 30 + "\n" + "a" * 29 + "\n" + "a" * 28 + "\n" + "ab" * 15 + "\n" + "ba" * 15)]
    df = spark.createDataFrame([(*r, "k", 1, None) for r in rows], "doc_id long, text string, line string, pos int, x string").repartition(3)
    got = lines.digest(df).collect()
    want = brute(rows, 20)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_lines, r.n_removed, r.kept_sha256) == want[r.doc_id], r
    assert sum(r.n_near for r in got) > 5
    out = lines.without_repeats(df)
    assert out.columns == df.columns
    assert out.filter("doc_id = 100").first().text is None


def test_long_text_of_many_repeated_lines(spark):
    text = "\n".join(f"line number {i % 700} of the one text" if i % 3 else "x" for i in range(30_000))
    (got,) = lines.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    seen, kept = set(), []
    for s in text.split("\n"):
        if s not in seen and not any(within_one(s, t) for t in seen if len(s) >= 20 and len(t) >= 20):
            kept.append(s)
        seen.add(s)
    assert (got.n_lines, got.n_removed, got.kept_sha256) == (30_000, 30_000 - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_empty(spark):
    assert lines.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql_twin(spark):
    import duckdb

    from metaweave.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view documents as select * from '{d}/documents.parquet'")
    want = sorted(duckdb.sql(ORACLE_SQL["op10_line_dedup"]).fetchall())
    got = QUERIES["op10_line_dedup"](spark, d)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_lines", "n_removed", "kept_chars", "kept_sha256").collect()) == want
