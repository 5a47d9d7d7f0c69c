import hashlib
import os

from metaweave.llm import warc
from metaweave.llm._work import Work

ROWS = [(i, f"http://x/{i}?q=é ü", "p" * 1200 if i % 5 == 0 else "é" * 700 if i % 5 == 1 else "<html>" + str(i) * i, "k", 0) for i in range(90)]
ROWS += [(200, None, None, None, None), (201, "u", "", "", 1), (202, "u", "s" * 999, "", 1), (203, "u", "s" * 999, "", 1), (85, ROWS[85][1], ROWS[85][2], "k", 0), (None, "u", "p" * 1200, "", 0), (204, "u", "q" * 40_000, "", 0)]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, n int")


def brute(rows):
    by = {}
    for p, _, h, *_ in rows:
        if len((h or "").encode()) >= 1000 and p is not None:
            by[h] = max(p, by.get(h, p))
    count, out, used = {}, [], set()
    for _, _, h, *_ in rows:
        count[h] = count.get(h, 0) + 1
    for p, _, h, *_ in rows:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and count[h] > 1 and h in by and (p != by[h] or h in used)
        if len(b) >= 1000 and h in by and p == by[h]:
            used.add(h)
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", by[h] if revisit else None))
    return sorted(map(str, out))


def test_round_trip(spark):
    got = warc.round_trip(table(spark), shards=4, roll_bytes=2000).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(ROWS)


def test_files_are_the_same_however_the_rows_come(spark):
    made = []
    for parts in (1, 5):
        work = Work(spark, "t")
        path = work.mkdir("a")
        m = warc.write(*warc.marked(work, table(spark).repartition(parts)), path, 3, 3000).collect()
        made.append([tuple(r) for r in m])
        files = os.listdir(path.removeprefix("file://"))
        assert not [f for f in files if f.startswith("_writing") and not f.endswith("crc")]
        assert "manifest" in files and "_manifest" not in files
        assert [tuple(r) for r in warc.manifest(spark, path).orderBy("file").collect()] == made[-1]
        assert sum(r.records for r in m) == len(ROWS)
        back = {(r.page_id, r.payload) for r in warc.read(spark, path).filter("record_type = 'response'").collect()}
        assert (200, b"") in back and (204, b"q" * 40_000) in back
    assert made[0] == made[1] and len(made[0]) > 4


def test_empty(spark):
    assert warc.round_trip(table(spark, [])).count() == 0


def test_sql_twin(spark):
    import duckdb

    from metaweave.llm.queries import ORACLE_SQL, QUERIES

    d = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view pages as select * from '{d}/pages.parquet'")
    want = sorted(map(str, duckdb.sql(ORACLE_SQL["op7_warc"]).fetchall()))
    assert sorted(str(tuple(r)) for r in QUERIES["op7_warc"](spark, d).collect()) == want
