import re
from itertools import combinations

import corpus_pipeline
from pyspark.sql import functions as F

from metaweave.llm import ngram_join


def near(a, b):
    """At most one edit apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return a == b
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def emptied(docs):
    """Documents whose every line stands, equal or with 20 characters and more nearly so, in an earlier place."""
    before, out = [], set()
    for i, text in sorted((i, t) for i, t in docs.items() if t is not None):
        lines = [s for s in (x.strip(" \t\r") for x in text.split("\n")) if s]
        fresh = False
        for s in lines:
            fresh |= not any(s == o or (min(len(s), len(o)) >= 20 and near(s, o)) for o in before)
            before.append(s)
        if lines and not fresh:
            out.add(i)
    return out


def leaders(docs):
    """The least id of every group of documents linked by five-word shingles at 0.8."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) for i, t in docs.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    root = {i: i for i in docs}
    for a, b in combinations(sorted(sets), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return set(root.values())


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_lines_and_join_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = corpus_pipeline.stage_quality(spark, spark.read.parquet(f"{d}/documents.parquet"), d).cache()
    good = texts(docs)
    joined = set(texts(corpus_pipeline.stage_ngram_join(spark, docs, d)))
    assert joined == leaders(good) and len(joined) < len(good)
    lined = corpus_pipeline.stage_lines(spark, docs, d).cache()
    left = texts(lined)
    assert set(good) - set(left) == emptied(good)
    assert set(texts(corpus_pipeline.stage_ngram_join(spark, lined, d))) == leaders(left)


def test_stages_one_after_another(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    first, before = docs.columns, docs.count()
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == first
        docs = docs.cache()
        counts.append(docs.count())
    assert before > counts[0] > counts[1] >= counts[2] > 0  # line dedup leaves no near copy here
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert packed.count() > 0
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}


def test_stages_with_nulls_repeats_and_clashing_names(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    one = docs.filter("text IS NOT NULL").orderBy("doc_id").limit(1)
    odd = docs.limit(0).unionByName(spark.createDataFrame([tuple(None for _ in docs.columns)] * 2, docs.schema))
    for column in docs.columns:
        odd = odd.unionByName(one.withColumn(column, F.lit(None).cast(docs.schema[column].dataType)))
    odd = odd.unionByName(one).unionByName(one).unionByName(one.withColumn("text", F.lit("")))
    for c in ("score", "row", "size", "chunk", "gone_id", "runs", "block"):
        docs, odd = docs.withColumn(c, F.lit(f"kept {c}")), odd.withColumn(c, F.lit(f"kept {c}"))
    docs = docs.unionByName(odd)
    first = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == first
        docs = docs.cache()
        assert docs.filter("score <> 'kept score' OR gone_id <> 'kept gone_id' OR size <> 'kept size'").count() == 0 < docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() > 0


def test_stages_without_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == 0


def test_keep_one(spark):
    rows = [(5, "a b c d e f g", "x"), (3, "a b c d e f g", "y"), (9, "p q r s t u", "z"), (9, "p q r s t u", "z"), (None, "a b c d e f g", "n"), (8, None, "k"), (7, "", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(map(str, (tuple(r) for r in ngram_join.keep_one(df).collect())))
    assert got == sorted(map(str, [(3, "a b c d e f g", "y"), (9, "p q r s t u", "z"), (None, "a b c d e f g", "n"), (8, None, "k"), (7, "", "k")]))
