import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from metaweave.llm import packing


def brute(texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [x.ids + [0] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, length string, ids int, sequence_id int").repartition(3)
    out = packing.pack(df, **more).collect()
    want = sorted(zip([r[0] if r[0] is not None else -1 for r in rows], brute([r[1] for r in rows]), strict=True))
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(ids.tobytes()) == r.ids_crc32
        docs[-1 if r.doc_id is None else r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
        seqs[r.sequence_id].append((r.offset, r.length))
    for doc in docs:
        mine = [ids for d, ids in want if d == doc]
        if len(mine) == 1:
            assert sum((p[1] for p in sorted(docs[doc])), []) == mine[0]
        assert sum(len(p[1]) for p in docs[doc]) == sum(map(len, mine))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == 1024 or at & (at - 1) == 0
    return out


def test_round_trip(spark):
    rows = [(i, "word " * (i * 37 % 1900) + str(i), "x", 1, 2) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "", 0, 0), (102, "a" * 9000, "", 0, 0), (103, "x <|endoftext|> y ñ😀", "", 0, 0), (5, rows[5][1], "x", 1, 2), (None, "no id", "", 0, 0)]
    check(spark, rows)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_equal_the_tokenizer_library(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    e = packing.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert [e.ids(t or "") + [0] for t in texts] == brute(texts)
