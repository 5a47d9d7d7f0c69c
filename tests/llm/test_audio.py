import io
import wave
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from metaweave.llm import audio as A


def tune(seed, notes=40):
    return A.played(np.random.default_rng(seed).normal(size=2 * notes), notes)


def test_wav_round_trip_and_bad_input():
    x = tune(1)
    assert np.abs(A.decode(A.encode(x)) - x).max() < 1e-4
    assert len(A.decode(None)) == len(A.decode(b"")) == len(A.decode(b"RIFFxx")) == 0
    assert len(A.codes(A.chroma(x[:100]))) == len(A.codes(np.zeros((3, 12)))) == 0


def test_rectangles_are_sums():
    e = A.chroma(tune(2))
    image = np.zeros((len(e) + 1, 13))
    image[1:, 1:] = e.cumsum(0).cumsum(1)
    t = np.arange(10)
    assert np.allclose(A.rectangle(image, t, 1, 5, 2, 9), [e[k + 1 : k + 5, 2:9].sum() for k in t])


def test_noise_and_delay_align():
    x = tune(3)
    late = np.concatenate([np.zeros(5 * A.HOP), x]) + 0.01 * np.random.default_rng(0).normal(size=len(x) + 5 * A.HOP)
    a, b = (A.codes(A.chroma(v)).view(np.int32) for v in (late, x))
    best = min(range(-20, 21), key=lambda k: A.bit_errors(a, b, k)[0] if A.bit_errors(a, b, k)[1] > 30 else 1)
    assert best == 5 and A.bit_errors(a, b, 5)[0] < 0.1
    assert A.bit_errors(a, A.codes(A.chroma(tune(9))).view(np.int32), 0)[0] > 0.2


def brute(prints, every, votes, errors):
    out = set()
    cls = {}
    for i, c in prints.items():
        if len(c):
            cls.setdefault(tuple(c), []).append(i)
    first = lambda c: {v: k for k, v in reversed(list(enumerate(zip(c, c[A.APART :], strict=False))))}
    for q, c in prints.items():
        if q % every or not len(c):
            continue
        fq = first(c)
        for d, ids in cls.items():
            n = Counter(fq[v] - k for v, k in first(d).items() if v in fq)
            n = {k: x for k, x in n.items() if x >= votes}
            if n:
                s = max(n, key=lambda k: (n[k], -abs(k), -k))
                e, frames = A.bit_errors(np.array(c, dtype=np.int32), np.array(d, dtype=np.int32), s)
                if e <= errors:
                    out.add((q, min(ids), len(ids), s, n[s], frames, round(e, 9)))
    return out


def test_against_brute_force(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(60):
        x = tune(int(rng.integers(12)))
        cut = int(rng.integers(0, 8)) * A.HOP
        rows.append((i, A.encode(x[cut:] + 0.005 * rng.normal(size=len(x) - cut) * (i % 3)), "k"))
    rows += [(60, None, "k"), (62, b"", "k"), (64, b"junk", "k"), (65, rows[5][1], "k"), (None, rows[5][1], "k")]
    df = spark.createDataFrame(rows, "id long, recording binary, codes string").repartition(3)
    al = A.Alignments(df, "id", "recording", every=5)
    got = {(r.query_id, r.class_id, r.members, r["shift"], r.votes, r.frames, round(r.bit_error_rate, 9)) for r in al.matches().collect()}
    prints = {r[0]: A.codes(A.chroma(A.decode(r[1]))).view(np.int32).tolist() for r in rows if r[0] is not None}
    want = {(q, c, m + (1 if prints[c] == prints[5] else 0), *x) for q, c, m, *x in brute(prints, 5, 6, 0.15)}
    assert got == want and len(got) > 20
    assert A.Alignments(df.limit(0), "id", "recording").matches().count() == 0


def matched(spark, prints, every=1):
    """(query, class) to (shift, frames, differing bits) by Alignments over given codes."""
    al = A.Alignments.__new__(A.Alignments)
    al.work, al.every = A.Work(spark, "audio"), every
    df = spark.createDataFrame([(i, c.tolist()) for i, c in prints.items()], "id long, codes array<int>").withColumns({"h": F.xxhash64("codes"), "h2": F.hash("codes")})
    al.classes = al.work.save(df.groupBy("h", "h2").agg(F.min("id").alias("class_id"), F.count("*").alias("members"), F.any_value("codes").alias("codes")))
    al.ids = df.select("id", "h", "h2")
    return {(r.query_id, r.class_id): (r["shift"], r.frames, round(32 * r.frames * r.bit_error_rate)) for r in al.matches().collect()}


def alignments(spark, prints, every=1):
    al = A.Alignments.__new__(A.Alignments)
    al.work, al.every = A.Work(spark, "audio"), every
    df = spark.createDataFrame([(i, c.tolist()) for i, c in prints.items()], "id long, codes array<int>").withColumns({"h": F.xxhash64("codes"), "h2": F.hash("codes")})
    al.classes = al.work.save(df.groupBy("h", "h2").agg(F.min("id").alias("class_id"), F.count("*").alias("members"), F.any_value("codes").alias("codes")))
    al.ids = df.select("id", "h", "h2")
    return al


def totals(spark, prints):
    """id to (queries that match, best query, shift, frames, differing bits)."""
    return {r.id: (r.n_queries, r.query_id, r["shift"], r.frames, round(32 * r.frames * r.bit_error_rate)) for r in alignments(spark, prints).rows().collect()}


def counted(pairs, prints, errors=0.15):
    first = {}
    for i, c in sorted(prints.items()):
        first.setdefault(c.tobytes(), i)
    out = {}
    for i, c in prints.items():
        own = [(round(w - errors * 32 * n, 6), abs(k), k, q, n, w) for (q, d), (k, n, w) in pairs.items() if d == first[c.tobytes()]]
        if own:
            _, _, k, q, n, w = min(own)
            out[i] = len(own), q, k, n, w
    return out


def test_wav_of_other_rates_and_widths_align():
    x = tune(3)
    want = A.codes(A.chroma(A.decode(A.encode(x)))).view(np.int32)
    for rate, width, channels in ((22050, 2, 2), (8000, 1, 1), (44100, 3, 1), (5512, 4, 1)):
        n = round(len(x) * rate / A.RATE)
        y = np.interp(np.arange(n) * A.RATE / rate, np.arange(len(x)), x)
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(width)
            w.setframerate(rate)
            whole = np.round(y * (256**width // 2 - 1)).astype(np.int64) + (128 if width == 1 else 0)
            raw = np.repeat(whole, channels).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]
            w.writeframes(raw.tobytes())
        got = A.codes(A.chroma(A.decode(out.getvalue()))).view(np.int32)
        assert abs(len(got) - len(want)) <= 1 and A.bit_errors(got, want, 0)[0] < 0.1, (rate, width)


def every_offset(prints, least=10, errors=0.15):
    out, first = {}, {}
    for i, c in prints.items():
        first.setdefault(c.tobytes(), i)
    for q, a in prints.items():
        for c, d in first.items():
            b = np.frombuffer(c, dtype=np.int32)
            got = [(round(e * 32 * n - errors * 32 * n, 6), abs(k), k, n, round(e * 32 * n)) for k in range(-len(b), len(a)) for e, n in [A.bit_errors(a, b, k)] if n >= least and e <= errors]
            if a.tobytes() == c:
                out[q, d] = (0, len(a), 0)
            elif got:
                out[q, d] = min(got)[2:]
    return out


def test_matches_are_the_pairs_within_the_bound_at_any_offset(spark):
    rng = np.random.default_rng(8)
    prints = {}
    for i in range(8):
        a = A.codes(A.chroma(tune(i))).view(np.uint32)
        for j, share in enumerate((0.0, 0.05, 0.1, 0.14)):
            flip = (rng.random((len(a), 32)) < share) @ (np.uint32(1) << np.arange(32, dtype=np.uint32))
            prints[10 * i + j] = (a ^ flip.astype(np.uint32))[j * i :].view(np.int32)
    got, want = matched(spark, prints), every_offset(prints)
    assert totals(spark, prints) == counted(want, prints)
    assert got == want and all((10 * i, 10 * i + 1) in got and (10 * i, 10 * i + 2) in got for i in range(8))


def test_steady_silent_and_short_recordings_match_their_copies(spark):
    hum = np.sin(np.arange(40 * A.HOP) * 0.3)
    prints = {k: A.codes(A.chroma(x)).view(np.int32) for k, x in enumerate((hum, hum, np.zeros(40 * A.HOP), np.zeros(40 * A.HOP), np.zeros(60 * A.HOP)))}
    prints |= {5: A.codes(A.chroma(tune(1)))[:3].view(np.int32), 6: A.codes(A.chroma(tune(1)))[:3].view(np.int32)}
    got = matched(spark, prints)
    assert got == every_offset(prints)
    assert {(0, 0), (1, 0), (2, 2), (3, 2), (3, 4), (4, 2), (5, 5), (6, 5)} <= got.keys()
