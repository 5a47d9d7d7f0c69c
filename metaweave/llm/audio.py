"""Chroma audio fingerprints as columns.

Samples become frames of twelve pitch-class energies; filters, differences of rectangle sums read off the frames'
integral image, are quantised to two bits each, and sixteen of them pack into an integer for every frame. A
recording matches a query where, laid over it at some offset, the share of differing bits is within the bound. Every
offset is compared: codes as signs turn the histogram of agreeing bits by offset into matrix products of a block of
queries with a block of recordings, so no key has to survive the noise. The cost grows with queries times recordings; queries go
in rounds of bounded size. Recordings with equal fingerprints are one class, so a group of copies is compared once, and a
class always matches its own copies.

Defined cases: a null, empty or undecodable recording, or one shorter than the widest filter, has no fingerprint and
matches nothing; recordings overlap in at least votes + APART frames, shorter ones match equal fingerprints alone;
repeated rows are members of one class; null ids are carried as members but never are queries; of several offsets within
the bound the one with the most bits to spare counts, ties go to the smaller shift, then the lesser; other columns pass by.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._work import Work

RATE, FRAME, HOP = 5512, 1024, 256
#: Lowest and highest frequency whose energy counts.
BAND = (60.0, 2500.0)
#: Filters by rule: kind, lowest pitch class, pitch classes high, frames wide.
FILTERS = [(k % 5, (5 * k) % (13 - h), h, w) for k, (h, w) in enumerate((h, w) for w in (2, 4, 6, 8) for h in (2, 4, 6, 12))]
#: Bounds of the quantiser in log ratio.
BOUNDS = (-0.15, 0.0, 0.15)
#: Neighbouring quantiser levels differ in one bit.
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
#: Frames between the two integers of a vote.
APART = 4
WIDEST = max(f[3] for f in FILTERS)
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def decode(data: bytes | None) -> np.ndarray:
    """Mono samples at RATE of PCM WAV bytes of 8 to 32 bits at any rate; none if they can't be read."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            width, rate, channels = w.getsampwidth(), w.getframerate(), w.getnchannels()
            raw = np.frombuffer(w.readframes(w.getnframes()), dtype=np.uint8)
    except (wave.Error, EOFError):
        return np.zeros(0)
    raw = raw[: len(raw) // (width * channels) * width * channels].reshape(-1, channels, width)
    if width == 1:  # unsigned
        x = raw[..., 0].astype(np.float64) / 128 - 1
    else:
        x = np.zeros(raw.shape[:2])
        for k in range(width):
            x += (raw[..., k].view(np.int8) if k == width - 1 else raw[..., k]).astype(np.float64) * 256.0**k
        x /= 256.0**width / 2
    return resampled(x.mean(1), rate)


def resampled(x: np.ndarray, rate: int) -> np.ndarray:
    """The samples at RATE, frequencies beyond either rate cut off by way of the spectrum of overlapping stretches."""
    if rate == RATE or not len(x):
        return x
    if rate <= 0:
        return np.zeros(0)
    stretch = 1 << 16  # samples of the input at a time, half of them overlapping
    if len(x) <= stretch:
        return _respaced(x, rate)
    out = np.zeros(int(round(len(x) * RATE / rate)) + stretch)
    weight = np.zeros(len(out))
    for a in range(0, len(x), stretch // 2):
        part = x[a : a + stretch]
        y = _respaced(part, rate)
        at, w = int(round(a * RATE / rate)), np.hanning(len(y) + 2)[1:-1] + 1e-6
        out[at : at + len(y)] += y * w
        weight[at : at + len(y)] += w
    n = int(round(len(x) * RATE / rate))
    return out[:n] / np.maximum(weight[:n], 1e-12)


def _respaced(x: np.ndarray, rate: int) -> np.ndarray:
    n = max(1, int(round(len(x) * RATE / rate)))
    spectrum = np.fft.rfft(x)
    keep = min(len(spectrum), n // 2 + 1)
    new = np.zeros(n // 2 + 1, dtype=complex)
    new[:keep] = spectrum[:keep]
    return np.fft.irfft(new, n) * (n / len(x))


def encode(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def _classes() -> np.ndarray:
    """Weight of each spectrum bin on each pitch class."""
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(hz), 12))
    used = np.flatnonzero((hz >= BAND[0]) & (hz <= BAND[1]))
    out[used, np.round(12 * np.log2(hz[used] / 440)).astype(int) % 12] = 1
    return out


CLASSES = _classes()
SHAPE = np.hanning(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Energies by pitch class of each frame, scaled to unit length."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * SHAPE
    e = (np.abs(np.fft.rfft(frames, axis=1)) ** 2) @ CLASSES
    return e / np.maximum(np.sqrt((e * e).sum(1)), 1e-9)[:, None]


def rectangle(image: np.ndarray, t: np.ndarray, w0: int, w1: int, y0: int, y1: int) -> np.ndarray:
    """Sums over frames t + w0 .. t + w1 and pitch classes y0 .. y1 by four corners of the integral image."""
    return image[t + w1, y1] - image[t + w0, y1] - image[t + w1, y0] + image[t + w0, y0]


def codes(e: np.ndarray) -> np.ndarray:
    """A packed integer for every frame that the widest filter fits behind."""
    n = len(e) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    image = np.zeros((len(e) + 1, 13))
    image[1:, 1:] = e.cumsum(0).cumsum(1)
    t, out = np.arange(n), np.zeros(n, dtype=np.uint32)
    for kind, y, h, w in FILTERS:
        r = lambda a, b, c, d: rectangle(image, t, a, b, y + c, y + d)  # noqa: B023, E731
        whole, half, high = r(0, w, 0, h), w // 2, h // 2
        part = {0: lambda: r(0, half, 0, h), 1: lambda: r(0, w, 0, high), 2: lambda: r(0, half, 0, high) + r(half, w, high, h), 3: lambda: r(w // 4, w - w // 4, 0, h) if w >= 4 else r(0, half, 0, h), 4: lambda: r(0, w, h // 4, h - h // 4) if h >= 4 else r(0, w, 0, high)}[kind]()
        level = np.searchsorted(BOUNDS, np.log((1 + part) / (1 + whole - part)))
        out = (out << np.uint32(2)) | GRAY[level]
    return out


def fingerprint(recording: Column) -> Column:
    """array<int>: the codes of a WAV column."""

    @arrow_udf("array<int>")
    def of(x: pa.Array) -> pa.Array:
        return pa.array([codes(chroma(decode(v.as_py()))).view(np.int32) for v in x], pa.list_(pa.int32()))

    return of(recording)


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """(share of differing bits, frames) where b starts offset frames into a."""
    lo, hi = max(0, offset), min(len(a), offset + len(b))
    if hi <= lo:
        return 1.0, 0
    x = (a[lo:hi] ^ b[lo - offset : hi - offset]).view(np.uint8)
    return float(POPCOUNT[x].sum()) / (32 * (hi - lo)), hi - lo


def signs(x: np.ndarray) -> np.ndarray:
    """Rows of codes as rows of -1 and 1, 32 for a code."""
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1).astype(np.float32) * 2 - 1


def within(a: np.ndarray, b: np.ndarray, least: int, errors: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(offset, frames, rows of a, rows of b, differing bits) of each offset that lays rows of signs within the bound over least frames or more."""
    x, y = a.shape[1] // 32, b.shape[1] // 32
    for k in range(least - y, x - least + 1):
        lo, hi = max(0, k), min(x, k + y)
        n = 32 * (hi - lo)
        if n < 32 * least:
            continue
        same = a[:, 32 * lo : 32 * hi] @ b[:, 32 * (lo - k) : 32 * (hi - k)].T
        i, j = np.nonzero(same >= n - 2 * np.floor(errors * n) - 2)
        wrong = ((n - same[i, j]) / 2).astype(np.int64)
        ok = wrong / n <= errors
        yield k, hi - lo, i[ok], j[ok], wrong[ok]


def agreeing(a: np.ndarray, b: np.ndarray, offset: int) -> int:
    """Places where both integers of a vote are equal, where b starts offset frames into a."""
    lo, hi = max(0, offset), min(len(a), offset + len(b))
    same = a[lo:hi] == b[lo - offset : hi - offset]
    return int((same[:-APART] & same[APART:]).sum())


def by_length(codes_: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, rows of codes) of each length."""
    size = np.array([len(c) for c in codes_])
    return [(at := np.flatnonzero(size == n), np.stack([codes_[i] for i in at])) for n in np.unique(size)]


def aligned(queries: list[np.ndarray], others: list[np.ndarray], least: int, errors: float, block: int = 1 << 22) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(query, other) to (shift, frames, differing bits) at its best offset, for all pairs with one within the bound."""
    best: dict[tuple[int, int], tuple] = {}
    for at, some in by_length(queries):
        for to, rest in by_length(others):
            if min(some.shape[1], rest.shape[1]) < least:
                continue
            rows, cols = (max(1, block // (32 * x.shape[1])) for x in (some, rest))
            for i0 in range(0, len(some), rows):
                a = signs(some[i0 : i0 + rows])
                for j0 in range(0, len(rest), min(cols, max(1, block // len(a)))):
                    b = signs(rest[j0 : j0 + min(cols, max(1, block // len(a)))])
                    for k, frames, i, j, wrong in within(a, b, least, errors):
                        for q, r, w in zip(at[i0 + i].tolist(), to[j0 + j].tolist(), wrong.tolist(), strict=True):
                            found = (round(w - errors * 32 * frames, 6), abs(k), k, frames, w)
                            if (q, r) not in best or found < best[q, r]:
                                best[q, r] = found
    return {p: (k, frames, w) for p, (_, _, k, frames, w) in best.items()}


class Alignments:
    """Queries against all recordings. prints: id, class_id (least id with equal codes), members; matches(); rows()."""

    def __init__(self, df: DataFrame, rec_id: str, recording: str, every: int = 50):
        self.work, self.every = Work(df.sparkSession, "audio"), every
        made = self.work.save(df.select(F.col(rec_id).cast("long").alias("id"), fingerprint(F.col(recording)).alias("codes")), "codes")
        made = made.filter(F.size("codes") > 0).withColumns({"h": F.xxhash64("codes"), "h2": F.hash("codes")})
        self.classes = self.work.save(made.groupBy("h", "h2").agg(F.min("id").alias("class_id"), F.count("*").alias("members"), F.any_value("codes").alias("codes")), "classes")
        self.ids = made.select("id", "h", "h2")

    def prints(self) -> DataFrame:
        return self.ids.join(self.classes.drop("codes"), ["h", "h2"]).select("id", "class_id", "members")

    def matches(self, votes: int = 6, errors: float = 0.15) -> DataFrame:
        """query_id, class_id, members, shift (frames by which the match starts later), votes, frames, bit_error_rate."""
        kind = "q long, class_id long, members long, shift long, votes long, frames long, bit_error_rate double"
        asked, held = self._checked(kind, votes, errors, _matches)
        return asked.select("query_id", F.col("h").alias("q")).join(held, "q").drop("q")

    def rows(self, votes: int = 6, errors: float = 0.15) -> DataFrame:
        """One row per recording with a fingerprint: id, class_id, members, n_queries (queries that match it, itself included) and of these the one with the most bits to spare: query_id, shift, votes, frames, bit_error_rate.

        Matches are counted in the task that finds them, so no table of them is ever made, however many copies a query has.
        """
        best = "spare double, off long, shift long, query_id long, votes long, frames long, bit_error_rate double"
        _, held = self._checked(f"h long, h2 int, n long, {best}", votes, errors, _totals)
        names = [c.split()[0] for c in best.split(", ")]
        totals = held.groupBy("h", "h2").agg(F.sum("n").alias("n"), F.min(F.struct(*names)).alias("best"))
        out = self.ids.join(self.classes.drop("codes"), ["h", "h2"]).join(totals, ["h", "h2"], "left")
        return out.select("id", "class_id", "members", F.coalesce("n", F.lit(0)).cast("long").alias("n_queries"), *[F.col(f"best.{c}").alias(c) for c in ("query_id", "shift", "votes", "frames", "bit_error_rate")])

    def _checked(self, kind: str, votes: int, errors: float, told) -> tuple[DataFrame, DataFrame]:
        """The queries (query_id, h, h2), and what told gives of every batch of classes and the queries that match them."""
        asked = self.ids.filter(F.pmod("id", F.lit(self.every)) == 0).select(F.col("id").alias("query_id"), "h", "h2")
        one = asked.groupBy("h", "h2").agg(F.min("query_id").alias("query_id"), F.count("*").alias("n"))
        q = self.work.save(one.join(self.classes.select("h", "h2", "codes"), ["h", "h2"]).select("h", "query_id", "n", "codes"), "queries")
        classes, spark = self.classes.select("h", "h2", "class_id", "members", "codes"), q.sparkSession
        parts = [self.work.save(classes.mapInArrow(_checker(spark.sparkContext.broadcast(some), votes + APART, errors, told), kind), "matches") for some in self._rounds(q)]
        return asked, reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], kind)

    @staticmethod
    def _rounds(q: DataFrame, most: int = 1 << 17) -> Iterator[list[tuple[int, int, int, np.ndarray]]]:
        """The queries (class, least id, ids, codes) in lists of at most that many codes, or of one recording."""
        some, held = [], 0
        for r in q.toLocalIterator():
            if some and held + len(r.codes) > most:
                yield some
                some, held = [], 0
            some.append((r.h, r.query_id, r.n, np.array(r.codes, dtype=np.int32)))
            held += len(r.codes)
        if some:
            yield some


def _checker(queries, least: int, errors: float, told):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [c for *_, c in queries.value]
        place = {h: i for i, (h, *_) in enumerate(queries.value)}
        for batch in batches:
            flat, ends = np.asarray(batch.column(4).flatten()), np.cumsum(np.asarray(batch.column(4).value_lengths()))
            held = np.split(flat, ends[:-1])
            found = aligned(asked, held, least, errors)
            found |= {(place[x], r): (0, len(held[r]), 0) for r, x in enumerate(batch.column(0).to_pylist()) if x in place}
            yield told(batch, queries.value, held, found, errors)

    return check


def _matches(batch: pa.RecordBatch, queries: list, held: list[np.ndarray], found: dict, errors: float) -> pa.RecordBatch:
    class_id, members = (batch.column(k).to_pylist() for k in (2, 3))
    rows = [(queries[i][0], class_id[r], members[r], k, agreeing(queries[i][3], held[r], k), frames, wrong / (32 * frames)) for (i, r), (k, frames, wrong) in found.items()]
    return _columns(rows, ["q", "class_id", "members", "shift", "votes", "frames"], ["bit_error_rate"])


def _totals(batch: pa.RecordBatch, queries: list, held: list[np.ndarray], found: dict, errors: float) -> pa.RecordBatch:
    number, best = np.zeros(len(held), dtype=np.int64), {}
    for (i, r), (k, frames, wrong) in found.items():
        number[r] += queries[i][2]
        spare = (round(wrong - errors * 32 * frames, 6), abs(k), k, queries[i][1], i, frames, wrong)
        best[r] = min(best.get(r, spare), spare)
    h, h2 = (batch.column(k).to_pylist() for k in (0, 1))
    rows = [(h[r], h2[r], int(number[r]), off, k, query, agreeing(queries[i][3], held[r], k), frames, spare, wrong / (32 * frames)) for r, (spare, off, k, query, i, frames, wrong) in best.items()]
    out = _columns(rows, ["h", "h2", "n", "off", "shift", "query_id", "votes", "frames"], ["spare", "bit_error_rate"])
    return out.set_column(1, "h2", out["h2"].cast(pa.int32())).select(["h", "h2", "n", "spare", "off", "shift", "query_id", "votes", "frames", "bit_error_rate"])


def _columns(rows: list[tuple], whole: list[str], real: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * (len(whole) + len(real))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[: len(whole)]), *(pa.array(c, pa.float64()) for c in cols[len(whole) :])], whole + real)


def played(v: np.ndarray, notes: int = 32, length: int = 512) -> np.ndarray:
    """A melody of a vector: each note's pitch is a component's place between its neighbours, its loudness the next's size."""
    v = np.resize(np.asarray(v, dtype=np.float64), 2 * notes)
    v = v / max(1e-9, np.abs(v).max())
    pitch = 220 * 2 ** (np.round(12 * (v[0::2] + 1)) / 12)
    t = np.arange(length) / RATE
    loud = 0.3 + 0.5 * np.abs(v[1::2])
    return (loud[:, None] * np.sin(2 * np.pi * pitch[:, None] * t[None])).ravel()


def recordings(df: DataFrame, vector: str, out: str = "recording") -> DataFrame:
    """WAV bytes of the melody of each vector; null for null or non-finite ones. The tables hold no audio, so this makes some."""

    @arrow_udf("binary")
    def play(x: pa.Array) -> pa.Array:
        good = lambda v: v and None not in v and np.isfinite(v).all()
        return pa.array([encode(played(p)) if good(p := v.as_py()) else None for v in x], pa.binary())

    return df.withColumn(out, play(F.col(vector)))
