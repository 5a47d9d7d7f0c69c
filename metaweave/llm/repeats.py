"""Removal of long repeated byte strings, by a suffix-array construction over what can repeat.

A byte goes if it lies in a string of so many bytes that starts anywhere else in the corpus. Building the transform of
whole texts column by column takes as many rounds over all bytes as the longest text has, so an exact filter first
leaves over only the places that sorting has to decide:

1. Every window has an anchor, the leftmost least gram in it; runs of windows with one anchor are a row, its bytes the
   context. Equal windows have equal anchors at equal places. Contexts that occur twice are repeated as a whole.
2. Of anchors with several contexts, a context is trimmed to what it can share: the furthest it agrees with any other
   to the left and to the right, found by sorting. Trimmed strings that are then equal repeat as a whole.
3. For the rest of each such group the transform and common prefixes are built column by column (column_bwt): a window
   repeats if its suffix has a neighbour with so long a common prefix. Strings of a task of more than file_bytes together
   go through files of the shared folder between the columns, others through memory.

Groups are handled whole in a task up to most_group contexts; the windows of larger ones are hashed and counted by a
partially aggregated shuffle instead, so no key has to fit into a task. Equality in step 1 and for
large groups is by two hashes, of 64 bits modulo a power of two and of 31 bits modulo a prime; by bytes elsewhere.

Defined cases: a null text has no bytes; texts shorter than a window keep all; rows equal in doc_id and text are rows of
their own and so repeat each other; a null doc_id is carried; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import column_bwt
from ._text import byte_table, buffers, prefix_hash, slices, span_hash
from ._work import Work

TABLE = byte_table(7)


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for every i that has w values."""
    n = len(x)
    if n < w:
        return x[:0]
    rows = -(-n // w)
    full = np.full(rows * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    full[:n] = x
    block = full.reshape(rows, w)
    head = np.minimum.accumulate(block, axis=1).ravel()
    tail = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def anchors(c: np.ndarray, n: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n bytes from 0 under the prefix hash c: (first window, windows, anchor) for every anchor in turn."""
    at = np.arange(n - gram + 1)
    h = span_hash(c, at, at + gram)
    bits = np.uint64(max(1, int(n).bit_length()))
    least = window_minima((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    x = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.diff(x, prepend=-1))
    return new, np.diff(np.append(new, len(x))), x[new]


class Check:
    """A second hash of spans, modulo a prime: it tells apart what the first, modulo a power of two, can't by its kind."""

    PRIME, BASE = (1 << 31) - 1, 1_220_703_125

    def __init__(self):
        self.values = (TABLE % np.uint64(self.PRIME)).astype(np.uint64)
        self.up, self.down = (np.ones(1, dtype=np.uint64) for _ in range(2))

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k, p = len(self.up), np.uint64(self.PRIME)
            self.up, self.down = (np.concatenate([w, w * np.uint64(pow(b, k, self.PRIME)) % p]) for w, b in ((self.up, self.BASE), (self.down, pow(self.BASE, -1, self.PRIME))))
        return self.up, self.down

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.values[raw] * self._powers(len(raw))[0][: len(raw)] % np.uint64(self.PRIME), out=out[1:])
        return out

    def spans(self, c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        p = np.uint64(self.PRIME)
        return (c[ends] - c[starts]) % p * self._powers(len(c))[1][starts] % p


CHECK = Check()
#: Most window starts taken at once; a longer text is taken in runs of them.
RUN = 1 << 20
#: Rows of a counted side that a join may broadcast.
MOST_BROADCAST = 1_000_000


def context_rows(raw: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first window, windows, anchor's distance from it, context hash, anchor hash, context check) of one text."""
    for lo in range(0, len(raw) - length + 1, RUN):
        part = raw[lo : lo + RUN + length - 1]
        c = prefix_hash(part, TABLE)
        first, count, x = anchors(c, len(part), length, gram)
        ends = first + count - 1 + length
        yield lo + first, count, x - first, span_hash(c, first, ends), span_hash(c, x, x + gram), CHECK.spans(CHECK.prefix(part), first, ends)


def agreement(keys: list[bytes]) -> np.ndarray:
    """For each string, the longest prefix it has in common with any other."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    out = np.zeros(len(keys), dtype=np.int64)
    for i, j in zip(order, order[1:], strict=False):
        a, b = keys[i], keys[j]
        n = min(len(a), len(b))
        differ = np.frombuffer(a, dtype=np.uint8, count=n) != np.frombuffer(b, dtype=np.uint8, count=n)
        k = int(differ.argmax()) if n and differ.any() else n
        out[i], out[j] = max(out[i], k), max(out[j], k)
    return out


def trimmed(group: list[tuple[bytes, int]], length: int) -> list[tuple[int, bytes]]:
    """(bytes cut off at the head, what is left) of each (context, anchor's place) of one anchor; too short a rest is empty."""
    left = agreement([s[:x][::-1] for s, x in group])
    right = agreement([s[x:] for s, x in group])
    return [(x - int(a), s[x - int(a) : x + int(b)] if a + b >= length else b"") for (s, x), a, b in zip(group, left, right, strict=True)]


def shared_windows(groups: list[list[tuple[bytes, int]]], length: int, folder: str | None = None) -> list[list[np.ndarray]]:
    """For every group of distinct contexts of one anchor, for each context, the windows in it that another one has."""
    out, open_ = [], []
    for g, group in enumerate(groups):
        found, by = [np.zeros(0, dtype=np.int64) for _ in group], {}
        for k, (cut, rest) in enumerate(trimmed(group, length)):
            if rest:
                by.setdefault((rest, group[k][1] - cut), []).append((k, cut))
        for (rest, _), who in by.items():
            if len(who) > 1:
                for k, cut in who:
                    found[k] = cut + np.arange(len(rest) - length + 1)
        if any(len(who) == 1 for who in by.values()) and len(by) > 1:
            open_ += [(g, who, rest) for (rest, _), who in by.items()]
        out.append(found)
    if open_:
        for (g, who, _), hits in zip(open_, column_bwt.repeated([rest for _, _, rest in open_], length, folder), strict=True):
            if len(who) == 1:
                k, cut = who[0]
                out[g][k] = cut + hits
    return out


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Covered intervals of windows at the sorted starts."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + length).tolist(), strict=True))


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal covered intervals; touching ones are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Repeats:
    """The repeated byte strings of one table. spans: uid, spans (start, end) of the bytes to remove."""

    def __init__(self, df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, gram: int = 200, most_group: int = 2000, batch: int = 512, file_bytes: int = 16 << 20):
        self.work = work = Work(df.sparkSession, "repeats")
        self.length, self.batch = length, batch
        folder = work.mkdir("rounds")
        self.folder, self.file_bytes = folder if "://" in folder else re.sub("^(file:)?/*", "file:///", folder), file_bytes
        self.rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        self.rows = self.rows.select(F.xxhash64("doc_id", "text").alias("uid"), "doc_id", "text")

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                uid = np.asarray(batch.column(0))
                for i, j, offs, raw in slices(batch.column(1)):
                    got = [(uid[i + d], *r) for d in range(j - i) if offs[d + 1] - offs[d] >= length for r in context_rows(raw[offs[d] : offs[d + 1]], length, gram)]
                    if got:
                        cols = [np.repeat([r[0] for r in got], [len(r[1]) for r in got]), *(np.concatenate([r[k] for r in got]) for k in range(1, 7))]
                        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in cols], ["uid", "at", "windows", "lead", "context", "anchor", "check"])

        every = work.save(self.rows.select("uid", "text").mapInArrow(find, "uid long, at long, windows long, lead long, context long, anchor long, check long"), "contexts")
        twice = work.sized(every.groupBy("context", "check").agg(F.count("*").alias("n")).filter("n > 1").select("context", "check"), MOST_BROADCAST, "twice")
        whole = every.join(twice, ["context", "check"], "left_semi").select("uid", F.col("at").alias("s"), (F.col("at") + F.col("windows") - 1 + length).alias("e"))
        split = work.sized(every.groupBy("anchor").agg(F.min("context").alias("low"), F.max("context").alias("high"), F.min("check").alias("least"), F.max("check").alias("most")).filter("low <> high OR least <> most").select("anchor"), MOST_BROADCAST, "split")
        open_ = every.join(split, "anchor", "left_semi").groupBy("anchor", "context", "check").agg(F.min(F.struct("uid", "at", "windows", "lead")).alias("one"), F.count("*").alias("n"))
        open_ = work.save(open_.select("anchor", "context", "check", "n", "one.*"), "open")
        members = open_.groupBy("anchor").agg(F.count("*").alias("members"))
        hot = F.broadcast(work.save(members.filter(F.col("members") > most_group).select("anchor"), "hot"))  # at most a row for most_group contexts
        place = F.struct("at", "windows", "lead", "context", "anchor", "check", "n")
        wanted = work.sized(open_.groupBy("uid").agg(F.collect_list(place).alias("places")), MOST_BROADCAST // 4, "wanted")
        texts = work.save(self.rows.join(wanted, "uid").select("uid", "text", "places").mapInArrow(self._cutter(), CUT).dropDuplicates(["anchor", "context", "check"]), "cut")
        normal = texts.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "context", "check")
        few = normal.mapInArrow(self._solver(), "uid long, s long, e long")
        windows = work.save(texts.join(hot, "anchor", "left_semi").mapInArrow(self._hasher(), "anchor long, context long, hash long, s long, uid long, again long"), "windows")
        again = windows.groupBy("anchor", "hash", "again").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        many = windows.join(again, ["anchor", "hash", "again"], "left_semi").select("uid", "s", (F.col("s") + length).alias("e"))
        spans = whole.unionByName(few).unionByName(many).groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
        self.spans = work.sized(spans, MOST_BROADCAST // 4, "spans")

    def _cutter(self):
        """Bytes of the wanted contexts."""
        length = self.length

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                offs, raw = buffers(batch.column(1))
                out = []
                for k in range(batch.num_rows):
                    uid = batch.column(0)[k].as_py()
                    for p in batch.column(2)[k].as_py():
                        a = int(offs[k]) + p["at"]
                        out.append({"uid": uid, **p, "bytes": raw[a : a + p["windows"] - 1 + length].tobytes()})
                        if len(out) >= 5000:
                            yield pa.RecordBatch.from_pylist(out, schema=CUT_ARROW)
                            out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=CUT_ARROW)

        return cut

    def _solver(self):
        """Spans of the windows that a context shares with another one of its anchor."""
        length, most, folder, file_bytes = self.length, self.batch, self.folder, self.file_bytes

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups: list[list[dict]] = []
            size, last = 0, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["anchor"] != last:
                        if size >= most:
                            yield spans(groups)
                            groups, size = [], 0
                        groups.append([])
                        last = r["anchor"]
                    groups[-1].append(r)
                    size += 1
            if groups:
                yield spans(groups)

        def spans(groups: list[list[dict]]) -> pa.RecordBatch:
            own = None
            if sum(len(r["bytes"]) for g in groups for r in g) > file_bytes:
                fs, root = pafs.FileSystem.from_uri(folder)
                own = f"attempt-{TaskContext.get().taskAttemptId()}"
                fs.create_dir(f"{root}/{own}")
            found = shared_windows([[(r["bytes"], r["lead"]) for r in g] for g in groups], length, own and f"{folder}/{own}")
            if own:
                fs.delete_dir(f"{root}/{own}")
            rows = [(r["uid"], r["at"] + a, r["at"] + b) for g, f in zip(groups, found, strict=True) for r, w in zip(g, f, strict=True) if r["n"] == 1 for a, b in runs(w, length)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(3)], ["uid", "s", "e"])

        return solve

    def _hasher(self):
        """Every window of a context as a row."""
        length = self.length

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    raw, w = np.frombuffer(r["bytes"], dtype=np.uint8), np.arange(r["windows"])
                    h = span_hash(prefix_hash(raw, TABLE), w, w + length).view(np.int64)
                    check = CHECK.spans(CHECK.prefix(raw), w, w + length).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), r[k])) for k in ("anchor", "context")] + [pa.array(h), pa.array(r["at"] + w), pa.array(np.full(len(w), r["uid"])), pa.array(check)], ["anchor", "context", "hash", "s", "uid", "again"])

        return windows

    def digest(self) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining text; where a cut leaves part of a character
        behind, kept shows U+FFFD in its place, while the hash is over the bytes as they are."""

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                offs, raw = buffers(batch.column(1))
                cols: list[list] = [[] for _ in range(5)]
                for k in range(batch.num_rows):
                    own, at, rest = raw[offs[k] : offs[k + 1]], 0, []
                    cuts = covered([(p["s"], p["e"]) for p in batch.column(2)[k].as_py() or ()])
                    for a, b in cuts:
                        rest.append(own[at:a])
                        at = b
                    kept = b"".join([*rest, own[at:]])
                    for c, v in zip(cols, (len(own), len(own) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

        return self.rows.join(self.spans, "uid", "left").select("doc_id", "text", "spans").mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")


CUT = "uid long, at long, windows long, lead long, context long, anchor long, check long, n long, bytes binary"
CUT_ARROW = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in CUT.split(", ")])
