"""Bounded-space online packing of token sequences.

Every task keeps a fixed number of open windows. A document's end piece goes where it fits best; when none has room
for it, the fullest window is filled up with the head of the piece, emitted, and a fresh one opened. At the end of a
task its open windows are poured together, so one short window is left; the short windows of many tasks are poured
together in a second step. What is still short then is cut into runs whose lengths are powers of two, which need no
padding. No step holds more than its open windows and one slice of texts.

Defined cases: a null or empty text is the one end token; repeated rows are packed each on its own; a null doc_id is
carried; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import Work

SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, sequence_id long, offset long, ids binary"
COLUMNS = SCHEMA.replace(" long", "").replace(" binary", "").split(", ")
END_TEXT = "<|endoftext|>"
#: Fixed values of the public vocabulary.
END_TEXT_ID = 50256


class Encoder:
    """Ids as the tokenizers library gives them for the byte-level BPE file, by its rank table, which is faster."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END_TEXT: END_TEXT_ID})

    def ids(self, text: str) -> list[int]:
        return self.bpe.encode(text, allowed_special="all", disallowed_special=()) if END_TEXT in text else self.bpe.encode_ordinary(text)


class Windows:
    """The open windows of one task. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, size: int, open_windows: int):
        self.size, self.most = size, open_windows
        self.pieces: list[list[tuple]] = []
        self.used: list[int] = []

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> Iterator[list[tuple]]:
        """Places the ids; gives every window that is full."""
        while len(ids) >= self.size:
            yield [(doc, start, total, ids[: self.size])]
            start, ids = start + self.size, ids[self.size :]
        if not len(ids):
            return
        fits = [i for i, u in enumerate(self.used) if self.size - u >= len(ids)]
        if not fits and len(self.used) >= self.most:
            i = max(range(len(self.used)), key=self.used.__getitem__)
            room = self.size - self.used[i]
            self.pieces[i].append((doc, start, total, ids[:room]))
            yield self.pieces.pop(i)
            self.used.pop(i)
            start, ids, fits = start + room, ids[room:], []
            fits = [i for i, u in enumerate(self.used) if self.size - u >= len(ids)]
        if fits:
            i = max(fits, key=self.used.__getitem__)
            self.pieces[i].append((doc, start, total, ids))
            self.used[i] += len(ids)
            if self.used[i] == self.size:
                yield self.pieces.pop(i)
                self.used.pop(i)
        else:
            self.pieces.append([(doc, start, total, ids)])
            self.used.append(len(ids))

    def pour(self) -> list[list[tuple]]:
        """The open windows poured together, fullest first: full ones, and a short one at most."""
        order = sorted(range(len(self.used)), key=lambda i: -self.used[i])
        flat = [p for i in order for p in self.pieces[i]]
        self.pieces, self.used = [], []
        return list(cut(flat, self.size))


def cut(flat: list[tuple], size: int) -> Iterator[list[tuple]]:
    """The pieces in a row, cut every size ids."""
    now, room = [], size
    for doc, start, total, ids in flat:
        while len(ids) >= room:
            now.append((doc, start, total, ids[:room]))
            yield now
            start, ids, now, room = start + room, ids[room:], [], size
        if len(ids):
            now.append((doc, start, total, ids))
            room -= len(ids)
    if now:
        yield now


def in_powers(window: list[tuple]) -> Iterator[list[tuple]]:
    """A short window as runs whose lengths are powers of two, longest first."""
    left = sum(len(p[3]) for p in window)
    while left:
        run = 1 << (left.bit_length() - 1)
        first, rest, need = [], [], run
        for doc, start, total, ids in window:
            if need:
                take = min(need, len(ids))
                first.append((doc, start, total, ids[:take]))
                start, ids, need = start + take, ids[take:], need - take
            if len(ids):
                rest.append((doc, start, total, ids))
        yield first
        window, left = rest, left - run


def rows(windows: list[tuple[int, list[tuple], bool]], with_ids: bool) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in COLUMNS]
    for seq, pieces, leftover in windows:
        at = 0
        for doc, start, total, ids in pieces:
            raw = ids.tobytes()
            for c, v in zip(cols, (doc, start, len(ids), total, zlib.crc32(raw), None if leftover else seq, at, raw if with_ids or leftover else None), strict=True):
                c.append(v)
            at += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:-1]] + [pa.array(cols[-1], pa.binary())], COLUMNS)


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 1024, open_windows: int = 16, end_id: int = 0, ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = True, merge_pieces: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset, and ids (little-endian 32-bit) if asked for."""
    if ranks_path is None:
        import public_tokenizers

        ranks_path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, open_, seq = Encoder(ranks_path, pattern), Windows(size, open_windows), TaskContext.get().partitionId() << 32
        held, n = [], 0
        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*encoder.ids(value.as_py() or ""), end_id], dtype="<u4")
                for w in open_.add(doc.as_py(), 0, len(ids), ids):
                    held.append((seq, w, False))
                    seq += 1
                    n += len(w)
                if n >= 2000:
                    yield rows(held, with_ids)
                    held, n = [], 0
        for w in open_.pour():
            short = sum(len(p[3]) for p in w) < size
            held.append((seq, w, short))
            seq += 1
        if held:
            yield rows(held, with_ids)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, flat = (1 << 62) + (TaskContext.get().partitionId() << 32), []
        for batch in batches:
            for r in batch.to_pylist():
                flat.append((r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], dtype="<u4")))
            if sum(len(p[3]) for p in flat) >= 64 * size:
                *full, rest = cut(flat, size)
                yield rows([(seq + i, w, False) for i, w in enumerate(full)], with_ids)
                seq, flat = seq + len(full), rest
        done = [w for x in cut(flat, size) for w in (in_powers(x) if sum(len(p[3]) for p in x) < size else [x])]
        if done:
            yield rows([(seq + i, w, False) for i, w in enumerate(done)], with_ids)

    placed = Work(df.sparkSession, "packing").save(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(place, SCHEMA), "placed")
    done: Column = F.col("sequence_id").isNotNull()
    short = placed.filter(~done)
    tasks = 1 + short.count() // merge_pieces
    merged = short.repartition(tasks).mapInArrow(merge, SCHEMA)
    out = placed.filter(done).unionByName(merged)
    return out if with_ids else out.drop("ids")
