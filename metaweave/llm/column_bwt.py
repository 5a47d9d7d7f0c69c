"""Burrows-Wheeler transform and longest common prefixes of many strings, built column by column.

Round t inserts, for every string at once, the suffix of length t: its place follows from the last round's transform by
one stable counting pass (the LF step), and the symbol before it joins the transform there. The common prefix with its
new neighbours is one more than the least common prefix between the two symbols' places in the last round. Each round
reads the arrays of the last one front to back and writes those of the next; with a folder (any that pyarrow.fs
reaches) they lie in files between rounds, and memory holds one round.
"""

from __future__ import annotations

import numpy as np
import pyarrow.fs as pafs


class Column:
    """Arrays of the current round, in memory or in files of a folder that are rewritten in turn."""

    def __init__(self, folder: str | None):
        self.folder, self.turn, self.held = folder, 0, {}
        if folder is not None:
            self.fs, self.root = pafs.FileSystem.from_uri(folder)

    def get(self, name: str) -> np.ndarray:
        if self.folder is None:
            return self.held[name]
        kind, path = self.held[name]
        with self.fs.open_input_file(path) as f:
            return np.frombuffer(f.read_buffer(), dtype=kind)

    def put(self, **arrays: np.ndarray) -> None:
        if self.folder is None:
            self.held = arrays
            return
        self.turn += 1
        for name, a in arrays.items():
            path = f"{self.root}/{name}-{self.turn % 2}"  # the files of the last round but one are overwritten
            with self.fs.open_output_stream(path) as f:
                f.write(memoryview(np.ascontiguousarray(a)).cast("B"))
            self.held[name] = (a.dtype, path)


def insert(old: np.ndarray, at: np.ndarray, new: np.ndarray, keep: np.ndarray) -> np.ndarray:
    out = np.empty(len(keep), dtype=old.dtype)
    out[keep] = old
    out[at] = new
    return out


def build(strings: list[bytes], folder: str | None = None, most: int = 65_535) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transform, common prefix with the one before, start in the strings end to end with one place after each) of all suffixes in order.

    In the transform 0 ends a string and byte b is b + 1; so no string may hold the byte 255, which UTF-8 never does.
    Common prefixes are counted up to most.
    """
    m = len(strings)
    length = np.array([len(s) for s in strings], dtype=np.int64)
    text = np.frombuffer(b"\xff".join([*strings, b""]), dtype=np.uint8) + np.uint8(1)  # the separator becomes 0
    stop = np.cumsum(length + 1) - 1
    # the symbol before the suffix that starts at i is text[i - 1]; before the first string stands a separator too
    before = np.append(np.uint8(0), text[:-1]) if len(text) else text
    start = stop.copy()  # of each string's latest suffix
    at = np.arange(m)  # its place
    files = Column(folder)
    files.put(bwt=before[start], lcp=np.zeros(m, dtype=np.uint16), start=start.astype(np.int32 if len(text) < 2**31 else np.int64))
    live = np.arange(m)
    for t in range(1, int(length.max(initial=0)) + 1):
        bwt, lcp = files.get("bwt"), files.get("lcp")
        live = live[length[live] >= t]
        live = live[np.argsort(at[live])]
        p, n = at[live], len(bwt)
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        r, c = rank[p].astype(np.int64), bwt[p]
        place = m + r - (n - int(np.count_nonzero(bwt)))
        low, high = _common(lcp, bwt, order, r, c, p, -1, most), _common(lcp, bwt, order, r, c, p, 1, most)
        keep = np.ones(n + len(live), dtype=bool)
        keep[place] = False
        new = insert(lcp, place, low, keep)
        follows = (r + 1 < n) & (bwt[order[np.minimum(r + 1, n - 1)]] == c)
        new[place[follows] + 1] = high[follows]
        start[live] -= 1
        old = files.get("start")
        files.put(bwt=insert(bwt, place, before[start[live]], keep), lcp=new, start=insert(old, place, start[live].astype(old.dtype), keep))
        at[live] = place
    return files.get("bwt"), files.get("lcp"), files.get("start")


def _common(lcp: np.ndarray, bwt: np.ndarray, order: np.ndarray, r: np.ndarray, c: np.ndarray, p: np.ndarray, side: int, most: int) -> np.ndarray:
    """Common prefix of the inserted suffixes with the one before (side -1) or after (side 1) of the same first symbol, else 0."""
    n = len(bwt)
    q = order[np.clip(r + side, 0, n - 1)]
    ok = (r + side >= 0) & (r + side < n) & (bwt[q] == c) & (q != p)
    out = np.zeros(len(p), dtype=np.uint16)
    if ok.any():
        a, b = (q[ok] + 1, p[ok] + 1) if side < 0 else (p[ok] + 1, q[ok] + 1)
        padded = np.append(lcp, lcp[-1:])
        out[ok] = np.minimum(np.minimum.reduceat(padded, np.stack([a, b], 1).ravel())[::2], most - 1) + 1
    return out


def repeated(strings: list[bytes], least: int, folder: str | None = None) -> list[np.ndarray]:
    """For each string, where substrings of that length start that start elsewhere in the collection too."""
    _, lcp, start = build(strings, folder)
    up = lcp >= least
    hit = up.copy()
    hit[:-1] |= up[1:]
    found = np.sort(start[hit].astype(np.int64))
    base = np.cumsum([0, *(len(s) + 1 for s in strings)])
    edge = np.searchsorted(found, base)
    return [found[a:b] - o for a, b, o in zip(edge[:-1], edge[1:], base, strict=False)]
