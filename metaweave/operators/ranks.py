"""Places among all vectors by distance, without a row for every pair of vectors.

Queries are dealt into blocks of thousands, vectors into packed blocks in the order of ids; each block of queries meets
every block of vectors in one task, which computes the distances as matrices. Only what is asked for leaves it: the places
of stated partners, the nearest themselves, or sums over the k least distances. A place is counted, not looked up: how many
distances are less than the partner's, and how many as large with a lesser id, are added up block by block, so no list of
distances is kept. What is shuffled is the vectors once for each block of queries (twice beyond HELD of them).

Distances are whole numbers of units in the last digit. Matrix products give all but those near a half unit, and small l2
ones, which are computed pair by pair; so a distance depends on its two vectors alone.

Memory of a task: a block of queries with the partners asked for (or k numbers each), HELD vectors at most, and a slice
of one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaweave.session import saved

from .evaluate import _distances
from .numbering import numbered

#: Vectors packed into one row; distances kept, or partners asked for, in one task; queries of one task.
PACK = 1024
MOST_KEPT = 4_000_000
QUERIES = 4096
#: Numbers of one task's k least, if only their sums are asked for.
MOST_SUMMED = 25_000_000
#: Components of vectors that a task keeps for the second look at them; more are sent twice.
HELD = 64_000_000
#: Vectors and distances of one matrix.
GROUP = 16_384
SLICE = 1 << 19
#: Pairs of vectors computed one by one at once.
PAIRS = 4096
#: Partners of a query that are counted one by one; of more the distances are sorted.
FEW = 8
#: Partners of a query with equals among the vectors that are counted one by one; for more the vectors are put in order.
TIED = 64
#: Distances that are not finite, in their order.
ENDLESS, NO_NUMBER = 1 << 61, 1 << 62
#: Packed rows that reach a Python worker at once.
BATCH_BYTES = 8 << 20


class _Nearest:
    """The k least (distance, id) of every query so far; blocks are gathered until they are worth a sort."""

    def __init__(self, n: int, k: int):
        self.d, self.ids, self.k, self.more, self.size = np.zeros((n, 0)), np.zeros((n, 0), dtype=np.int64), k, [], 0

    def add(self, d: np.ndarray, ids: np.ndarray) -> None:
        self.more.append((d, np.broadcast_to(ids, d.shape)))
        self.size += d.shape[1]
        if self.size >= max(self.k, 4096):
            self.settle()

    def settle(self) -> None:
        d = np.concatenate([self.d, *(m[0] for m in self.more)], axis=1)
        ids = np.concatenate([self.ids, *(m[1] for m in self.more)], axis=1)
        order = np.lexsort((ids, d), axis=1)[:, : self.k]
        self.d, self.ids = np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)
        self.more, self.size = [], 0


def _met(k: int, metric: str, digits: int):
    def close(heads: list, near: _Nearest | None) -> pa.RecordBatch | None:
        if near is None:
            return None
        near.settle()
        q, n = np.array([h[0] for h in heads]), near.d.shape[1]
        out = [pa.array(np.repeat(q, n)), pa.array(near.ids.ravel()), pa.array(near.d.ravel()), pa.array(np.tile(np.arange(n), len(q)))]
        return pa.RecordBatch.from_arrays(out, schema=_OUT["all"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, heads, near, x = None, [], None, None
        for at, kind, one, v, _ in _rows(batches):
            if at != block:
                if (out := close(heads, near)) is not None:
                    yield out
                block, heads, near, x = at, [], None, None
            if kind == 0:
                heads.append((int(one[0]), v))
            elif heads:
                if near is None:
                    near, x = _Nearest(len(heads), k), np.stack([h[1] for h in heads])
                near.add(_distance(_units(x, v.reshape(len(one), -1), metric, digits), digits), one)
        if (out := close(heads, near)) is not None:
            yield out

    return meet


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """block, kind, ids, components and partners of each row."""
    for batch in batches:
        blocks, kinds = np.asarray(batch.column("block")), np.asarray(batch.column("kind"))
        ids, flat, asked = (batch.column(c) for c in ("ids", "flat", "asked"))
        for r in range(batch.num_rows):
            yield int(blocks[r]), int(kinds[r]), np.asarray(ids[r].values), np.asarray(flat[r].values, dtype=np.float64), np.asarray(asked[r].values, dtype=np.int64)


def _whole(z: np.ndarray) -> np.ndarray:
    """Distances in units as whole numbers, 32 bits where they fit."""
    z = np.rint(z)
    if z.size == 0 or np.isfinite(top := z.max()) and top < (1 << 31) - 2:
        return z.astype(np.int32)
    known = np.isfinite(z)
    return np.where(known, np.where(known, z, 0).astype(np.int64), np.where(np.isnan(z), NO_NUMBER, ENDLESS))


def _one_by_one(x: np.ndarray, y: np.ndarray, metric: str, digits: int) -> np.ndarray:
    """Distances of rows of x and y in units, not rounded; l2 ones dimension by dimension, so that equal vectors are at 0."""
    if metric == "l2":
        s = np.zeros(len(x))
        for a in np.ascontiguousarray((x - y).T):
            s += a * a
        return np.sqrt(s) * 10.0**digits
    s, xx, yy = (np.einsum("ij,ij->i", a, b) for a, b in ((x, y), (x, x), (y, y)))
    with np.errstate(all="ignore"):
        return (1 - s / np.sqrt(xx * yy)) * 10.0**digits


def _units(x: np.ndarray, y: np.ndarray, metric: str, digits: int) -> np.ndarray:
    """All distances of x from y as whole numbers of units, the same as one by one."""
    xx, yy, scale = (x * x).sum(1), (y * y).sum(1), 10.0**digits
    with np.errstate(all="ignore"):
        if metric == "l2":
            slip = 1e-15 * x.shape[1] * (xx.max(initial=0) + yy.max(initial=0))  # what the squares may be off by
            z = x @ y.T
            z *= -2
            z += xx[:, None]
            z += yy[None]
            np.sqrt(np.maximum(z, 0, out=z), out=z)
            tell, low = 1e-3, scale * slip * 500  # from low on roots are off by 1e-3 units at most
            near = z < low
            z *= scale
        else:
            z = (x / np.sqrt(xx)[:, None]) @ (y / np.sqrt(yy)[:, None]).T
            np.subtract(1, z, out=z)
            z *= scale
            tell, near = scale * 1e-14 * x.shape[1], None
        apart = z - np.rint(z)
        again = ~(np.abs(apart, out=apart) <= 0.5 - tell)
        if near is not None:
            again |= near
        found = np.flatnonzero(again)
        for at in range(0, len(found), PAIRS):
            a, b = np.divmod(found[at : at + PAIRS], len(y))
            z[a, b] = _one_by_one(x[a], y[b], metric, digits)
    return _whole(z)


def _distance(units: np.ndarray, digits: int) -> np.ndarray:
    return np.where(units >= ENDLESS, np.where(units == NO_NUMBER, np.nan, np.inf), units / 10.0**digits)


class _Block:
    """Queries of one block and what has been found of them; vectors come in the order of ids."""

    def __init__(self, heads: list, metric: str, digits: int):
        self.q, self.x, self.metric, self.digits = np.array([h[0] for h in heads]), np.stack([h[1] for h in heads]), metric, digits
        self.ids, self.flat, self.size = [], [], 0

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        self.ids.append(ids)
        self.flat.append(v.reshape(len(ids), -1))
        self.size += len(ids)
        if self.size >= GROUP:
            self.settle()

    def settle(self) -> None:
        if self.size:
            ids, y = np.concatenate(self.ids), np.concatenate(self.flat).astype(np.float64)
            self.ids, self.flat, self.size = [], [], 0
            step = max(1, SLICE // GROUP)
            for at in range(0, len(self.x), step):
                self.met(slice(at, at + step), ids, _units(self.x[at : at + step], y, self.metric, self.digits))


class _Places(_Block):
    def __init__(self, heads: list, metric: str, digits: int):
        super().__init__(heads, metric, digits)
        row = np.repeat(np.arange(len(heads)), [len(h[2]) for h in heads])
        to = np.concatenate([h[2] for h in heads])
        order = np.argsort(to, kind="stable")
        self.row, self.to = row[order], to[order]
        self.units, self.known = np.zeros(len(to), dtype=np.int64), np.zeros(len(to), dtype=bool)
        self.starts = None

    def look(self, ids: np.ndarray, v: np.ndarray) -> None:
        """The distances of the partners among these vectors."""
        y = v.reshape(len(ids), -1)
        first, last = np.searchsorted(self.to, ids[0], "left"), np.searchsorted(self.to, ids[-1], "right")
        for at in range(first, last, PAIRS):
            some = slice(at, min(last, at + PAIRS))
            place = np.searchsorted(ids, self.to[some])
            here = ids[place] == self.to[some]
            self.known[some] = here
            self.units[some][here] = _whole(_one_by_one(self.x[self.row[some][here]], y[place[here]], self.metric, self.digits))

    def start(self) -> None:
        """Partners by query and distance, those not among the vectors left out."""
        row, to, units = (c[self.known] for c in (self.row, self.to, self.units))
        order = np.lexsort((units, row))
        self.row, self.to, self.units = row[order], to[order], units[order]
        self.count = np.zeros(len(to), dtype=np.int64)
        self.starts = np.searchsorted(self.row, np.arange(len(self.q) + 1))

    def met(self, rows: slice, ids: np.ndarray, d: np.ndarray) -> None:
        top = np.iinfo(d.dtype).max
        for i, one in enumerate(d, rows.start):
            mine = slice(self.starts[i], self.starts[i + 1])
            to, units = self.to[mine], self.units[mine]
            if not len(to):
                continue
            # of equal distances lesser ids come first: all of these vectors, none, or those before the partner itself
            below = np.minimum(units + (to > ids[-1]), top).astype(d.dtype)
            inside = (to >= ids[0]) & (to <= ids[-1])
            if len(to) <= FEW:
                n = np.array([np.count_nonzero(one < b) for b in below])
                for j in np.flatnonzero(inside):
                    n[j] += np.count_nonzero(one[: np.searchsorted(ids, to[j])] == below[j])
            else:
                line = np.sort(one)
                n = np.searchsorted(line, below)
                after = n + 1
                tied = np.flatnonzero(inside & (after < len(line)) & (line[np.minimum(after, len(line) - 1)] == below))
                if len(tied) > TIED:
                    place = np.empty(len(ids), dtype=np.int64)
                    place[np.argsort(one, kind="stable")] = np.arange(len(ids))
                    n[tied] = place[np.searchsorted(ids, to[tied])]
                else:
                    for j in tied:
                        n[j] += np.count_nonzero(one[: np.searchsorted(ids, to[j])] == below[j])
            self.count[mine] += n

    def out(self, k: int) -> pa.RecordBatch:
        kept = self.count < k
        d = _distance(self.units[kept], self.digits)
        return pa.RecordBatch.from_arrays([pa.array(self.q[self.row[kept]]), pa.array(self.to[kept]), pa.array(d), pa.array(self.count[kept])], schema=_OUT["asked"])


class _Sums(_Block):
    """The k least distances of every query."""

    def __init__(self, heads: list, metric: str, digits: int, k: int):
        super().__init__(heads, metric, digits)
        self.k, self.least = k, {}

    def met(self, rows: slice, ids: np.ndarray, d: np.ndarray) -> None:
        have = self.least.get(rows.start)
        d = d if have is None else np.concatenate([have, d], axis=1)
        self.least[rows.start] = np.partition(d, self.k - 1, axis=1)[:, : self.k].copy() if d.shape[1] > self.k else d

    def out(self) -> pa.RecordBatch:
        got = [[], [], [], []]
        for at in sorted(self.least):
            d = _distance(self.least[at], self.digits)
            for c, values in zip(got, (np.full(len(d), d.shape[1]), d.sum(1), (d**2).sum(1), d.max(1)), strict=True):
                c.append(values)
        return pa.RecordBatch.from_arrays([pa.array(self.q), *(pa.array(np.concatenate(c)) for c in got)], schema=_OUT["sums"])


def _counted(k: int, metric: str, digits: int, what: str):
    """Rows of a block: its queries (kind 0), the vectors (1), and the vectors again (2) if they are too many to be kept."""

    def close(heads: list, block: _Block | None, held: list) -> pa.RecordBatch | None:
        if block is None:
            return None
        if what == "sums":
            block.settle()
            return block.out()
        if block.starts is None:
            block.start()
        for ids, v in held:
            block.add(ids, v)
        block.settle()
        return block.out(k)

    def meet(batches: Iterator[pa.RecordBatch], again: bool) -> Iterator[pa.RecordBatch]:
        at, heads, block, held = None, [], None, []
        for b, kind, ids, v, asked in _rows(batches):
            if b != at:
                if (out := close(heads, block, held)) is not None:
                    yield out
                at, heads, block, held = b, [], None, []
            if kind == 0:
                heads.append((int(ids[0]), v, asked))
                continue
            if not heads:
                continue
            if block is None:
                block = _Sums(heads, metric, digits, k) if what == "sums" else _Places(heads, metric, digits)
            if what == "sums":
                block.add(ids, v)
            elif kind == 1:
                block.look(ids, v)
                if not again:
                    held.append((ids, v.astype(np.float32) if (v == v.astype(np.float32)).all() else v))
            else:
                if block.starts is None:
                    block.start()
                block.add(ids, v)
        if (out := close(heads, block, held)) is not None:
            yield out

    return meet


def _apart(x: np.ndarray, y: np.ndarray, metric: str, digits: int) -> np.ndarray:
    """Distances, the l2 ones as differences dimension by dimension, so that equal vectors are at 0."""
    if metric != "l2":
        return _distances(x, y, metric, digits)
    s = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        s += (x[:, i, None] - y[None, :, i]) ** 2
    return np.round(np.sqrt(s), digits)


_PLACE = [("q", pa.int64()), ("nd", pa.int64()), ("d", pa.float64()), ("rank", pa.int64())]
_OUT = {
    "asked": pa.schema(_PLACE),
    "all": pa.schema(_PLACE),
    "sums": pa.schema([("q", pa.int64()), ("n", pa.int64()), ("s", pa.float64()), ("s2", pa.float64()), ("most", pa.float64())]),
}


def ranked(vectors: DataFrame, k: int, metric: str = "l2", digits: int = 6, queries: DataFrame | None = None, asked: DataFrame | None = None, what: str = "asked", most: int = MOST_KEPT) -> DataFrame:
    """Of every query (nd, v; all vectors if None) its k nearest among the vectors (nd, v), ties by id, ids being whole numbers.

    what: `asked` gives q, nd, d, rank from 0 of the pairs asked (q, nd) that are among them; `all` gives all of them;
    `sums` gives q, n, s, s2, most: how many there are, the sums of d and its square, and the greatest.
    Vectors that are null are left out; an asked pair counts once.
    """
    whole = lambda df: df.select(F.col("nd").cast("long").alias("nd"), "v").filter("nd IS NOT NULL AND v IS NOT NULL")
    vectors = whole(vectors)
    queries = vectors if queries is None else whole(queries)
    spark = vectors.sparkSession
    n, width, m = *vectors.agg(F.count("*"), F.max(F.size("v"))).first(), queries.count()
    if what == "all":
        blocks = -(-m // max(1, min(256, most // max(1, 2 * min(k, n) + 4096))))
    else:
        # a few tasks a core where there are enough queries
        blocks = max(-(-m // QUERIES), min(2 * spark.sparkContext.defaultParallelism, -(-m // 256)))
    own = queries.withColumn("asked", F.array().cast("array<long>"))
    if what == "asked":
        asked = asked.select(F.col("q").cast("long").alias("nd"), F.col("nd").cast("long").alias("__to")).filter("__to IS NOT NULL")
        blocks = max(blocks, -(-asked.count() // most))
        own = queries.join(asked.groupBy("nd").agg(F.collect_set("__to").alias("asked")), "nd")
    elif what == "sums":
        blocks = max(blocks, -(-m * min(k, n) // MOST_SUMMED))
        own = own.filter(F.lit(k > 0))
    blocks = max(1, blocks)
    part = F.floor(F.col("__place") / PACK).cast("int").alias("part")
    packed = numbered(vectors, ["nd"], "__place").groupBy(part).agg(F.sort_array(F.collect_list(F.struct("nd", "v"))).alias("x"))
    packed = saved(packed.select("part", F.col("x.nd").alias("ids"), F.flatten(F.col("x.v")).alias("flat")), "packed")
    block = F.pmod(F.xxhash64("nd", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    heads = own.select(block, F.lit(0).alias("kind"), F.lit(0).alias("part"), F.array("nd").alias("ids"), F.col("v").alias("flat"), "asked")
    again = what == "asked" and n * (width or 0) > HELD
    kinds = F.explode(F.array(F.lit(1), F.lit(2)) if again else F.array(F.lit(1))).alias("kind")
    rest = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "part", "ids", "flat").select("block", kinds, "part", "ids", "flat", F.array().cast("array<long>").alias("asked"))
    kind = "q long, n long, s double, s2 double, most double" if what == "sums" else "q long, nd long, d double, rank long"
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # queries come first in their block, then the packed vectors one after the other; a block is a task
    dealt = heads.unionByName(rest).repartitionById(blocks, "block").sortWithinPartitions("block", "kind", "part")
    if what == "all":
        return dealt.mapInArrow(_met(k, metric, digits), kind)
    meet = _counted(k, metric, digits, what)
    return dealt.mapInArrow(lambda batches: meet(batches, again), kind)
