"""Stated queries against all vectors, block by block as matrices; no row is made for a pair that is not asked for.

Vectors are packed into rows of many; packs of queries are sent to where the packs of vectors are, and each meeting of two
packs is one matrix of distances in a task. What leaves a task is the nearest of each query, or how many pairs have each
distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaweave.session import saved

from .evaluate import distance
from .numbering import running_total
from .ranks import BATCH_BYTES, _apart

#: Vectors and queries in one row, queries sent to all tasks at once, and different distances that a task holds.
PACK = 1024
QUERY_PACK = 128
MOST_SENT = 20_000
MOST_HELD = 2_000_000
#: Steps of rounded distances up to which a task counts them in place.
MOST_STEPS = 1 << 23


def _packs(vectors: DataFrame, n: int, size: int) -> DataFrame:
    """ids, flat: the vectors (nd, v) in rows of about size, their components end to end as floats of the kind they had."""
    part = F.pmod(F.xxhash64("nd"), F.lit(max(1, -(-n // size))))
    g = vectors.groupBy(part.alias("part")).agg(F.collect_list(F.struct("nd", "v")).alias("x"))
    return g.select(F.col("x.nd").alias("ids"), F.flatten(F.col("x.v")).alias("flat"))


def _meetings(queries: DataFrame, vectors: DataFrame) -> list[DataFrame]:
    """Every pack of queries beside every pack of vectors; queries are sent in blocks of at most about MOST_SENT."""
    some = lambda d: d.select(F.col("nd").cast("long").alias("nd"), "v").filter("nd IS NOT NULL AND v IS NOT NULL")
    q, a = some(queries), some(vectors)
    spark = q.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    size = a.count()
    # many packs a task at most; a few tasks a core where there are enough
    packed = saved(_packs(a, size, PACK), "packed").repartition(max(1, min(-(-size // PACK), 4 * spark.sparkContext.defaultParallelism)))
    n = q.count()
    blocks = max(1, -(-n // MOST_SENT))
    own = saved(q.withColumn("block", F.pmod(F.xxhash64("nd", F.lit(2)), F.lit(blocks))), "asking")
    out = []
    for b in range(blocks):
        heads = _packs(own.filter(F.col("block") == b), -(-n // blocks), QUERY_PACK).select(F.col("ids").alias("q"), F.col("flat").alias("qv"))
        out.append(packed.join(F.broadcast(heads)))  # a bounded block of queries
    return out


def _matrices(batches: Iterator[pa.RecordBatch], metric: str, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for r in range(b.num_rows):
            q, ids = (np.asarray(b.column(c)[r].values) for c in ("q", "ids"))
            x, y = (np.asarray(b.column(c)[r].values, dtype=np.float64) for c in ("qv", "flat"))
            yield q, ids, _apart(x.reshape(len(q), -1), y.reshape(len(ids), -1), metric, digits)


def _least(k: int, metric: str, digits: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, ids, d in _matrices(batches, metric, digits):
            order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, order.shape[1])), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(d, order, 1).ravel())], ["q", "nd", "d"])

    return go


def near(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", digits: int = 6) -> DataFrame:
    """q, nd, d: of each query (nd, v) at least its k nearest vectors (nd, v), the k of each pack. Ids are whole numbers."""
    out = None
    for met in _meetings(queries, vectors):
        part = met.mapInArrow(_least(k, metric, digits), "q long, nd long, d double")
        out = part if out is None else out.unionByName(part)
    return out


def _steps(x: np.ndarray, y: np.ndarray, digits: int) -> np.ndarray | None:
    """Rounded l2 distances in steps of the last digit, by one matrix product; those that it may round otherwise are computed anew as _apart does.

    None where they are not finite or more than MOST_STEPS.
    """
    scale, xx, yy = 10.0**digits, (x * x).sum(1), (y * y).sum(1)
    size = float(xx.max() + yy.max()) if len(x) and len(y) else 0.0
    # no distance is above the sum of the greatest norms
    if not np.isfinite(size) or np.sqrt(2 * size) * scale >= MOST_STEPS:
        return None
    d = x @ y.T
    d *= -2
    d += xx[:, None]
    d += yy[None]
    d = np.sqrt(np.maximum(d, 0.0, out=d), out=d)
    d *= scale
    k = np.rint(d)
    # the product is off by some ulps of the squares: by less than a thousandth of a step beyond the distance near
    error = 8 * x.shape[1] * np.finfo(float).eps * size
    near = max(error * scale / 2e-3, np.sqrt(error)) * scale
    i, j = np.nonzero((np.abs(np.abs(d - k) - 0.5) < 2e-3) | (d < near))
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        s = np.zeros(len(p))
        for c in range(x.shape[1]):
            s += (x[p, c] - y[q, c]) ** 2
        k[p, q] = np.rint(np.sqrt(s) * scale)
    return k.astype(np.int32)


def _counted(digits: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more, size = (np.zeros(0), np.zeros(0, dtype=np.int64)), [], 0
        steps, waiting = np.zeros(0, dtype=np.int64), []

        def tally():
            found = np.bincount(np.concatenate([*waiting, np.zeros(0, dtype=np.int32)]), minlength=len(steps))
            found[: len(steps)] += steps
            return found

        def settle():
            values = np.concatenate([held[0], *(m[0] for m in more)])
            counts = np.concatenate([held[1], *(m[1] for m in more)])
            own, at = np.unique(values, return_inverse=True)
            total = np.zeros(len(own), dtype=np.int64)
            np.add.at(total, at, counts)
            return own, total

        for b in batches:
            for r in range(b.num_rows):
                q, ids = (np.asarray(b.column(c)[r].values) for c in ("q", "ids"))
                x, y = (np.asarray(b.column(c)[r].values, dtype=np.float64) for c in ("qv", "flat"))
                x, y = x.reshape(len(q), -1), y.reshape(len(ids), -1)
                other = q[:, None] != ids[None]
                k = _steps(x, y, digits)
                if k is not None:
                    waiting.append(k[other])
                    if sum(map(len, waiting)) >= MOST_HELD:
                        steps, waiting = tally(), []
                    continue
                found = np.unique(_apart(x, y, "l2", digits)[other] + 0.0, return_counts=True)
                more.append(found)
                size += len(found[0])
                if size >= MOST_HELD:
                    held, more, size = settle(), [], 0
                    if len(held[0]) >= MOST_HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(-held[0]), pa.array(held[1])], ["score", "n"])
                        held = (np.zeros(0), np.zeros(0, dtype=np.int64))
        steps = tally()
        at = np.nonzero(steps)[0]
        more.append((at / 10.0**digits, steps[at]))
        own, total = settle()
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(-own), pa.array(total)], ["score", "n"])

    return go


@dataclass(frozen=True)
class Scores:
    """Pairs of queries with all other vectors, the nearer the higher (score: the distance, negative): how many have each score, and the scores of stated pairs."""

    total: DataFrame
    of: Callable[[DataFrame], DataFrame]

    def areas(self, pairs: DataFrame, by: list[str]) -> DataFrame:
        """by, auroc: how well scores tell the pairs (by, n1, n2, distinct) of each group from all others; groups without scored pairs are missing."""
        # the places of pairs are sums of counts over lower scores, the same for all groups
        ranks = running_total(self.total, "score", "n", "upto").select("score", (F.col("upto") - (F.col("n") - 1) / 2).alias("place"))
        mine = self.of(pairs).groupBy(*by, "score").agg(F.count("*").alias("p")).join(ranks, "score")
        sums = mine.groupBy(*by).agg(F.sum("p").alias("p"), F.sum(F.col("p") * F.col("place")).alias("s"))
        every = self.total.agg(F.sum("n").alias("t"))  # one row
        return sums.crossJoin(F.broadcast(every)).select(*by, F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("t") - F.col("p"))).alias("auroc"))


def scores(queries: DataFrame, vectors: DataFrame, digits: int = 6) -> Scores:
    """Scores of the queries (nd, v) against all other vectors (nd, v) by l2 distance, ids being whole numbers.

    Stated pairs are computed dimension by dimension and rounded as the matrices are, so that their scores are among those counted.
    """
    total = None
    for met in _meetings(queries, vectors):
        part = met.mapInArrow(_counted(digits), "score double, n long")
        total = part if total is None else total.unionByName(part)
    total = saved(total.groupBy("score").agg(F.sum("n").alias("n")), "counts")
    asked, known = (d.filter("nd IS NOT NULL AND v IS NOT NULL").select("nd", "v") for d in (queries, vectors))

    scale = 10.0**digits

    def of(pairs: DataFrame) -> DataFrame:
        both = pairs.filter("n1 <> n2").join(asked.select(F.col("nd").alias("n1"), F.col("v").alias("__x")), "n1").join(known.select(F.col("nd").alias("n2"), F.col("v").alias("__y")), "n2")
        return both.select(*pairs.columns, (-(F.rint(distance(F.col("__x"), F.col("__y"), "l2") * scale) / scale)).alias("score"))

    return Scores(total, of)
