"""Centroid clustering by Exponion search.

Vectors become whole numbers, floor(steps * component), so distances, sums and means are exact. Every vector carries its
centroid, an upper bound on the distance to it and a lower bound on the distance to any other. When centroids move, the
bounds give way by how far they moved; a vector whose upper bound stays below its lower bound, or below half the gap from
its centroid to the nearest other, keeps its centroid unseen. Any other vector, first with its exact distance as upper
bound, scans only the centroids inside a ball around its current centroid: the two nearest lie within twice the upper
bound plus that gap. Each centroid has the list of the others by distance, so the ball is a prefix of the list. The
radius is inclusive and bounds are widened beyond rounding, so that equally near centroids are always met; ties go to the
smaller number.

A round is one pass over the rows, which stay where they are: the state is written beside each vector in the shared
folder, and the round's table replaces the one before it. New centroids come from sums by cluster that are aggregated
within each task first. The driver and each task hold the centroids, k * dims numbers, and their k * k distances, so k is
for some thousands; nothing that grows with the rows leaves the executors.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left out, as are those
with a scaled component of 2**27 or more in size, whose squared distances do not fit in 64 bits. Rows with a null id are
clustered but never start a cluster; repeated ids are rows of their own (equal start hashes are ordered by the vectors).
With fewer vectors than k there are as many clusters as starts; without any start there are no rows. Equal centroids: the
smaller number takes all. Only id and vector are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import Work

#: Bounds are widened by this share, far above rounding and far below any difference that matters to pruning.
SLACK = 1e-9
FAR = np.iinfo(np.int64).max
MOST = float(1 << 27)
STATE = "vec_id {0}, x array<int>, cluster int, upper double, lower double, distance long, scanned long"


def apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    d = x - c
    return (d * d).sum(-1)


def above(v):
    return v * (1 + SLACK) + SLACK


def below(v):
    return np.maximum(v * (1 - SLACK) - SLACK, 0)


class Centroids:
    """The centroids of a round, the sorted lists of the others, the gaps, and how far each moved since the last round."""

    def __init__(self, c: np.ndarray, before: np.ndarray | None = None):
        self.c, k = c, len(c)
        moved = np.zeros(k) if before is None else above(np.sqrt(apart(c, before)))
        d = np.stack([np.sqrt(apart(c, x)) for x in c])
        np.fill_diagonal(d, np.inf)
        self.order = np.argsort(d, axis=1, kind="stable")[:, : k - 1]
        self.dist = np.take_along_axis(d, self.order, 1)
        self.gap = self.dist[:, 0] if k > 1 else np.full(k, np.inf)
        self.moved = moved
        top = np.argsort(-moved, kind="stable")
        self.others = np.full(k, moved[top[0]])  # the farthest that any other centroid moved
        self.others[top[0]] = moved[top[1]] if k > 1 else 0.0


def assign(x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, m: Centroids) -> tuple[np.ndarray, ...]:
    """(cluster, upper, lower, centroids looked at) of rows by the bounds that they carry."""
    a, seen = a.copy(), np.zeros(len(a), dtype=np.int64)
    upper = upper + m.moved[a]
    lower = np.maximum(lower - m.others[a], 0)
    safe = np.maximum(lower, below(m.gap[a] / 2))
    open_ = np.flatnonzero(~(upper < safe))
    own = apart(x[open_], m.c[a[open_]])
    seen[open_] += 1
    upper[open_] = above(np.sqrt(own))
    left = ~(upper[open_] < safe[open_])
    open_, own = open_[left], own[left]
    at = a[open_]
    for c in np.unique(at):
        mine = at == c
        rows, best = open_[mine], own[mine]
        reach = above(2 * upper[rows] + m.gap[c])
        wide = np.argsort(-reach, kind="stable")
        rows, best, reach = rows[wide], best[wide], reach[wide]
        who, second = np.full(len(rows), c), np.full(len(rows), FAR)
        # rows fall out of the scan as the list leaves their ball
        inside = np.searchsorted(-reach, -m.dist[c], "right")
        for j, n in zip(m.order[c], inside, strict=True):
            if not n:
                break
            d = apart(x[rows[:n]], m.c[j])
            seen[rows[:n]] += 1
            nearer = (d < best[:n]) | ((d == best[:n]) & (j < who[:n]))
            second[:n] = np.where(nearer, best[:n], np.minimum(second[:n], d))
            best[:n], who[:n] = np.where(nearer, d, best[:n]), np.where(nearer, j, who[:n])
        a[rows], upper[rows] = who, above(np.sqrt(best))
        lower[rows] = np.where(second == FAR, np.inf, below(np.sqrt(second)))
    return a, upper, lower, seen


class Exponion:
    """Runs the rounds over df; centroids (the final ones) and state (every vector with its cluster) are known after it."""

    def __init__(self, df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, steps: int = 64, seed: int = 1):
        self.work, self.dims = Work(df.sparkSession, "exponion"), dims
        scaled = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * steps))
        fits = F.forall(F.col(vector), lambda c: c.isNotNull() & (F.abs(c.cast("double") * steps) < MOST))
        rows = df.filter(F.size(vector) == dims).filter(fits).select(F.col(vec_id).alias("vec_id"), scaled.cast("array<int>").alias("x"))
        first = rows.select("*", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("scanned"))
        state = self.work.save(first, "start")
        key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        starts = state.filter("vec_id IS NOT NULL").orderBy(key, "x").limit(k).select("x").collect()  # k rows
        self.centroids, before = np.array([r.x for r in starts], dtype=np.int64).reshape(-1, dims), None
        self.state = state
        if not len(self.centroids):
            return
        for _ in range(rounds):
            self._round(before)
            before, self.centroids = self.centroids, self._means()
        self._round(before)

    def _round(self, before: np.ndarray | None) -> None:
        held = self.state.sparkSession.sparkContext.broadcast(Centroids(self.centroids, before))
        dims = self.dims

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = held.value
            for b in batches:
                x = np.asarray(b.column("x").flatten(), dtype=np.int64).reshape(-1, dims)
                a, upper, lower, seen = assign(x, np.asarray(b.column("cluster")), np.asarray(b.column("upper")), np.asarray(b.column("lower")), m)
                seen = seen + np.asarray(b.column("scanned"))
                new = [pa.array(a, pa.int32()), pa.array(upper), pa.array(lower), pa.array(apart(x, m.c[a])), pa.array(seen)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), *new], b.schema.names)

        old = self.state
        self.state = self.work.save(old.mapInArrow(step, STATE.format(old.schema["vec_id"].dataType.simpleString())), "round")
        self.work.drop(old)

    def _means(self) -> np.ndarray:
        """Floors of the clusters' exact means; an empty cluster keeps its centroid."""
        sums = self.state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(self.dims)])
        out = self.centroids.copy()
        for r in sums.collect():  # k rows
            out[r.cluster] = [r[f"s{i}"] // r.n for i in range(self.dims)]
        return out

    def digest(self) -> DataFrame:
        """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scanned (centroids looked at in all rounds)."""
        per = self.state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect() if len(self.centroids) else []  # k rows
        total = sum(r.s for r in per)
        name = lambda c: hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest()
        known = self.state.sparkSession.createDataFrame([(r.cluster, r.s, total, name(self.centroids[r.cluster])) for r in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return self.state.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")
