"""Embedding whitening from upper-triangle column aggregates.

Entries become whole numbers, x = floor(steps * entry) + shift, so counts and sums are exact. Generated SQL expressions
sum the centred products of every pair of dimensions of the upper triangle in one aggregation over all rows; the driver
receives these sums only, assembles the covariance and decomposes it with LAPACK. A row's projection on the components,
each over the root of its eigenvalue, is a matrix product within the task that holds the row; no row is shuffled. The
covariance of the whitened columns is measured by the same aggregation and compared with the identity.

Centred means minus the exact mean S / n, taken apart as S = q * n + r: x - q is a whole number, and r / n is below 1.

Memory: a task holds Arrow batches; the driver d * d numbers. Above most_pairs pairs (64 dimensions have 2,080) the pairs
are dealt into several aggregations, each over all rows, so that no plan grows with d * d.

Defined cases: vectors that are null, empty or hold null or non-finite entries, or entries beyond 2**56 in size, are left
out of fit and result, as are those of another length than the commonest (ties: the least). Rows with a null or repeated
id are rows like others. A component without variance (its eigenvalue below rounding) has null whitened values, and the
identity is compared over the others. A deviation beyond 64 bits is null. An empty table gives no rows. Only id and
vector are read, so other columns may have any name; transform() keeps them and replaces a column named as its output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._work import Work

LONG = (1 << 63) - 1
#: Size from which scaled entries are left out.
MOST = float(1 << 56)


def whole(vector: Column, steps: int, shift: int) -> Column:
    """The vector as longs, null if it holds what has none."""
    scaled = F.transform(vector, lambda c: c.cast("double") * steps)
    fits = F.coalesce(F.forall(scaled, lambda c: c.isNotNull() & (F.abs(c) < MOST)), F.lit(False)) & (F.size(vector) > 0)
    return F.when(fits, F.transform(scaled, lambda c: F.floor(c) + shift))


def products(df: DataFrame, columns: list[str], most_pairs: int) -> np.ndarray:
    """The matrix of summed products of the columns, from its upper triangle; null sums are 0."""
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d))
    for a in range(0, len(pairs), most_pairs):
        some = pairs[a : a + most_pairs]
        row = df.selectExpr(*[f"sum(`{columns[i]}` * `{columns[j]}`) AS p{a + n}" for n, (i, j) in enumerate(some)]).first()
        for (i, j), value in zip(some, row, strict=True):
            out[i, j] = out[j, i] = value or 0.0
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n * x - S) ** 2 for each row, null beyond 64 bits."""
    if not len(x):
        return []
    s, top = np.array(sums, dtype=object), max(abs(int(x.min())), abs(int(x.max())))
    if n * top + max(map(abs, sums)) <= LONG:
        t = n * x - s.astype(np.int64)
        if x.shape[1] * int(np.abs(t).max()) ** 2 <= LONG:
            return (t * t).sum(1).tolist()
    t = n * x.astype(object) - s
    return [v if v <= LONG else None for v in (t * t).sum(1)]


class Whitening:
    """Fits on all rows of df; n, dims, sums, values (falling), vectors (components as rows), trace are known after it."""

    def __init__(self, df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 32, steps: int = 64, shift: int = 1_000_000, most_pairs: int = 4096):
        self.work = Work(df.sparkSession, "whitening")
        self.steps, self.shift, self.vector, self.most_pairs = steps, shift, vector, most_pairs
        rows = df.select(F.col(vec_id).alias("vec_id"), whole(F.col(vector), steps, shift).alias("x")).filter("x IS NOT NULL")
        rows = self.work.save(rows, "whole")
        common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        self.n, self.dims = (common.n, common.d) if common else (0, 0)
        self.rows = rows.filter(F.size("x") == self.dims)
        self.kept = min(components, self.dims)
        if self.n:
            self._fit()

    def _fit(self) -> None:
        total = self.rows.agg(*[F.sum(F.get("x", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(self.dims)]).first()
        self.sums = [int(s) for s in total]
        self.floors, rests = [s // self.n for s in self.sums], [s % self.n for s in self.sums]
        self.parts = [r / self.n for r in rests]
        centred = self.rows.select(*[((F.get("x", F.lit(i)) - F.lit(q)).cast("double") - F.lit(p)).alias(f"z{i}") for i, (q, p) in enumerate(zip(self.floors, self.parts, strict=True))])
        cov = products(centred, centred.columns, self.most_pairs) / self.n
        values, vectors = np.linalg.eigh(cov)
        self.trace = float(np.trace(cov))
        self.values, self.vectors = np.maximum(values[::-1][: self.kept], 0), vectors.T[::-1][: self.kept]
        first = np.abs(self.vectors).argmax(1)  # the sign: the largest entry is positive
        self.vectors = self.vectors * np.where(self.vectors[np.arange(self.kept), first] < 0, -1.0, 1.0)[:, None]
        self.live = self.values > max(self.trace, 0) * self.dims * 1e-15
        self.to = np.where(self.live, 1 / np.sqrt(np.where(self.live, self.values, 1)), np.nan)[:, None] * self.vectors

    def _shared(self):
        return self.rows.sparkSession.sparkContext.broadcast((self.n, self.sums, np.array(self.floors, dtype=np.int64), np.array(self.parts), self.to))

    def _whitened(self, x: Column) -> Column:
        """struct(deviation, whitened) of whole vectors of the fitted length."""
        held = self._shared()

        @arrow_udf("struct<deviation:bigint,whitened:array<double>>")
        def whiten(column: pa.Array) -> pa.Array:
            n, sums, floors, parts, to = held.value
            rows = np.asarray(column.drop_null().flatten(), dtype=np.int64).reshape(-1, len(sums))
            w = ((rows - floors) - parts) @ to.T
            known = np.asarray(column.is_valid())
            offsets = np.concatenate([[0], np.cumsum(known)]).astype(np.int32) * len(to)
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
            found, dev = iter(deviations(rows, n, sums)), []
            for k in known:
                dev.append(next(found) if k else None)
            return pa.StructArray.from_arrays([pa.array(dev, pa.int64()), lists], ["deviation", "whitened"])

        return whiten(x)

    def transform(self, df: DataFrame, out: str = "whitened") -> DataFrame:
        """df with the whitened vector of each row as out; null where the vector is left out."""
        if not self.n:
            return df.withColumn(out, F.lit(None).cast("array<double>"))
        x = whole(F.col(self.vector), self.steps, self.shift)
        x = F.when(F.size(x) == self.dims, x)
        return df.withColumn(out, F.when(x.isNotNull(), self._whitened(x)["whitened"]))

    def whitened(self) -> DataFrame:
        """vec_id, deviation, whitened of the rows fitted on, written once."""
        if not hasattr(self, "_table"):
            self._table = self.work.save(self.rows.select("vec_id", self._whitened(F.col("x")).alias("w")).select("vec_id", "w.*"), "whitened")
        return self._table

    def identity_error(self) -> float | None:
        """Largest absolute entry of the whitened rows' covariance minus the identity; null if no component has variance."""
        live = np.flatnonzero(self.live)
        if not len(live):
            return None
        columns = [F.get("whitened", F.lit(int(k))).alias(f"w{k}") for k in live]
        plain = self.whitened().select(*columns)
        means = plain.agg(*[F.avg(c).alias(c) for c in plain.columns]).first()
        centred = plain.select(*[(F.col(c) - F.lit(m)).alias(c) for c, m in zip(plain.columns, means, strict=True)])
        return float(np.abs(products(centred, plain.columns, self.most_pairs) / self.n - np.eye(len(live))).max())

    def digest(self) -> DataFrame:
        """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each row and component."""
        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        if not self.n:
            empty = self.rows.select("vec_id", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), *[F.lit(0.0).alias(c) for c in names[4:]])
            return empty.filter(F.lit(False))
        share = F.array(*[F.lit(float(v / self.trace) if self.trace > 0 else 0.0) for v in self.values])
        long = self.whitened().select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        rows = long.withColumns({"component": F.col("at") + 1, "n": F.lit(self.n).cast("long"), "explained": F.get(share, F.col("at")), "identity_error": F.lit(self.identity_error()).cast("double")})
        return rows.select(names)
