"""Sparse matrices as (r, c, w) with separate label universes; products, degree weights, pruning."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metaweave.session import saved

from . import packed


@dataclass(frozen=True)
class Matrix:
    """Non-zero cells and the labels of all lines, empty ones too (columns id)."""

    cells: DataFrame
    rows: DataFrame
    cols: DataFrame

    def within(self) -> Matrix:
        c = self.cells.join(self.rows.select(F.col("id").alias("r")), "r", "left_semi").join(self.cols.select(F.col("id").alias("c")), "c", "left_semi")
        return replace(self, cells=c.select("r", "c", "w"))


def matrix(e: DataFrame, flip: bool = False, undirected: bool = False, weight: Column | None = None) -> Matrix:
    """Edges as a matrix; an undirected one is made symmetric; self loops are left out; a missing weight is 1."""
    w = F.coalesce(weight, F.lit(1.0)) if weight is not None else F.lit(1.0)
    a, b = ("n2", "n1") if flip else ("n1", "n2")
    m = e.filter("n1 <> n2").select(F.col(a).alias("r"), F.col(b).alias("c"), w.cast("double").alias("w"))
    if undirected:
        m = m.unionByName(m.select(F.col("c").alias("r"), F.col("r").alias("c"), "w"))
        m = m.groupBy("r", "c").agg(F.max("w").alias("w"))
    return Matrix(m, m.select(F.col("r").alias("id")).distinct(), m.select(F.col("c").alias("id")).distinct())


def of(cells: DataFrame) -> Matrix:
    return Matrix(cells, cells.select(F.col("r").alias("id")).distinct(), cells.select(F.col("c").alias("id")).distinct())


def fit(hops: list[Matrix]) -> list[Matrix]:
    """Labels between neighbouring hops cut down to those in both, left to right; cells to their labels."""
    for i in range(len(hops) - 1):
        both = hops[i].cols.intersect(hops[i + 1].rows)
        hops[i], hops[i + 1] = replace(hops[i], cols=both), replace(hops[i + 1], rows=both)
    return [h.within() for h in hops]


def drop_empty(hops: list[Matrix]) -> list[Matrix]:
    """Empty lines go, all found first and joined at the boundaries; one pass, so lines that this empties stay."""
    live_r = [h.cells.select(F.col("r").alias("id")).distinct() for h in hops]
    live_c = [h.cells.select(F.col("c").alias("id")).distinct() for h in hops]
    rows = [hops[0].rows.intersect(live_r[0]), *(hops[i].rows.intersect(live_r[i]).intersect(live_c[i - 1]) for i in range(1, len(hops)))]
    cols = [*(rows[i + 1] for i in range(len(hops) - 1)), hops[-1].cols.intersect(live_c[-1])]
    return [Matrix(h.cells, r, c).within() for h, r, c in zip(hops, rows, cols, strict=True)]


def set_diagonal(m: Matrix, value: float) -> Matrix:
    """Cells of labels that are rows and columns set to a constant; 0 removes them."""
    off = m.cells.filter("r <> c")
    if value:
        both = m.rows.intersect(m.cols).select(F.col("id").alias("r"), F.col("id").alias("c"), F.lit(float(value)).alias("w"))
        off = off.unionByName(both)
    return replace(m, cells=off)


@dataclass(frozen=True)
class Weighted(Matrix):
    """A matrix whose cells are those of raw (squares) times a factor (id, f) for their row and one for their column."""

    raw: DataFrame
    by_row: DataFrame
    by_col: DataFrame

    def scaled(self, by: str) -> DataFrame:
        """The cells with the factor of their r or c alone."""
        f = self.by_row if by == "r" else self.by_col
        return self.raw.join(f.select(F.col("id").alias(by), "f"), by).select("r", "c", (F.col("w") * F.col("f")).alias("w"))


def degree_weighted(m: Matrix, damping: float = 0.5) -> Weighted:
    """w squared over the damped sums of its row and column."""
    r = m.cells.groupBy("r").agg(F.pow(F.sum("w"), F.lit(-damping)).alias("fr"))
    c = m.cells.groupBy("c").agg(F.pow(F.sum("w"), F.lit(-damping)).alias("fc"))
    cells = m.cells.join(r, "r").join(c, "c").select("r", "c", (F.col("w") * F.col("w") * F.col("fr") * F.col("fc")).alias("w"))
    raw = m.cells.select("r", "c", (F.col("w") * F.col("w")).alias("w"))
    return Weighted(cells, m.rows, m.cols, raw, r.select(F.col("r").alias("id"), F.col("fr").alias("f")), c.select(F.col("c").alias("id"), F.col("fc").alias("f")))


#: Cells of one line that travel in one row.
LINE = 1024


def lines(cells: DataFrame, by: str, ids: str, *values: str) -> DataFrame:
    """by, ids, values: the cells of each line in rows of arrays of at most about LINE, of the ids and of each of the values."""
    held = (ids, *values)
    n = cells.groupBy(by).agg(F.count("*").alias("__n")).filter(F.col("__n") > LINE)  # the long lines alone are cut
    span = F.pmod(F.xxhash64(ids), F.coalesce(F.ceil(F.col("__n") / LINE), F.lit(1))).alias("__span")
    dealt = cells.join(n, by, "left").groupBy(by, span).agg(F.collect_list(F.struct(*held)).alias("__x"))
    return dealt.select(by, *[F.col("__x")[c].alias(c) for c in held])


def met(a: DataFrame, row: str, key: str, line: DataFrame) -> DataFrame:
    """a (row, key, ...) with the lines of its keys, dealt by row: what a row meets is shuffled as arrays, and rows a pair are made where they are summed up."""
    return a.join(line, key).drop(key).repartition(row)


def product(a: Matrix, b: Matrix) -> Matrix:
    """Lines of b sent to the rows of a and summed there; universes are a's rows and b's columns."""
    y = lines(b.cells.select(F.col("r").alias("k"), "c", F.col("w").alias("y")), "k", "c", "y")
    j = met(a.cells.select("r", F.col("c").alias("k"), F.col("w").alias("x")), "r", "k", y)
    j = j.select("r", "x", F.explode(F.arrays_zip("c", "y")).alias("t"))
    return Matrix(j.groupBy("r", F.col("t.c").alias("c")).agg(F.sum(F.col("x") * F.col("t.y")).alias("w")), a.rows, b.cols)


def transposed(a: Matrix, b: Matrix) -> bool:
    """Whether b is a turned over, labels included, told by counts and sums of 64-bit hashes (one small job)."""

    def mark(t: DataFrame, *columns: str) -> DataFrame:
        return t.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s"))

    marks = [mark(a.cells, "r", "c", "w"), mark(b.cells, "c", "r", "w"), mark(a.rows, "id"), mark(b.cols, "id"), mark(a.cols, "id"), mark(b.rows, "id")]
    every = marks[0].withColumn("k", F.lit(0))
    for k, m in enumerate(marks[1:], 1):
        every = every.unionByName(m.withColumn("k", F.lit(k)))
    got = {r.k: (r.n, r.s) for r in every.collect()}  # six rows
    return all(got[k] == got[k + 1] for k in (0, 2, 4))


@dataclass(frozen=True)
class Product:
    """A product that is yet to be made: of a with b."""

    a: Matrix
    b: Matrix

    def made(self) -> Matrix:
        return product(self.a, self.b)


def square_half(a: Matrix) -> Product:
    """The product of a with itself turned over, of which half of the ranking is done: its rows stay where they were summed up, and its columns rank the same."""

    def turn(cells: DataFrame) -> DataFrame:
        return cells.select(F.col("c").alias("r"), F.col("r").alias("c"), "w")

    if isinstance(a, Weighted):
        return Product(a, Weighted(turn(a.cells), a.cols, a.rows, turn(a.raw), a.by_col, a.by_row))
    return Product(a, Matrix(turn(a.cells), a.cols, a.rows))


def mirrored(half: DataFrame) -> DataFrame:
    own, other = F.struct("r", "c", "w"), F.struct(F.col("c").alias("r"), F.col("r").alias("c"), "w")
    return half.select(F.explode(F.when(F.col("r") == F.col("c"), F.array(own)).otherwise(F.array(own, other))).alias("x")).select("x.*")


def rounded(w: Column | str, digits: int) -> Column:
    """w to so many digits, halves up, by way of four more, so that sums in another order, which differ in their last bits, round alike at a half too."""
    w = F.col(w) if isinstance(w, str) else w
    return F.floor((F.rint(w * 10.0 ** (digits + 4)) + 5000.0) / 10000.0) / 10.0**digits


def neighbours(labels: DataFrame, share: float, low: int, high: int) -> DataFrame:
    """One row n: how many neighbours pruning keeps, from the number of labels (half to even)."""
    return labels.agg(F.greatest(F.lit(low), F.least(F.lit(high), F.bround(F.count("*") * F.lit(share)))).alias("n"))


def once(pairs: DataFrame, method: str) -> DataFrame:
    """Both sides of the pairs of a symmetric matrix of which one side (union; else both) is among cells."""
    pairs = pairs.groupBy(F.least("r", "c").alias("r"), F.greatest("r", "c").alias("c")).agg(F.min("w").alias("w"), F.count("*").alias("n"))
    return mirrored((pairs if method == "union" else pairs.filter("n = 2 OR r = c")).drop("n"))


def pruned_product(p: Product, share: float = 0.05, low: int = 3, high: int = 250, method: str = "union", digits: int | None = None, half: bool = False) -> Matrix:
    """The product, pruned as prune does; its pairs are summed, rounded and ranked by row as arrays unless it has too many columns."""
    a, b = p.a, p.b
    columns = b.cols.count()
    if columns > packed.MOST_COLUMNS:
        return prune(p.made(), share, low, high, method, digits, half)
    some = lambda labels, all_of: None if (n := int(neighbours(labels, share, low, high).first().n)) >= all_of else n
    row = some(b.cols, columns)
    col = row if half else some(a.rows, a.rows.count())
    right, factor = (b.scaled("r"), b.by_col) if isinstance(b, Weighted) else (b.cells, None)
    cells = packed.pruned(a.cells, right, b.cols, factor, row, col, method, digits, half)
    return Matrix(once(cells, method) if half and row is not None else cells, a.rows, b.cols)


def prune(m: Matrix, share: float = 0.05, low: int = 3, high: int = 250, method: str = "union", digits: int | None = None, half: bool = False) -> Matrix:
    """Cells among the heaviest of their row or (union; else and) column; ties by id.

    The numbers kept are counted first; a line whose number reaches all labels is not ranked. Rows are ranked where they
    are, columns after the one shuffle of the cells. half: m is symmetric, so its rows are ranked alone, as its columns rank
    the same, and what they keep is mirrored.
    """
    w = rounded("w", digits) if digits is not None else F.col("w")
    cells = m.cells.withColumn("w", w)

    def first(line: str, other: str, labels: DataFrame) -> Column | None:
        """Whether a cell is among the heaviest of its line; None if all are."""
        n = int(neighbours(labels, share, low, high).first().n)
        return None if n >= labels.count() else F.row_number().over(Window.partitionBy(line).orderBy(F.desc("w"), other)) <= n

    row = first("r", "c", m.cols)
    if half:
        if row is None:
            return replace(m, cells=cells)
        return replace(m, cells=once(cells.withColumn("k", row).filter("k"), method))
    col = first("c", "r", m.rows)
    if method == "union" and (row is None or col is None):
        return replace(m, cells=cells)
    yes = F.lit(True)
    ranked = cells.withColumn("in_row", yes if row is None else row).withColumn("in_col", yes if col is None else col)
    return replace(m, cells=ranked.filter("in_row OR in_col" if method == "union" else "in_row AND in_col").select("r", "c", "w"))


def l1(cells: DataFrame, by: str) -> DataFrame:
    s = cells.groupBy(by).agg(F.sum("w").alias("s"))
    return cells.join(s, by).withColumn("w", F.col("w") / F.col("s")).select("r", "c", "w")


def norm_prune(m: Matrix, share: float = 0.01, low: int = 1, high: int = 250, digits: int = 8, symmetric: bool = False) -> DataFrame:
    """Column-normalised cells' ranks among the kept of their row plus row-normalised cells' ranks among the kept of their column; of a symmetric matrix the former alone."""
    out, m = [], replace(m, cells=saved(m.cells, "cells"))
    for by, line, labels in (("c", "r", m.cols), ("r", "c", m.rows))[: 1 if symmetric else 2]:
        n = int(neighbours(labels, share, low, high).first().n)
        cells = l1(m.cells, by).withColumn("w", F.round("w", digits))
        other = "c" if line == "r" else "r"
        kept = cells.withColumn("k", F.row_number().over(Window.partitionBy(line).orderBy(F.desc("w"), other))).filter(F.col("k") <= n)
        score = F.rank().over(Window.partitionBy(line).orderBy("w")) / F.count("*").over(Window.partitionBy(line))
        out.append(kept.select("r", "c", score.alias("w")))
    return out[0] if symmetric else out[0].unionByName(out[1]).groupBy("r", "c").agg(F.sum("w").alias("w"))


def sum_of(ms: list[Matrix]) -> Matrix:
    """Cell-wise sum over the union of universes."""
    cells, rows, cols = ms[0].cells, ms[0].rows, ms[0].cols
    for m in ms[1:]:
        cells, rows, cols = cells.unionByName(m.cells), rows.union(m.rows), cols.union(m.cols)
    return Matrix(cells.groupBy("r", "c").agg(F.sum("w").alias("w")), rows.distinct(), cols.distinct())
