"""Reproducible numbers: places in an order without one task for all rows, and pseudorandom draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metaweave.session import saved


def draw(*parts: Column) -> Column:
    """A reproducible pseudorandom text of the parts, the same in any engine with md5."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def drawn(*parts: Column) -> Column:
    """A reproducible pseudorandom number below 2**48 for the parts."""
    return F.conv(F.substring(draw(*parts), 1, 12), 16, 10).cast("long")


def numbered(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """df with the place of each row, from 0, in the order of columns that tell rows apart: ranges are sorted each by its task and numbered from where those before end."""
    at, part = "__at", "__part"
    rows = saved(df.repartitionByRange(*[F.col(c) for c in by]).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn(part, F.shiftright(at, 33))
    ends = rows.groupBy(part).agg(F.count("*").alias("n"))  # a row for each task
    starts = ends.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("__start"))
    return rows.join(F.broadcast(starts), part).withColumn(out, F.col("__start") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, out)


def running_total(df: DataFrame, by: str, n: str, out: str) -> DataFrame:
    """df with the sum of n over the rows up to each in the order of by, which tells rows apart: by range, each summed by its task from where those before end."""
    part = "__part"
    rows = saved(df.repartitionByRange(F.col(by)).withColumn(part, F.spark_partition_id()), "ranges")
    ends = rows.groupBy(part).agg(F.sum(n).alias("__n"))  # a row for each task
    starts = ends.select(part, (F.sum("__n").over(Window.orderBy(part)) - F.col("__n")).alias("__start"))
    own = F.sum(n).over(Window.partitionBy(part).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__own", own).join(F.broadcast(starts), part).withColumn(out, F.col("__start") + F.col("__own")).select(*df.columns, out)


#: Places or gaps of one source that are put in order by one task; a hub's are dealt into spans of so many.
SPAN = 1 << 16


def _before(rows: DataFrame, by: list[str], n: str, out: str) -> DataFrame:
    """by, span, out: the sum of n over the spans before, for rows (by, span, n) that are already sums by span."""
    w = Window.partitionBy(*by).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0))).drop(n)


def gaps(own: DataFrame, span: int = SPAN) -> DataFrame:
    """n1, gap, m: for taken places (n1, place, distinct), how many m of them have gap free places before them."""
    cut = own.withColumn("span", F.floor(F.col("place") / span))
    heads = _before(cut.groupBy("n1", "span").agg(F.count("*").alias("n")), ["n1"], "n", "before")
    at = F.row_number().over(Window.partitionBy("n1", "span").orderBy("place")) - 1
    return cut.withColumn("at", at).join(heads, ["n1", "span"]).groupBy("n1", (F.col("place") - F.col("before") - F.col("at")).alias("gap")).agg(F.count("*").alias("m"))


def nth_free(taken: DataFrame, universe: DataFrame, asked: DataFrame, k, span: int = SPAN) -> DataFrame:
    """asked (n1, further columns) with nd, the k-th node, from 0, of the universe (nd) that n1 has not taken (n1, nd).

    k(free) gives the column k from the number of free nodes. The node is found by arithmetic on the places of those
    taken, so no list of all others is made; sources without a free node get no row. The k-th free place lies k places
    on, and as many further as there are taken places with at most k free ones before them; these are counted by one pass
    over asked and taken rows in order, in spans, so that a hub's rows are neither listed nor put into one task.
    """
    placed = saved(numbered(universe.select("nd").distinct(), ["nd"], "place"), "placed")
    total = placed.count()
    own = taken.select("n1", "nd").distinct().join(placed, "nd").select("n1", "place")
    held = saved(gaps(own, span), "gaps")
    free = held.groupBy("n1").agg(F.sum("m").alias("__m"))
    each = asked.join(free, "n1", "left").withColumn("free", F.lit(total) - F.coalesce("__m", F.lit(0))).filter("free > 0")
    each = each.withColumn("__k", k(F.col("free")).cast("long")).filter("__k < free").select(*asked.columns, "__k")
    rest = [c for c in asked.columns if c != "n1"]
    each = each.select("n1", F.col("__k").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("m"), F.struct(*[F.col(c) for c in rest]).alias("__row") if rest else F.lit(None).cast("struct<x:int>").alias("__row"))
    none = F.lit(None).cast(each.schema["__row"].dataType)
    both = each.unionByName(held.select("n1", F.col("gap").alias("at"), F.lit(0).alias("kind"), "m", none.alias("__row"))).withColumn("span", F.floor(F.col("at") / span))
    heads = _before(both.groupBy("n1", "span").agg(F.sum("m").alias("n")), ["n1"], "n", "before")
    # gaps come before the asked of their number, so those up to k count
    run = F.sum("m").over(Window.partitionBy("n1", "span").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("run", run).filter("kind = 1").join(heads, ["n1", "span"]).withColumn("place", F.col("at") + F.col("before") + F.col("run"))
    return found.join(placed, "place").select(*[F.col("n1") if c == "n1" else F.col("__row")[c].alias(c) for c in asked.columns], "nd")
