"""Statistics of networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Upper bounds of the degree histogram.
DEGREE_BINS = (1, 2, 3, 4, 5, 10, 20, 50, 100, 500, 1000)


def degrees(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("n1", "n2")).alias("nd")).groupBy("nd").agg(F.count("*").alias("degree"))


def degree_histogram(d: DataFrame) -> DataFrame:
    """bin (its upper bound, null above the last), n."""
    b = None
    for x in DEGREE_BINS:
        b = F.when(F.col("degree") <= x, x) if b is None else b.when(F.col("degree") <= x, x)
    return d.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def gini(d: DataFrame, column: str = "degree") -> DataFrame:
    """One row; from counts of distinct values, so that no task sorts all rows."""
    c = d.groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n"))
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    x = F.col("x") + 1e-7
    rank_sum = F.col("n") * F.col("before") + F.col("n") * (F.col("n") + 1) / 2  # of places before + 1 .. before + n
    s = c.agg(F.sum("n").alias("N"), F.sum(x * F.col("n")).alias("total"), F.sum(x * rank_sum).alias("weighted"))
    return s.select(((2 * F.col("weighted") - (F.col("N") + 1) * F.col("total")) / (F.col("N") * F.col("total"))).alias("gini"))


def quantiles(d: DataFrame, column: str) -> DataFrame:
    q = F.percentile(column, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return d.agg(q.alias("q")).select(*[F.col("q")[i].alias(n) for i, n in enumerate(("q0", "q25", "q50", "q75", "q100"))])


def component_coverage(comp: DataFrame) -> DataFrame:
    """kind, c1, auc from node, kind, component: the share of a kind in its best component, and the area under its shares summed from the best component on, against all components and an empty start.

    Components of one size are one row, so no task sorts all components; a single component has 1 for both.
    """
    sizes = comp.groupBy("kind", "component").agg(F.count("*").alias("n")).groupBy("kind", "n").agg(F.count("*").alias("m"))
    larger = Window.partitionBy("kind").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    n, m = F.col("n"), F.col("m")
    runs = sizes.withColumn("before", F.coalesce(F.sum(n * m).over(larger), F.lit(0)))
    g = runs.groupBy("kind").agg(F.max("n").alias("best"), F.sum(n * m).alias("nodes"), F.sum("m").alias("own"), F.sum(m * F.col("before") + n * m * m / 2).alias("area"))
    g = g.crossJoin(F.broadcast(comp.agg(F.count_distinct("component").alias("all"))))  # one row
    auc = F.when(F.col("all") == 1, 1.0).otherwise((F.col("area") / F.col("nodes") + F.col("all") - F.col("own")) / (F.col("all") + 1))
    return g.select("kind", (F.col("best") / F.col("nodes")).alias("c1"), auc.alias("auc"))


def network_stats(e: DataFrame, comp: DataFrame) -> DataFrame:
    """name, value of a network (n1, n2, w; node, kind, component): edges, components, their sizes' Gini, nodes of each kind, its coverage, and how degrees and each node's weight quartiles are spread over its nodes."""
    ends = e.select(F.explode(F.array("n1", "n2")).alias("node"), "w")
    quartiles = F.percentile("w", F.array(*[F.lit(x / 4) for x in range(5)]))
    nodes = ends.groupBy("node").agg(F.count("*").cast("double").alias("degree"), quartiles.alias("q")).join(comp, "node")
    what = [F.struct(F.lit("degree").alias("what"), F.col("degree").alias("x")), *[F.struct(F.lit(f"weight_q{25 * i}").alias("what"), F.col("q")[i].alias("x")) for i in range(5)]]
    spread = nodes.select("kind", F.inline(F.array(*what))).groupBy("kind", "what", "x").agg(F.count("*").alias("n"))
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    spread = spread.groupBy("kind", "what").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"), F.min("x").alias("min"), q.alias("q"), F.max("x").alias("max"))
    spread = spread.select("kind", "what", "mean", "min", *[F.col("q")[i].alias(c) for i, c in enumerate(("q25", "q50", "q75"))], "max")
    each = lambda d, name, columns: d.select(F.inline(F.array(*[F.struct(F.concat_ws(":", *name(c)).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])))
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"))
    out = each(e.agg(F.count("*").alias("edges")), lambda c: [F.lit(c)], ["edges"])
    out = out.unionByName(each(sizes.agg(F.count("*").alias("components")), lambda c: [F.lit(c)], ["components"]))
    one = sizes.agg(F.count("*").alias("k"))
    g = gini(sizes, "n").crossJoin(F.broadcast(one)).select(F.when(F.col("k") == 1, 1.0).otherwise(F.col("gini")).alias("gini"))
    out = out.unionByName(each(g, lambda c: [F.lit(c)], ["gini"]))
    out = out.unionByName(each(comp.groupBy("kind").agg(F.count("*").alias("nodes")), lambda c: [F.lit(c), F.col("kind")], ["nodes"]))
    out = out.unionByName(each(component_coverage(comp), lambda c: [F.lit(c), F.col("kind")], ["c1", "auc"]))
    return out.unionByName(each(spread, lambda c: [F.col("what"), F.col("kind"), F.lit(c)], ["mean", "min", "q25", "q50", "q75", "max"]))
