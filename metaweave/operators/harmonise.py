"""Continuous measurements (sample, feature, value) to signed calls: scaling, ranks, signatures, sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .numbering import running_total


def merge_replicates(m: DataFrame, how: str = "avg") -> DataFrame:
    return m.groupBy("sample", "feature").agg({"avg": F.avg, "median": F.median, "max": F.max, "min": F.min}[how]("value").alias("value"))


def dense_features(m: DataFrame, share: float = 0.05) -> DataFrame:
    """Without the features that are non-zero in less than a share of the samples."""
    total = m.agg(F.count_distinct("sample").alias("total"))
    keep = m.groupBy("feature").agg(F.count_distinct(F.when(F.col("value") != 0, F.col("sample"))).alias("n")).crossJoin(F.broadcast(total)).filter(F.col("n") >= F.col("total") * share)
    return m.join(keep.select("feature"), "feature", "left_semi").select("sample", "feature", "value")


def ranked(value: str, by: list[str], ties: str = "min", descending: bool = False) -> Column:
    """Rank within by: ties share their least, greatest or average rank; or none."""
    order = F.desc(value) if descending else F.asc(value)
    w, same = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by, value)
    if ties == "none":
        return F.row_number().over(w)
    low, n = F.rank().over(w), F.count("*").over(same)
    return {"min": low, "max": low + n - 1, "average": low + (n - 1) / 2}[ties]


def binarised(m: DataFrame, q: float = 0.95) -> DataFrame:
    """1 at or above the feature's percentile, else 0."""
    cut = m.groupBy("feature").agg(F.percentile("value", q).alias("cut"))
    return m.join(cut, "feature").select("sample", "feature", (F.col("value") >= F.col("cut")).cast("int").alias("call"))


def robust_scaled(m: DataFrame) -> DataFrame:
    """Median 0 and interquartile range 1 by feature; a range of 0 divides by 1."""
    q = m.groupBy("feature").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    iqr = F.col("q")[2] - F.col("q")[0]
    return m.join(q, "feature").select("sample", "feature", ((F.col("value") - F.col("q")[1]) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)).alias("value"))


def quantile_normalised(m: DataFrame) -> DataFrame:
    """Each value replaced by the mean, over samples, of the values at its rank (ties share the least)."""
    own = Window.partitionBy("sample")
    r = m.withColumns({"k": F.row_number().over(own.orderBy("value", "feature")), "rank": F.rank().over(own.orderBy("value"))})
    mean = r.groupBy(F.col("k").alias("rank")).agg(F.avg("value").alias("mean"))
    return r.join(mean, "rank").select("sample", "feature", F.col("mean").alias("value"))


def ecdf_standardised(m: DataFrame) -> DataFrame:
    """The feature's empirical distribution, centred, against that of all cells by distinct value."""
    f = m.withColumn("p", F.cume_dist().over(Window.partitionBy("feature").orderBy("value")))
    f = f.withColumn("p", F.round(F.col("p") - F.avg("p").over(Window.partitionBy("feature")), 10))
    # the global distribution from counts of distinct values, so that no task sorts all cells
    counts = f.groupBy("p").agg(F.count("*").alias("n"))
    total = f.agg(F.count("*").alias("total"))
    cum = running_total(counts, "p", "n", "cum").crossJoin(F.broadcast(total))  # total: one row
    return f.join(cum.select("p", (F.col("cum") / F.col("total")).alias("value_")), "p").select("sample", "feature", F.col("value_").alias("value"))


def ternary(value: Column, low: float, high: float) -> Column:
    return F.when(value <= low, -1).when(value >= high, 1).otherwise(0)


def outliers(m: DataFrame, column: str = "value", method: str = "zscore", z: float = 3.0) -> DataFrame:
    """Rows beyond z population deviations above the mean, or outside one and a half interquartile ranges."""
    if method == "zscore":
        s = m.agg(F.avg(column).alias("mu"), F.stddev_pop(column).alias("sd"))
        return m.crossJoin(F.broadcast(s)).filter((F.col(column) - F.col("mu")) / F.col("sd") > z).select(*m.columns)
    s = m.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    return m.crossJoin(F.broadcast(s)).filter((F.col(column) < F.col("q")[0] - 1.5 * iqr) | (F.col(column) > F.col("q")[1] + 1.5 * iqr)).select(*m.columns)


def signature(m: DataFrame, n: int, up: bool, cutoff: float | None = None) -> DataFrame:
    """The n highest (lowest) features of each sample, beyond the cutoff if given; ties by feature."""
    if cutoff is not None:
        m = m.filter(F.col("value") >= cutoff if up else F.col("value") <= cutoff)
    w = Window.partitionBy("sample").orderBy(F.desc("value") if up else F.asc("value"), "feature")
    return m.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).drop("k")


def strongest(m: DataFrame, n: int) -> DataFrame:
    """The n values of largest magnitude by sample and direction."""
    w = Window.partitionBy("sample", F.col("value") > 0).orderBy(F.desc(F.abs("value")), "feature")
    return m.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).drop("k")


def threshold_or_top(m: DataFrame, sure: float, least: float, n: int) -> DataFrame:
    """Values of sure or more, and those of least or more while they are among the first n."""
    w = Window.partitionBy("sample").orderBy(F.desc("value"), "feature")
    return m.withColumn("k", F.row_number().over(w)).filter((F.col("value") >= sure) | ((F.col("value") >= least) & (F.col("k") <= n))).drop("k")


def top_share(m: DataFrame, share: float, by: str = "sample") -> DataFrame:
    """Values at least that of the share's last place, ties included."""
    w = Window.partitionBy(by)
    r = m.withColumns({"k": F.row_number().over(w.orderBy(F.desc("value"), "feature")), "n": F.count("*").over(w)})
    cut = F.max(F.when(F.col("k") == F.greatest(F.lit(1), F.floor(F.col("n") * share)), F.col("value"))).over(w)
    return r.withColumn("cut", cut).filter("value >= cut").drop("k", "n", "cut")


def waterfall(m: DataFrame, ternary_: bool = False, margin: float = 0.1, linear_margin: float = 0.1, exempt: float | None = 0.8, min_share: float = 0.01, max_share: float = 0.2, insensitive: float | None = 0.9, linear: float = 0.95) -> DataFrame:
    """Sensitivity calls by feature (lower is more sensitive): sample, feature, call.

    Sorted values that bend (correlation with their rank below linear) are cut at the place farthest from the chord,
    else at the median; a margin makes the cut stricter unless it is below exempt; at least min_share and at most
    max_share of the samples are called.
    """
    f = Window.partitionBy("feature")
    m = m.filter("value IS NOT NULL")
    r = m.withColumn("k", F.row_number().over(f.orderBy("value", "sample")))
    s = r.groupBy("feature").agg(F.count("*").alias("n"), F.abs(F.corr("k", "value")).alias("R"), F.min("value").alias("y1"), F.max("value").alias("yn"), F.median("value").alias("med"))
    r = r.join(s, "feature")
    chord = F.when(F.col("n") > 1, F.col("y1") + (F.col("yn") - F.col("y1")) * (F.col("k") - 1) / (F.col("n") - 1)).otherwise(F.col("y1"))
    knee = r.withColumn("d", F.round(F.abs(F.col("value") - chord), 9)).groupBy("feature").agg(F.max_by("value", F.struct("d", -F.col("k"))).alias("knee"))
    r = r.join(knee, "feature")
    bent = F.col("R") < linear
    cut = F.when(F.col("R").isNull() | F.isnan("R"), F.col("y1") - 1).when(bent, F.when(F.col("knee") == F.col("yn"), F.lit(0.0)).otherwise(F.col("knee"))).otherwise(F.col("med"))
    step = F.abs(cut * F.when(bent, margin).otherwise(linear_margin))
    free = bent & (cut < exempt) if exempt is not None else F.lit(False)
    low = F.when(free, cut).otherwise(cut - step)
    v = F.col("value")
    if ternary_:
        over = bent & (cut > exempt) if exempt is not None else F.lit(False)
        call = F.when(v < low, 1).when(v > F.when(over, cut).otherwise(cut + step), -1).otherwise(0)
    else:
        call = F.when(v < low, 1).otherwise(0)
    call = F.when(v >= insensitive, -1 if ternary_ else 0).otherwise(call) if insensitive is not None else call
    r = r.withColumn("call", call).withColumn("ones", F.sum((F.col("call") == 1).cast("int")).over(f))
    least, most = F.bround(F.col("n") * F.lit(min_share)), F.bround(F.col("n") * F.lit(max_share))
    call = F.when((F.col("ones") < least) & (F.col("k") <= least), 1).when((F.col("ones") > most) & (F.col("call") == 1) & (F.col("k") > most), 0).otherwise(F.col("call"))
    return r.select("sample", "feature", call.alias("call"))


def correlations(m: DataFrame, spearman: bool = False) -> DataFrame:
    """f1 < f2, r of every pair of features over their common samples; partial sums are combined before the shuffle."""
    if spearman:
        m = m.withColumn("value", ranked("value", ["feature"], "average").cast("double"))
    a, b = m.select("sample", F.col("feature").alias("f1"), F.col("value").alias("x")), m.select("sample", F.col("feature").alias("f2"), F.col("value").alias("y"))
    return a.join(b, "sample").filter("f1 < f2").groupBy("f1", "f2").agg(F.corr("x", "y").alias("r"))
