"""Negative pairs with the degrees of the positive ones, by swapping the ends of pairs of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metaweave.session import drop, saved

from .numbering import drawn, nth_free, numbered

#: Edges that are dealt into one bucket and paired there.
BUCKET = 4096
#: Partners that an edge proposes a swap to in one round, once edges left over meet those swapped before.
PARTNERS = 4
#: Edges left over whose swaps are sent to the pairs known, instead of all those being shuffled.
FEW = 100_000
#: A prime far above any number of nodes, so that steps of its remainder meet every place once.
STRIDE = (1 << 61) - 1


def _pair(a, b, undirected: bool):
    return F.struct(F.least(a, b).alias("n1"), F.greatest(a, b).alias("n2")) if undirected else F.struct(a.alias("n1"), b.alias("n2"))


def _mates(pool: DataFrame, done: DataFrame | None, n: int, n_done: int, seed: int, k: int) -> DataFrame:
    """a, b: edges of the pool paired by draws among themselves; with done, each with some edges of the pool and of a drawn part of done."""
    share = min(1.0, (2 * PARTNERS * n + BUCKET) / max(1, n_done)) if done is not None else 0.0
    buckets = F.lit(int(-(-(n + share * n_done) // BUCKET)))
    order = F.xxhash64(F.lit(seed), F.lit(k), F.lit("order"), "n1", "n2")
    dealt = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "n1", "n2"), buckets)).withColumn("order", order)
    w = Window.partitionBy("bucket").orderBy("order", "n1", "n2")
    edge = F.struct("n1", "n2")
    if done is None:
        rows = dealt(pool).withColumn("i", F.row_number().over(w) - 1)
        two = rows.groupBy("bucket", F.floor(F.col("i") / 2).alias("pair")).agg(F.max(F.when(F.col("i") % 2 == 0, edge)).alias("a"), F.max(F.when(F.col("i") % 2 == 1, edge)).alias("b"))
        return two.filter("b IS NOT NULL").select("a", "b")
    done = done.filter(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), F.lit("met"), "n1", "n2"), 2) <= int(share * (1 << 62)))
    rows = dealt(pool).select("bucket", F.row_number().over(w).alias("i"), edge.alias("a"))
    many = F.count("*").over(Window.partitionBy("bucket"))
    others = dealt(pool.unionByName(done)).select("bucket", (F.row_number().over(w) - 1).alias("j"), many.alias("many"), edge.alias("b"))
    size = others.select("bucket", "many").distinct()
    each = rows.join(size, "bucket").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(PARTNERS - 1)))).withColumn("j", (F.col("i") * PARTNERS + F.col("t")) % F.col("many"))
    return each.join(others.drop("many"), ["bucket", "j"]).filter("a <> b").select("a", "b").distinct()


def _exchanged(mates: DataFrame, undirected: bool) -> DataFrame:
    """mates with the new pairs x and y, which need not be written."""
    return mates.withColumns({"x": _pair(F.col("a.n1"), F.col("b.n2"), undirected), "y": _pair(F.col("b.n1"), F.col("a.n2"), undirected)})


def _accepted(mates: DataFrame, known: list[DataFrame], undirected: bool, alone: bool, few: bool) -> DataFrame:
    """a, b: swaps whose new pairs x and y are no loops and not known, no two of which use one edge or make one pair.

    A swap goes by a number while its pairs and edges are shuffled. alone: no edge is in two of the mates; few: the mates
    can be broadcast.
    """
    new = _exchanged(mates, undirected).filter("x.n1 <> x.n2 AND y.n1 <> y.n2 AND x <> y")
    new = saved(new.select("a", "b").withColumn("id", F.monotonically_increasing_id()), "new")  # numbers have to stay
    new = _exchanged(new, undirected).withColumn("turn", F.xxhash64("a", "b"))
    pairs = new.select("id", "turn", F.explode(F.array("x", "y")).alias("z")).select("id", "turn", "z.n1", "z.n2")
    ends = pairs
    for other in known:
        other = other.select("n1", "n2")
        other = other.join(F.broadcast(pairs.select("n1", "n2").distinct()), ["n1", "n2"], "left_semi") if few else other
        ends = ends.join(other, ["n1", "n2"], "left_anti")
    if not alone:  # a swap that cannot be made takes no edge from others
        ends = saved(ends, "ends")
        ends = ends.join(ends.groupBy("id").agg(F.count("*").alias("n")).filter("n = 2").select("id"), "id")
    # of the swaps that want one edge or pair the first in turn has it; a swap is made if it has all
    one = F.min(F.struct("turn", "id")).alias("one")
    has = ends.groupBy("n1", "n2").agg(one).select("one")
    if not alone:
        free = new.join(ends.select("id").distinct(), "id").select("id", "turn", F.explode(F.array("a", "b")).alias("z")).select("id", "turn", "z.n1", "z.n2")
        has = has.unionByName(free.groupBy("n1", "n2").agg(one).select("one"))
    made = has.groupBy(F.col("one.id").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") == (2 if alone else 4)).select("id")
    return new.join(made, "id").select("a", "b")


def swapped(e: DataFrame, tries: int = 20, seed: int = 1, undirected: bool = False, banned: DataFrame | None = None, fill: bool = True) -> DataFrame:
    """n1, n2, exact: as many pairs as e has distinct edges, none of them in e or banned, no loop and none twice, where there are so many.

    In each round the edges left are dealt into buckets and paired by draws; two edges whose ends, exchanged, are two new
    pairs leave, so every node keeps its degree (exact). Once a round takes less than half of those left, edges left over
    also meet pairs made before: such a pair gives way to two new ones. With fill, an edge that no round could swap keeps
    its first end and takes another second end: first drawn among the ends of all edges, so by degree, then any that the
    first end has free, so an edge is only left out where its first end has none. A null end, a loop or a repeated edge is
    left out of e first. Draws are hashes of their round and edge: reruns agree.
    """
    own = lambda df: df.select(_pair(F.col("n1"), F.col("n2"), undirected).alias("x")).select("x.*")
    start = saved(own(e.select("n1", "n2").filter("n1 IS NOT NULL AND n2 IS NOT NULL AND n1 <> n2")).distinct(), "edges")
    known = [start] if banned is None else [start, saved(own(banned).distinct(), "banned")]
    pool, n, done, plain = start, start.count(), None, True
    total = n
    for k in range(tries):
        if not n or (done is None and n < 2):
            break
        alone, few = plain or done is None, n <= FEW
        got = saved(_accepted(_mates(pool, None if alone else done, n, total - n, seed, k), known if done is None else [*known, done], undirected, alone, few), "swaps")
        used = got.select(F.explode(F.array("a", "b")).alias("z")).select("z.*")
        used = F.broadcast(used) if few else used
        made = _exchanged(got, undirected).select(F.explode(F.array("x", "y")).alias("z")).select("z.*")
        old, before, left = (pool, done), done, n
        pool = saved(pool.join(used, ["n1", "n2"], "left_anti"), "pool")
        done = saved(made if before is None else before.join(used, ["n1", "n2"], "left_anti").unionByName(made), "done")
        n = pool.count()
        plain = plain and 2 * n < left
        drop(*[t for t in old if t is not None and t is not start], got)
    out = start.limit(0) if done is None else done
    out = out.withColumn("exact", F.lit(True))
    return out.unionByName(_filled(start, pool, known if done is None else [*known, done], seed, undirected).withColumn("exact", F.lit(False))) if fill and n else out


def _filled(start: DataFrame, left: DataFrame, known: list[DataFrame], seed: int, undirected: bool, draws: int = 3) -> DataFrame:
    """n1, n2: a new pair for every edge left whose first end has a free one."""
    ends = saved(numbered(start, ["n1", "n2"], "place").select("place", F.col("n2").alias("end")), "ends")
    total, made, k = ends.count(), [], 0
    nodes = saved(ends.select(F.col("end").alias("nd")).distinct(), "nodes")
    while True:
        if k < draws:
            asked = left.withColumn("place", F.pmod(drawn(F.lit(seed), F.lit("fill"), F.lit(k), F.col("n1"), F.col("n2")), F.lit(total)))
            new = asked.join(ends, "place")
        else:
            taken = known[0]
            for t in [*known[1:], *made]:
                taken = taken.unionByName(t)
            taken = taken.unionByName(taken.select(F.col("n2").alias("n1"), F.col("n1").alias("n2"))) if undirected else taken
            taken = taken.select("n1", F.col("n2").alias("nd")).unionByName(left.select("n1", F.col("n1").alias("nd")))
            asked = left.withColumn("i", F.row_number().over(Window.partitionBy("n1").orderBy("n2")) - 1)
            place = lambda free: F.when(F.col("i") < free, (drawn(F.lit(seed), F.col("n1")) + F.col("i") * (F.lit(STRIDE) % free)) % free)
            new = nth_free(taken, nodes, asked, place).withColumnRenamed("nd", "end")
        new = new.select(F.struct("n1", "n2").alias("old"), _pair(F.col("n1"), F.col("end"), undirected).alias("x")).select("old", "x.*").filter("n1 <> n2")
        for t in [*known, *made]:
            new = new.join(t.select("n1", "n2"), ["n1", "n2"], "left_anti")
        new = saved(new.groupBy("n1", "n2").agg(F.min("old").alias("old")), "filled")
        if not new.isEmpty():
            made.append(new.select("n1", "n2"))
            left = saved(left.join(new.select("old.*"), ["n1", "n2"], "left_anti"), "left")
        # once each asks for pairs of its own, a round without any new one, or without any left, is the last
        if left.isEmpty() or (k >= draws and new.isEmpty()):
            break
        k += 1
    out = start.limit(0)
    for m in made:
        out = out.unionByName(m)
    return out
