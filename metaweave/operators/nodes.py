"""Nodes by themselves: universes, vocabularies, groups of nodes as nodes, vectors put to lists, near-duplicate vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metaweave.session import saved

from .components import components
from .evaluate import dot
from .matrix import lines, met


def universe(sources: Mapping[str, Sequence[DataFrame]]) -> DataFrame:
    """kind, nd: the nodes of every type, each the union of its vocabularies (frames of nd)."""
    rows = [d.select(F.lit(kind).alias("kind"), "nd") for kind, frames in sources.items() for d in frames]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.filter("nd IS NOT NULL").distinct()


def renamed(df: DataFrame, column: str, names: Mapping[str, str]) -> DataFrame:
    """Values that names holds replaced, others as they are."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn(column, F.coalesce(table[F.col(column)], F.col(column)))


def latest_names(df: DataFrame, column: str, changes: DataFrame) -> DataFrame:
    """Codes followed through changes (old, new, year) in the order of years; a code is renamed by each later change in turn."""
    years = [r.year for r in changes.select("year").distinct().orderBy("year").collect()]  # a row a year
    for y in years:
        step = changes.filter(F.col("year") == y).select(F.col("old").alias(column), "new")
        df = df.join(step, column, "left").withColumn(column, F.coalesce("new", column)).drop("new").select(df.columns)
    return df


def joined_labels(df: DataFrame, by: Sequence[str], label: str, sep: str = "|") -> DataFrame:
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(label)), sep).alias(label))


def hyper_nodes(members: DataFrame, group: str, member: str, prefix: str = "PGN", least: int = 2) -> DataFrame:
    """group, node: groups of so many members or more as nodes named by a hash of their sorted members, so equal groups are one node."""
    return _named(members, group, member, prefix, least).select(group, "node")


def _named(members: DataFrame, group: str, member: str, prefix: str, least: int) -> DataFrame:
    """group, m, node: each group's sorted members and the name of their node."""
    g = members.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("m")).filter(F.size("m") >= least)
    return g.withColumn("node", F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.array_join("m", "|"), 256), 1, 16)))


def perturbations(members: DataFrame, group: str, member: str, hits: DataFrame, cell: str, prefix: str = "PGN") -> DataFrame:
    """metaedge, n1, n2: groups of members as nodes with their edges: to each member (`has`) and to every cell (`hits`) that any member hits.

    hits: member, cell. Equal groups are one node with the edges of either; a null member or cell has no edge.
    """
    known = members.select(F.col(group).alias("__g"), F.col(member).alias("__m")).filter("__g IS NOT NULL AND __m IS NOT NULL")
    sets = _named(known, "__g", "__m", prefix, 1).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set("m"))).alias("m"))
    own = saved(sets.select(F.col("node").alias("n1"), F.explode("m").alias("__m")), "members")
    cells = hits.select(F.col(member).alias("__m"), F.col(cell).alias("n2")).filter("__m IS NOT NULL AND n2 IS NOT NULL").distinct()
    # cells travel to a node in the lists of its members, and are told apart where the node is
    to = met(own, "n1", "__m", lines(cells, "__m", "n2")).select("n1", F.explode("n2").alias("n2")).distinct().select(F.lit("hits").alias("metaedge"), "n1", "n2")
    return own.select(F.lit("has").alias("metaedge"), "n1", F.col("__m").alias("n2")).unionByName(to)


def crowded(df: DataFrame, by: str, least: int = 2) -> DataFrame:
    """The rows of groups of so many rows or more."""
    keep = df.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return df.join(keep.select(by), by, "left_semi").select(df.columns)


def largest_component(e: DataFrame) -> DataFrame:
    """The edges of the largest component; of equal ones that with the least id."""
    comp = components(e.select(F.col("n1").alias("a"), F.col("n2").alias("b")))
    best = comp.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return e.join(comp.join(best, "component", "left_semi").select(F.col("node").alias("n1")), "n1", "left_semi").select(e.columns)


def until_covered(comp: DataFrame, share: float = 0.9) -> DataFrame:
    """component, n, number: components by size until those before cover a share of the nodes."""
    s = comp.groupBy("component").agg(F.count("*").alias("n"))
    sizes = s.groupBy("n").agg(F.count("*").alias("m"))  # as few rows as there are sizes
    total = sizes.agg(F.sum(F.col("n") * F.col("m")).alias("total"))
    larger = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    heads = sizes.select("n", F.coalesce(F.sum(F.col("n") * F.col("m")).over(larger), F.lit(0)).alias("nodes"), F.coalesce(F.sum("m").over(larger), F.lit(0)).alias("ahead")).crossJoin(F.broadcast(total))
    r = s.join(F.broadcast(heads.filter(F.col("nodes") < F.lit(share) * F.col("total"))), "n").withColumn("k", F.row_number().over(Window.partitionBy("n").orderBy("component")))
    return r.filter((F.col("nodes") + (F.col("k") - 1) * F.col("n")) < F.lit(share) * F.col("total")).select("component", "n", (F.col("ahead") + F.col("k")).alias("number"))


def neighbour_lists(e: DataFrame, undirected: bool = True) -> DataFrame:
    """nd, neighbours, weights: in the order of ids."""
    both = e.select("n1", "n2", "w")
    both = both.unionByName(e.select(F.col("n2").alias("n1"), F.col("n1").alias("n2"), "w")) if undirected else both
    g = both.groupBy(F.col("n1").alias("nd")).agg(F.array_sort(F.collect_list(F.struct("n2", "w"))).alias("x"))
    return g.select("nd", F.col("x.n2").alias("neighbours"), F.col("x.w").alias("weights"))


def metaedges(edges: Sequence[DataFrame], every: bool = False) -> DataFrame:
    """Pairs of any of the edge lists, or of all of them."""
    out = edges[0].select("n1", "n2")
    for e in edges[1:]:
        out = out.intersect(e.select("n1", "n2")) if every else out.unionByName(e.select("n1", "n2"))
    return out.distinct()


def indented(lines: DataFrame, mark: str = "-", step: int = 2) -> DataFrame:
    """child, parent of lines (doc, line, text) indented by marks: the parent is the last line before, one step less deep."""
    depth = F.length("text") - F.length(F.ltrim(F.col("text"), F.lit(mark)))
    rows = lines.select("doc", "line", (depth / step).cast("int").alias("depth"), F.ltrim(F.col("text"), F.lit(mark)).alias("child"))
    deepest = rows.agg(F.max("depth").alias("d")).first().d or 0
    own = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.coalesce(*[F.when(F.col("depth") == k, F.last(F.when(F.col("depth") == k - 1, F.col("child")), ignorenulls=True).over(own)) for k in range(1, deepest + 1)]) if deepest else F.lit(None).cast("string")
    return rows.withColumn("parent", parent).filter("parent IS NOT NULL").select("child", "parent")


def over_placebo(rows: DataFrame, cutoff: tuple[float, float], margin: tuple[float, float]) -> DataFrame:
    """drug, effect, mean: effects whose mean of median bounds reaches a cutoff and, where there is a placebo arm, that arm's by more than a margin.

    rows: drug, effect, placebo (boolean), low, high. A drug without any effect is tried again with the second cutoff and margin.
    """
    mean = lambda placebo: (F.median(F.when(F.col("placebo") == placebo, F.col("low"))) + F.median(F.when(F.col("placebo") == placebo, F.col("high")))) / 2
    g = rows.groupBy("drug", "effect").agg(mean(False).alias("mean"), mean(True).alias("other")).filter("mean IS NOT NULL")
    ok = lambda k: (F.col("mean") >= cutoff[k]) & (F.col("other").isNull() | (F.col("mean") > F.col("other") + margin[k]))
    first = F.max(ok(0).cast("int")).over(Window.partitionBy("drug"))
    return g.withColumn("first", first).filter(F.when(F.col("first") == 1, ok(0)).otherwise(ok(1))).select("drug", "effect", "mean")


def realigned(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """kind, id, nd, v: the vectors of a list of nodes (kind, id, nd), null where a node has none."""
    return nodes.select("kind", "id", "nd").join(vectors.select("nd", "v"), "nd", "left").select("kind", "id", "nd", "v")


def joined_vectors(rows: DataFrame, vectors: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows whose every label has a vector, with these end to end as v."""
    parts = []
    for k, c in enumerate(columns):
        rows = rows.join(vectors.select(F.col("nd").alias(c), F.col("v").alias(f"__v{k}")), c)
        parts.append(f"__v{k}")
    return rows.withColumn("v", F.concat(*parts)).drop(*parts)


def sign_bits(v: Column, dims: int, bits: int = 16, seed: int = 1) -> Column:
    """A number of sign bits of v on hyperplanes whose entries, +1 or -1, come from a hash of place and bit."""
    planes = [F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i, b=b: F.when(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(b)), i.cast("string"))), 1, 1) < "8", 1.0).otherwise(-1.0)) for b in range(bits)]
    return sum((F.when(dot(v, p) >= 0, 1 << b).otherwise(0) for b, p in enumerate(planes)), F.lit(0))


def without_near_duplicates(vectors: DataFrame, dims: int, most: int = 10, distance: float = 0.5, bits: int = 16, seed: int = 1) -> DataFrame:
    """nd, kept: equal vectors keep their least id; of a bucket of sign bits with more than most members, whose median cosine distance from their mean direction is at most distance, one stays, the least id.

    The median is of each member against the bucket's mean direction, so buckets of any size need no pairs.
    """
    one = vectors.groupBy("v").agg(F.min("nd").alias("nd"))
    one = one.withColumn("bucket", sign_bits(F.col("v"), dims, bits, seed))
    unit = F.transform("v", lambda x: x.cast("double") / F.sqrt(dot(F.col("v"), F.col("v"))))
    sums = [F.sum(F.get(unit, F.lit(i))).alias(f"s{i}") for i in range(dims)]
    mean = one.groupBy("bucket").agg(F.count("*").alias("members"), *sums).filter(F.col("members") > most).select("bucket", F.array(*[f"s{i}" for i in range(dims)]).alias("mean"))
    off = one.join(mean, "bucket").withColumn("d", 1 - dot(F.col("v"), F.col("mean")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("mean"), F.col("mean"))))
    dense = off.groupBy("bucket").agg(F.median("d").alias("d"), F.min("nd").alias("stays")).filter(F.col("d") <= distance).select("bucket", "stays")
    kept = one.join(dense, "bucket", "left").filter("stays IS NULL OR stays = nd").select("nd", F.lit(True).alias("yes"))
    return vectors.select("nd").join(kept, "nd", "left").select("nd", F.coalesce("yes", F.lit(False)).alias("kept"))


def walk_check(walks: DataFrame, sources: DataFrame, reps: int) -> DataFrame:
    """nd, n: sources whose number of walks is not reps; no row if the corpus is whole."""
    n = walks.groupBy(F.col("start").alias("nd")).agg(F.count("*").alias("n"))
    return sources.select("nd").distinct().join(n, "nd", "left").select("nd", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") != reps)


def walker_bytes(e: DataFrame) -> DataFrame:
    """One row: bytes that second-order walks would take, 16 for an edge and each pair of a step and its next."""
    d = e.select(F.explode(F.array("n1", "n2")).alias("nd")).groupBy("nd").agg(F.count("*").alias("d"))
    return d.agg((F.sum(F.col("d") * 16) + F.sum(F.col("d") * F.col("d") * 16)).alias("bytes"))
