"""Relational operators on edge lists: canonical pairs, universes, id mapping, merging of datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .matrix import lines, met


def canonical(e: DataFrame, distinct: bool = True) -> DataFrame:
    """Undirected pairs with the lesser id first, without self loops."""
    out = e.filter("n1 <> n2").withColumns({"n1": F.least("n1", "n2"), "n2": F.greatest("n1", "n2")})
    return out.dropDuplicates(["n1", "n2"]) if distinct else out


def redundant_free(e: DataFrame, undirected: bool) -> DataFrame:
    """Distinct edges without self loops, canonical where the edge type is undirected."""
    e = e.select("n1", "n2")
    return canonical(e) if undirected else e.filter("n1 <> n2").distinct()


def in_universe(e: DataFrame, nodes1: DataFrame, nodes2: DataFrame) -> DataFrame:
    """Edges whose ends are both reference nodes (column code)."""
    return e.join(nodes1.select(F.col("code").alias("n1")), "n1", "left_semi").join(nodes2.select(F.col("code").alias("n2")), "n2", "left_semi").select(*e.columns)


def has_evidence(column: Column, allowed: Sequence[str], sep: str = ";") -> Column:
    """Whether a separated list holds any of the allowed values."""
    return F.size(F.array_intersect(F.split(column, sep), F.array(*[F.lit(a) for a in allowed]))) > 0


def map_ids(e: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """column replaced by every id it maps to (columns src, dst); unmapped rows go."""
    return e.join(mapping.select(F.col("src").alias(column), "dst"), column).withColumn(column, F.col("dst")).drop("dst").select(*e.columns)


def map_both(e: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both ends fanned out through mapping, then canonical distinct pairs."""
    return canonical(map_ids(map_ids(e.select("n1", "n2"), mapping, "n1"), mapping, "n2"))


def map_fallback(e: DataFrame, column: str, primary: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Ids through primary names, else through synonyms that are no primary name; rows without either go."""
    only = synonyms.join(primary.select("src"), "src", "left_anti")
    return map_ids(e, primary.select("src", "dst").unionByName(only.select("src", "dst")), column)


def map_updated(e: DataFrame, column: str, updates: DataFrame, mapping: DataFrame) -> DataFrame:
    """Outdated ids replaced first, then mapped."""
    new = e.join(updates.select(F.col("src").alias(column), F.col("dst").alias("new")), column, "left")
    return map_ids(new.withColumn(column, F.coalesce("new", column)).drop("new").select(*e.columns), mapping, column)


def resolve_names(e: DataFrame, column: str, primary: DataFrame, synonyms: DataFrame, conflicts: DataFrame, prefix: str) -> DataFrame:
    """Names to ids: ids with the prefix pass, names in conflict (raw or upper case) go, then upper-case primary names and synonyms."""
    raw, up = F.col(column), F.upper(column)
    c = conflicts.select(F.col("name").alias("c")).distinct()
    left = e.withColumn("up", up).join(c, raw == F.col("c"), "left_anti").join(c, F.col("up") == F.col("c"), "left_anti")
    p, s = primary.select(F.col("src").alias("up"), F.col("dst").alias("p")), synonyms.select(F.col("src").alias("up"), F.col("dst").alias("s"))
    out = left.join(p, "up", "left").join(s, "up", "left").withColumn(column, F.when(raw.startswith(prefix), raw).otherwise(F.coalesce("p", "s")))
    return out.filter(F.col(column).isNotNull()).select(*e.columns)


#: Id vocabularies in the order in which they are recognised.
VOCABULARIES = ("OMIM", "ORPHA", "DOID", "HP", "EFO", "UMLS", "MESH", "MEDDRA")


def normalise_id(column: Column) -> Column:
    """A prefixed id with the first vocabulary, in the fixed order, whose name the raw id holds; null if none."""
    out = None
    for v in VOCABULARIES:
        naked = F.regexp_replace(F.upper(column), f"^.*{v}[A-Z_]*[:_]?", "")
        hit = F.upper(column).contains(v)
        out = F.when(hit, F.concat(F.lit(v + ":"), naked)) if out is None else out.when(hit, F.concat(F.lit(v + ":"), naked))
    return out


def normalised(e: DataFrame, columns: Sequence[str], alt: DataFrame | None = None) -> DataFrame:
    """Raw ids of the columns normalised, alternative ids (alt: src, dst, both normalised) replaced by their term's; rows with an id of no known vocabulary go."""
    out = e
    for c in columns:
        out = out.withColumn(c, normalise_id(F.col(c))).filter(F.col(c).isNotNull())
        if alt is not None:
            one = alt.groupBy(F.col("src").alias(c)).agg(F.min("dst").alias("__main"))
            out = out.join(one, c, "left").withColumn(c, F.coalesce("__main", c)).drop("__main")
    return out.select(*e.columns)


def cross_references(sources: Mapping[str, DataFrame], alt: DataFrame | None = None) -> DataFrame:
    """source, n1, n2: the pairs of several sources through one normalisation, each once a source, without pairs of an id with itself."""
    out = None
    for name, pairs in sources.items():
        rows = normalised(pairs.select("n1", "n2"), ["n1", "n2"], alt).filter("n1 <> n2").distinct().select(F.lit(name).alias("source"), "n1", "n2")
        out = rows if out is None else out.unionByName(rows)
    return out


def to_reference(e: DataFrame, mapping: DataFrame, column: str, keep_prefix: str) -> DataFrame:
    """Foreign ids to reference ids (src, dst); ids with the reference prefix pass, others without a mapping go."""
    met = e.join(mapping.select(F.col("src").alias(column), "dst"), column, "left")
    value = F.coalesce("dst", F.when(F.col(column).startswith(keep_prefix), F.col(column)))
    return met.withColumn(column, value).filter(F.col(column).isNotNull()).select(*e.columns)


def preferred_xref(rows: DataFrame, key: str, xref: str, order: Sequence[str]) -> DataFrame:
    """One cross reference for each key: the least by the vocabularies' order, then by id."""
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.split(F.col(xref), ":")[0])
    return rows.withColumn("rank", rank).filter("rank > 0").groupBy(key).agg(F.min(F.struct("rank", xref)).alias("x")).select(key, f"x.{xref}")


def merge_conservative(e: DataFrame) -> DataFrame:
    """Of datasets by ordinal, the first with a positive weight wins (columns n1, n2, w, ordinal)."""
    return e.filter("w > 0").groupBy("n1", "n2").agg(F.min_by("w", "ordinal").alias("w"))


def merge_sum(e: DataFrame) -> DataFrame:
    return e.groupBy("n1", "n2").agg(F.sum("w").alias("w"))


def evidence_count(e: DataFrame) -> DataFrame:
    return e.groupBy("n1", "n2").agg(F.count("*").alias("n"))


def geometric_mean(column: str) -> Column:
    return F.exp(F.avg(F.log(column)))


def congruent(e: DataFrame, sign: str = "sign") -> DataFrame:
    """Pairs seen with one sign only."""
    return e.groupBy("n1", "n2").agg(F.min(sign).alias(sign), F.max(sign).alias("other")).filter(f"{sign} = other").drop("other")


def replicate_agreement(e: DataFrame, replicate: str, count: int) -> DataFrame:
    """Pairs called in every one of count replicates."""
    return e.select("n1", "n2", replicate).distinct().groupBy("n1", "n2").agg(F.count("*").alias("k")).filter(F.col("k") == count).drop("k")


def member_pairs(members: DataFrame, group: str, member: str) -> DataFrame:
    """Distinct pairs of members of one group; groups are lists of bounded size, so the pairs of one are few."""
    m = members.select(F.col(group).alias("g"), F.col(member).alias("m")).distinct()
    return m.alias("a").join(m.alias("b"), "g").filter("a.m < b.m").select(F.col("a.m").alias("n1"), F.col("b.m").alias("n2")).distinct()


def majority_direction(rows: DataFrame, keys: Sequence[str], preferred: str) -> DataFrame:
    """Of statistics (t, p, dataset) of one key: the preferred dataset's; else the mean t if signs tie; else the least p's t of the majority sign."""
    up, down = F.sum((F.col("t") > 0).cast("int")), F.sum((F.col("t") < 0).cast("int"))
    g = rows.groupBy(*keys).agg(F.min(F.when(F.col("dataset") == preferred, F.struct("p", "t"))).alias("pre"), up.alias("up"), down.alias("down"), F.avg("t").alias("mean"), F.min(F.when(F.col("t") > 0, F.struct("p", "t"))).alias("best_up"), F.min(F.when(F.col("t") < 0, F.struct("p", "t"))).alias("best_down"))
    t = F.coalesce(F.col("pre.t"), F.when(F.col("up") == F.col("down"), F.col("mean")).when(F.col("up") > F.col("down"), F.col("best_up.t")).otherwise(F.col("best_down.t")))
    return g.select(*keys, t.alias("t"))


def bridged(hops: Sequence[DataFrame]) -> list[DataFrame]:
    """Each hop without the edges that don't go on to the next, nor come from the one before; left to right."""
    out = [hops[0]]
    for nxt in hops[1:]:
        out[-1] = out[-1].join(nxt.select(F.col("n1").alias("n2")), "n2", "left_semi").select("n1", "n2")
        out.append(nxt.join(out[-1].select(F.col("n2").alias("n1")), "n1", "left_semi").select("n1", "n2"))
    return out


def bridge_paths(a: DataFrame, b: DataFrame, paths: int | None = 1, least: int = 1) -> DataFrame:
    """Hops composed over the node between; pairs with exactly so many paths, or with paths None at least so many."""
    far = met(a.select("n1", "n2"), "n1", "n2", lines(b.select(F.col("n1").alias("n2"), F.col("n2").alias("n3")), "n2", "n3"))
    n = far.select("n1", F.explode("n3").alias("n2")).groupBy("n1", "n2").agg(F.count("*").alias("n"))
    return n.filter(F.col("n") == paths if paths is not None else F.col("n") >= least).select("n1", "n2")


def first_by_order(e: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """Canonical pairs with the value of their first occurrence."""
    return e.withColumns({"a": F.least("n1", "n2"), "b": F.greatest("n1", "n2")}).groupBy(F.col("a").alias("n1"), F.col("b").alias("n2")).agg(F.min_by(value, F.struct(*order)).alias(value))


def carried_forward(lines: DataFrame, by: str, value: Column) -> Column:
    """The last non-null value up to this line, for flat files whose headers hold for the lines below."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy("line"))
