"""Hierarchies: closure, propagation and its inverse, information content."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaweave.session import drop, saved


def _reached(h: DataFrame, limit: int) -> DataFrame:
    """node, anc: every pair joined by a path of one step or more, by doubling path lengths; a node of a cycle reaches itself."""
    known = saved(h, "closure")
    n = known.count()
    for _ in range(limit):
        step = known.join(known.select(F.col("node").alias("anc"), F.col("anc").alias("top")), "anc").select("node", F.col("top").alias("anc"))
        old, known = known, saved(known.unionByName(step).distinct(), "closure")
        drop(old)
        if (m := known.count()) == n:
            break
        n = m
    return known


def cyclic(h: DataFrame, limit: int = 64) -> DataFrame:
    """node, part: the terms (child, parent) that lie on a cycle, and the least term of their strongly connected part: terms that reach each other."""
    h = h.select(F.col("child").alias("node"), F.col("parent").alias("anc")).filter("node <> anc").distinct()
    known = _reached(h, limit)
    back = known.select(F.col("anc").alias("node"), F.col("node").alias("anc"))
    return known.join(back, ["node", "anc"]).groupBy("node").agg(F.min("anc").alias("part"))


def closure(h: DataFrame, limit: int = 64, cycles: str = "raise") -> DataFrame:
    """node, anc: every ancestor, the node itself included.

    A cycle raises an error; with cycles="skip" its terms are skipped with a warning, with their own links, and the rest is closed.
    """
    h = h.select(F.col("child").alias("node"), F.col("parent").alias("anc")).filter("node <> anc").distinct()
    known = _reached(h, limit)
    loops = saved(known.filter("node = anc").select("node"), "cyclic")
    if n := loops.count():
        if cycles != "skip":
            raise ValueError("the hierarchy has a cycle")
        warnings.warn(f"{n} terms lie on cycles and are skipped", stacklevel=2)
        h = h.join(loops, "node", "left_anti").join(loops.select(F.col("node").alias("anc")), "anc", "left_anti").select("node", "anc")
        known = _reached(h, limit)
    ids = h.select("node").unionByName(h.select(F.col("anc").alias("node"))).distinct()
    return known.unionByName(ids.select("node", F.col("node").alias("anc")))


def descendants(c: DataFrame, tops: Sequence[str], skip: Sequence[str] = (), with_tops: bool = True) -> DataFrame:
    """Nodes below any of tops, without the whole subtrees of skip."""
    out = c.filter(F.col("anc").isin(list(tops))).select("node").distinct()
    if skip:
        out = out.join(c.filter(F.col("anc").isin(list(skip))).select("node"), "node", "left_anti")
    return out if with_tops else out.filter(~F.col("node").isin(list(tops)))


def propagate(e: DataFrame, c1: DataFrame | None = None, c2: DataFrame | None = None) -> DataFrame:
    """Every edge also at the ancestors of its ends; an end outside its closure stays."""
    for side, c in (("n1", c1), ("n2", c2)):
        if c is not None:
            e = e.join(c.select(F.col("node").alias(side), "anc"), side, "left").withColumn(side, F.coalesce("anc", side)).drop("anc")
    return e.select("n1", "n2").distinct()


def depropagate(e: DataFrame, c1: DataFrame | None = None, c2: DataFrame | None = None) -> DataFrame:
    """Only the most specific edges: none has another edge with both ends at or below its own."""
    e = e.select("n1", "n2").distinct()
    up = e.withColumns({"a1": F.col("n1"), "a2": F.col("n2")})
    for side, c in (("a1", c1), ("a2", c2)):
        if c is not None:
            up = up.join(c.select(F.col("node").alias(side), "anc"), side, "left").withColumn(side, F.coalesce("anc", side)).drop("anc")
    covered = up.filter("a1 <> n1 OR a2 <> n2").select(F.col("a1").alias("n1"), F.col("a2").alias("n2")).distinct()
    return e.join(covered, ["n1", "n2"], "left_anti")


def dispatch(e: DataFrame, c1: DataFrame, c2: DataFrame, strict: bool = True) -> DataFrame:
    """Propagation on both sides where any edge is covered on n1 and any on n2: then edges covered on one side only are
    dropped (strict) or propagated there; edges covered on neither side pass."""
    i, j = (c.select(F.col("node").alias(s)).distinct().withColumn(f"in{s}", F.lit(True)) for s, c in (("n1", c1), ("n2", c2)))
    hit = e.select("n1", "n2").distinct().join(i, "n1", "left").join(j, "n2", "left").withColumns({s: F.coalesce(s, F.lit(False)) for s in ("inn1", "inn2")})
    any_ = hit.agg(F.max("inn1").alias("any1"), F.max("inn2").alias("any2"))
    hit = hit.crossJoin(F.broadcast(any_))  # one row of flags
    drop = F.lit(strict) & F.col("any1") & F.col("any2") & (F.col("inn1") != F.col("inn2"))
    return propagate(hit.filter(~drop).select("n1", "n2"), c1, c2)


def vocabularies(closures: Mapping[str, DataFrame]) -> DataFrame:
    """otgy, node, anc: the closures of several vocabularies as one table."""
    out = [c.select(F.lit(name).alias("otgy"), "node", "anc") for name, c in closures.items()]
    rows = out[0]
    for c in out[1:]:
        rows = rows.unionByName(c)
    return rows


def of_kind(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """node, anc of the vocabularies of a node type; a node in several has the ancestors of each, so dispatch and propagate meet every pair of vocabularies at once."""
    return table.filter(F.col("otgy").isin(list(names))).select("node", "anc").distinct()


def by_vocabulary(e: DataFrame, side: str, table: DataFrame) -> DataFrame:
    """otgy, n1, n2: edges at each vocabulary that holds their end, with a null otgy where none does."""
    own = table.select("otgy", F.col("node").alias(side)).distinct()
    return e.select("n1", "n2").distinct().join(own, side, "left").select("otgy", "n1", "n2")


def leaf_counts(c: DataFrame) -> DataFrame:
    """node, leaves below or at it, subsumers above it, hyponyms below it."""
    strict = c.filter("node <> anc")
    leaves = c.select("node").distinct().join(strict.select(F.col("anc").alias("node")).distinct(), "node", "left_anti")
    below = c.join(leaves, "node").groupBy(F.col("anc").alias("node")).agg(F.count("*").alias("leaves"))
    up = strict.groupBy("node").agg(F.count("*").alias("subsumers"))
    down = strict.groupBy(F.col("anc").alias("node")).agg(F.count("*").alias("hyponyms"))
    out = c.select("node").distinct().join(below, "node", "left").join(up, "node", "left").join(down, "node", "left")
    return out.select("node", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("leaves", "subsumers", "hyponyms")])


def information_content(c: DataFrame) -> DataFrame:
    """node, seco, sanchez; a root counts as having one subsumer."""
    n = leaf_counts(c)
    total = n.agg(F.count("*").alias("terms"), F.sum((F.col("hyponyms") == 0).cast("int")).alias("max_leaves"))
    n = n.crossJoin(F.broadcast(total))  # one row of totals
    seco = 1 - F.log(F.col("hyponyms") + 1) / F.log("terms")
    sanchez = -F.log((F.col("leaves") / F.greatest("subsumers", F.lit(1)) + 1) / (F.col("max_leaves") + 1))
    return n.select("node", seco.alias("seco"), sanchez.alias("sanchez"))


def youngest(nodes: DataFrame, c: DataFrame) -> DataFrame:
    """The nodes of a set that have no descendant in it."""
    up = nodes.join(c, "node").filter("node <> anc").select(F.col("anc").alias("node"))
    return nodes.join(up, "node", "left_anti")


@dataclass(frozen=True)
class Rule:
    """Which terms of one vocabulary are nodes of a type: those below roots (all terms without any), of a namespace if one is named, without whole subtrees."""

    kind: str
    vocabulary: str
    roots: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()
    namespace: str | None = None
    with_roots: bool = True


def universes(rules: Sequence[Rule], table: DataFrame, spaces: DataFrame | None = None) -> DataFrame:
    """kind, nd: the union of the rules' terms by type; table: otgy, node, anc (closures), spaces: node, namespace.

    A rule for a vocabulary or root that the table lacks gives no term; a term under several rules of a type counts once.
    """
    if not rules:
        return table.select(F.lit("").alias("kind"), F.col("node").alias("nd")).limit(0)
    out = None
    for r in rules:
        own = table.filter(F.col("otgy") == r.vocabulary).select("node", "anc")
        nd = descendants(own, r.roots, r.skip, r.with_roots) if r.roots else own.select("node").distinct()
        if r.skip and not r.roots:
            nd = nd.join(own.filter(F.col("anc").isin(list(r.skip))).select("node"), "node", "left_anti")
        if r.namespace is not None:
            nd = nd.join(spaces.filter(F.col("namespace") == r.namespace).select("node"), "node", "left_semi")
        nd = nd.select(F.lit(r.kind).alias("kind"), F.col("node").alias("nd"))
        out = nd if out is None else out.unionByName(nd)
    return out.distinct()
