"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors of a label are one class from the start. The classes of a label are dealt into overlapping cluster shards
of bounded size: centres are drawn by hash from each shard that is too large, every class joins its nearest few, and so
on until all shards fit. Centres that are near-duplicates of each other count once; a shard that centres don't divide is
cut into blocks by hash, and every two blocks make a shard, so that all its pairs meet. Each shard builds a flat graph by robust pruning; the adjacency lists a class got in its shards
are united, and every member of a shard searches the united graph from its own node and the shard's medoid: greedily for
a fixed number of expansions, then as long as anything within the range is unexpanded. The shard's tree of strongest
links is part of its graph and every edge is walked both ways, so no group of near vectors cuts it in parts. Pairs found are verified by cosine in double
precision. A pair met in several shards counts in the least of them, so numbers of links are summed, never listed, and
each shard hands on one edge a member at most for the components.

Centres are fitted on a bounded sample, in rounds of at most most_centres; every row is indexed. audit() measures recall against
brute force.

Defined cases: rows with a null id, label or vector, with a null or non-finite component or a zero vector link with
nothing; repeated rows are rows of their own; ids that repeat share nothing but their number; vectors of different
lengths are never compared; other columns pass by; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._work import Work


def unit_products(x: np.ndarray) -> np.ndarray:
    """All cosines in double precision."""
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    return np.clip(x @ x.T / np.outer(norm, norm), -1, 1)


def robust_prune(s: np.ndarray, degree: int, candidates: int, alpha: float) -> list[np.ndarray]:
    """Neighbours of every node: the nearest candidate, then the nearest that no chosen one is alpha times nearer to, and so on."""
    n = len(s)
    if n == 1:
        return [np.zeros(0, dtype=np.int64)]
    d = np.sqrt(np.maximum(2 - 2 * s, 0))
    np.fill_diagonal(d, np.inf)
    c = min(candidates, n - 1)
    near = np.argpartition(d, c - 1, axis=1)[:, :c]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
    own = np.take_along_axis(d, near, 1)
    alive, out, rows = np.ones(near.shape, dtype=bool), np.full((n, degree), -1), np.arange(n)
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        first = alive.argmax(1)
        pick = near[rows, first]
        out[some, k] = pick[some]
        alive &= alpha * d[pick[:, None], near] > own
        alive[rows, first] = False
    return [o[o >= 0] for o in out]


def strongest_tree(s: np.ndarray) -> np.ndarray:
    """Each node's link (-1 for the first) in a spanning tree of greatest similarity: of all paths between two nodes, the tree's has the strongest weakest link."""
    n = len(s)
    to, best, free = np.full(n, -1), np.full(n, -np.inf), np.ones(n, dtype=bool)
    at = 0
    for _ in range(n - 1):
        free[at] = False
        better = free & (s[at] > best)
        best[better], to[better] = s[at, better], at
        at = int(np.where(free, best, -np.inf).argmax())
    return to


def search(s: np.ndarray, graph: list[np.ndarray], start: int, expansions: int, reach: float) -> np.ndarray:
    """For every node as a query, which nodes it visits: expansions greedy steps from itself and the start over edges taken both ways, then all within reach."""
    n = len(s)
    link = np.zeros((n, n), dtype=bool)
    for i, o in enumerate(graph):
        link[i, o] = True
    link |= link.T
    seen, open_ = np.zeros((n, n), dtype=bool), np.full((n, n), -np.inf)
    seen[:, start] = True
    open_[:, start] = s[:, start]
    np.fill_diagonal(seen, True)
    np.fill_diagonal(open_, np.diag(s))
    live, step = np.arange(n), 0
    while len(live):
        best = open_[live].argmax(1)
        value = open_[live, best]
        go = np.isfinite(value) & ((step < expansions) | (value >= reach))
        live, best = live[go], best[go]
        open_[live, best] = -np.inf
        new = link[best] & ~seen[live]
        seen[live] |= new
        open_[live] = np.where(new, s[live], open_[live])
        step += 1
    return seen


def met_before(shards: list[np.ndarray], here: int) -> np.ndarray:
    """For every two members, whether they share a shard less than this one."""
    flat = np.concatenate(shards)
    row = np.repeat(np.arange(len(shards)), [len(x) for x in shards])
    keep = flat < here
    _, at = np.unique(flat[keep], return_inverse=True)
    held = np.zeros((len(shards), int(at.max()) + 1 if len(at) else 1), dtype=np.float32)
    held[row[keep], at] = 1
    held = held[:, held.sum(0) > 1]
    return held @ held.T > 0


def labelled(found: np.ndarray) -> np.ndarray:
    """Least member reachable, for a symmetric matrix of links."""
    label = np.arange(len(found))
    if not found.any():
        return label
    link = found | np.eye(len(found), dtype=bool)
    while True:
        new = np.where(link, label[None], len(label)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Near:
    """Near-duplicates of one table. classes: cid, rep, m, v; rows(): one row per row."""

    def __init__(self, df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", t: float = 0.98, shard: int = 600, overlap: int = 3, fan: int = 256, most_centres: int = 16_384, degree: int = 16, candidates: int = 64, alpha: float = 1.2, expansions: int = 24, slack: float = 0.08):
        self.work = work = Work(df.sparkSession, "vectors")
        self.t = t
        spark = df.sparkSession
        self.table = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
        self.table = self.table.withColumn("cid", F.when(good, F.xxhash64("label", "v")))
        classes = self.table.filter("cid IS NOT NULL").groupBy("cid").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.any_value("v").alias("v"), F.any_value("label").alias("label"))
        self.classes = work.save(classes, "classes")
        dealt = self.classes.select("cid", "m", "v", F.xxhash64("label", F.size("v")).alias("shard"))
        fit, level = [], 0
        while True:
            sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > shard).collect()
            if not sizes:
                fit.append(dealt)
                break
            fit.append(dealt.join(F.broadcast(self._shards([r.shard for r in sizes])), "shard", "left_anti").select(dealt.columns))
            dealt = self._split(dealt, {r.shard: r.n for r in sizes}, level, shard, overlap, fan, most_centres)
            level += 1
        dealt = reduce(DataFrame.unionByName, fit)
        lists = dealt.groupBy("cid").agg(F.array_sort(F.collect_set("shard")).alias("shards"))
        self.members = members = work.save(dealt.select("cid", "m", "v", "shard").distinct().join(lists, "cid"), "members")

        def build(x: pa.Table) -> pa.Table:
            cid = np.asarray(x["cid"].combine_chunks())
            s = unit_products(_matrix(x["v"]))
            graph = [np.union1d(o, t[t >= 0]) for o, t in zip(robust_prune(s, degree, candidates, alpha), strongest_tree(s)[:, None], strict=True)]
            return pa.table({"cid": pa.array(cid), "near": pa.array([cid[o].tolist() for o in graph], pa.list_(pa.int64()))})

        edges = members.groupBy("shard").applyInArrow(build, "cid long, near array<long>")
        united = work.save(edges.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")

        def find(x: pa.Table) -> pa.Table:
            cid, m = (np.asarray(x[c].combine_chunks()) for c in ("cid", "m"))
            here = int(x["shard"][0].as_py())
            s = unit_products(_matrix(x["v"]))
            place = {int(c): i for i, c in enumerate(cid)}
            graph = [np.array([place[c] for c in o if c in place], dtype=np.int64) for o in x["near"].to_pylist()]
            hit = search(s, graph, int(s.sum(1).argmax()), expansions, t - slack) & (s >= t)
            np.fill_diagonal(hit, False)
            hit |= hit.T
            u, v = np.nonzero(hit)
            mine = ~met_before([np.array(k, dtype=np.int64) for k in x["shards"].to_pylist()], here)[u, v]
            links = np.bincount(u[mine], weights=m[v[mine]], minlength=len(cid)).astype(np.int64)
            return pa.table({"cid": pa.array(cid), "links": pa.array(links), "root": pa.array(cid[labelled(hit)])})

        self.found = work.save(members.join(united, "cid").groupBy("shard").applyInArrow(find, "cid long, links long, root long"), "found")

    def _shards(self, shards) -> DataFrame:
        return self.work.spark.createDataFrame([(int(s),) for s in shards], "shard long")

    def _split(self, dealt: DataFrame, sizes: dict[int, int], level: int, shard: int, overlap: int, fan: int, most_centres: int) -> DataFrame:
        """All shards of the sizes divided, by their centres or into blocks."""
        work, spark, columns = self.work, self.work.spark, dealt.columns
        # enough centres that a shard's parts fit, each member in overlap of them
        want = {s: min(fan, max(4 * overlap, -(-2 * overlap * n // shard))) for s, n in sizes.items()}
        rounds: list[list[int]] = [[]]
        for s in sorted(want):
            if rounds[-1] and sum(want[x] for x in rounds[-1]) + want[s] > most_centres:
                rounds.append([])
            rounds[-1].append(s)
        parts, whole = [], {}
        for some in rounds:
            table = spark.createDataFrame([(s, want[s], sizes[s]) for s in some], "shard long, k long, n long")
            sample = dealt.join(F.broadcast(table), "shard").filter(F.pmod(F.xxhash64("cid", F.lit(level)), F.col("n")) < 4 * F.col("k") + 16)
            centres: dict[int, np.ndarray] = {}
            for r in sample.select("shard", "k", "v").orderBy("shard", F.xxhash64("cid", F.lit(level))).toLocalIterator():
                v, c = self._unit(np.array([r.v])), centres.get(r.shard)
                if c is None:
                    centres[r.shard] = v
                elif len(c) < r.k and (c @ v[0]).max() < self.t:
                    centres[r.shard] = np.concatenate([c, v])
            centres = {s: c for s, c in centres.items() if len(c) > overlap}
            whole |= {s: sizes[s] for s in some if s not in centres}
            if not centres:
                continue
            chosen = dealt.join(F.broadcast(self._shards(centres)), "shard").select(columns)
            parts_of = {c: s for s in centres for c in _children(s, np.arange(len(centres[s]))).tolist()}
            part = work.save(chosen.mapInArrow(self._dealer(spark.sparkContext.broadcast(centres), overlap), dealt.schema), f"level{level}")
            large = part.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > shard).collect()
            stuck = {s for r in large if r.n > 0.75 * sizes[s := parts_of[r.shard]]}
            if stuck:
                whole |= {s: sizes[s] for s in stuck}
                part = part.join(F.broadcast(self._shards([c for c, s in parts_of.items() if s in stuck])), "shard", "left_anti").select(columns)
            parts.append(part)
        if whole:
            table = spark.createDataFrame([(s, -(-5 * n // (2 * shard))) for s, n in whole.items()], "shard long, blocks long")
            cut = dealt.join(F.broadcast(table), "shard").withColumn("block", F.pmod(F.xxhash64("cid", F.lit(level), F.lit("block")), F.col("blocks")))
            cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).filter("other <> block")
            parts.append(work.save(cut.select("cid", "m", "v", F.xxhash64("shard", F.least("block", "other"), F.greatest("block", "other")).alias("shard")), f"blocks{level}"))
        return reduce(DataFrame.unionByName, parts)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.sqrt((x * x).sum(1))[:, None]

    def _dealer(self, held, overlap: int):
        unit = self._unit

        def deal(batches):
            for batch in batches:
                shard = np.asarray(batch.column(3))
                take, to = [], []
                for s in np.unique(shard):
                    at = np.flatnonzero(shard == s)
                    centres = held.value.get(int(s))
                    if centres is None:
                        take.append(at)
                        to.append(shard[at])
                        continue
                    sim = unit(_matrix(pa.chunked_array([batch.column(2).take(pa.array(at))]))) @ centres.T
                    k = min(overlap, len(centres))
                    best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                    take.append(np.repeat(at, k))
                    to.append(_children(int(s), best).ravel())
                take, to = np.concatenate(take), np.concatenate(to)
                kept = [batch.column(k).take(pa.array(take)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(to.astype(np.int64))], batch.schema.names)

        return deal

    def rows(self) -> DataFrame:
        """vec_id, n_links, component_id, kept."""
        work = self.work
        comp = components(work, self.found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
        links = self.found.groupBy("cid").agg(F.sum("links").alias("links"))
        known = self.classes.select("cid", "rep", "m").join(links, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
        known = work.save(known.join(least, "component").select("cid", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"), "known")
        out = self.table.select("vec_id", "cid").join(known, "cid", "left")
        component = F.coalesce("component_id", "vec_id")
        return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _children(shard: int, part: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.int64(shard) * np.int64(1_000_003) + part.astype(np.int64) + 1


def _matrix(v: pa.ChunkedArray) -> np.ndarray:
    flat = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def audit(df: DataFrame, found: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", t: float = 0.98, every: int = 50) -> float:
    """Share of the links of every row whose id is divisible by every that the rows' n_links hold, against brute force in blocks."""
    rows = df.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL AND label IS NOT NULL")
    q = rows.filter(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("q"), "label", F.col("v").alias("w"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    hit = q.join(rows, "label").filter("id <> q").filter(dot("v", "w") / F.sqrt(dot("v", "v") * dot("w", "w")) >= t)
    want = hit.groupBy("q").agg(F.count("*").alias("n"))
    got = want.join(found.select(F.col("vec_id").alias("q"), "n_links"), "q").agg(F.sum("n").alias("n"), F.sum(F.least("n", "n_links")).alias("got")).first()
    return 1.0 if not got.n else got.got / got.n
