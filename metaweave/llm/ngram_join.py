"""N-gram Jaccard join on count vectors.

A document is the set of its word n-grams. Tokens are hashed into groups, and the counts of a set's n-grams by group are
a point; the sum of the smaller counts of two points bounds their overlap, so a pair whose bound is too low is never
verified. Points of a block lie in a packed R-tree of two levels (points, boxes of a few points); the same bound
on a box's largest counts prunes whole boxes, in the join of boxes first and within each pair of boxes again.

Blocks come from an exact filter, so that no pair of all documents is looked at: sets with Jaccard at least t whose
larger one is in the size class up to U differ in at most D = U * 2 * (1 - t) / (1 + t) n-grams; of D + 1 parts of the
hash range that hold n-grams of one, one holds equal n-grams in both. Equal sets, told by two hashes of 64 bits, are one class from the start and
take part once; of blocks with the same members one counts.

In a few rounds each set is first verified against a leading one of its blocks, another one every round, which joins up
groups of near copies by as many pairs as they have members. Blocks whose sets are of one component need nothing more.
The others go through the R-tree, in tiles of bounded size: of the pairs of a tile that it leaves over only those are
verified that join up the tile's components likeliest, then components are made anew, until nothing is left but
pairs refuted; once every tile's likeliest pairs could be verified in one round, all that are left are. Every verification is on whole sets. So components are
exact while no group's pairs are ever listed.

Defined cases: words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased; a text with fewer than n words
is its whole sequence, one without words or null is empty and linked with nothing; rows equal in doc_id stay rows of
their own and are linked through it; a null doc_id gets its set's size and a null component; other columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._graph import components
from ._text import LOWER, buffers, byte_table, long_list, mix, prefix_hash, slices, span_hash, word_spans
from ._work import Work

TABLE = byte_table(1)[LOWER]
#: Least groups of tokens, that is dimensions of a point, and n-grams in a group on average at most, in points up to FINE groups and beyond: larger sets have finer points.
GROUPS, PER_GROUP, FINE = 64, (2, 8), 256
#: A set's least blocks, by which a pair is told which one of its common blocks it comes out of.
FIRST_BLOCKS = 4
#: Parts of a set against the differences they have to outnumber, as a fraction; hashes tried until enough parts hold an n-gram.
SLACK, TURNS = (13, 10), 8
#: Points in a box of the tree.
FAN = 16
#: One set in so many is asked for keys that many sets have.
SAMPLED = 64
#: Rows of a counted side that a join may broadcast.
MOST_BROADCAST = 500_000
MIXERS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, n-grams of each row, sorted distinct n-gram hashes end to end) for runs of rows."""
    for i, j, offs, raw in slices(texts):
        starts, ends, first = word_spans(offs, raw)
        h = span_hash(prefix_hash(raw, TABLE), starts, ends)
        words = np.diff(first)
        grams = np.where(words >= n, words - n + 1, 0)
        at = np.repeat(first[:-1] - (np.cumsum(grams) - grams), grams) + np.arange(grams.sum())
        g = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            g = g * MIXERS[0] + h[at + k] * MIXERS[1 + k]
        of = np.repeat(np.arange(j - i), grams)
        few = np.flatnonzero((words > 0) & (words < n))
        if len(few):  # the whole sequence, told from n-grams by its length
            g = np.append(g, np.array([_sequence(h[first[d] : first[d + 1]]) for d in few], dtype=np.uint64))
            of = np.append(of, few)
        g = mix(g)
        order = np.lexsort((g, of))
        g, of = g[order], of[order]
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
        yield i, np.bincount(of[new], minlength=j - i), g[new]


def _sequence(h: np.ndarray) -> int:
    g = np.uint64(len(h))
    with np.errstate(over="ignore"):
        for k, x in enumerate(h):
            g = g * MIXERS[40] + x * MIXERS[41 + k % 20]
    return int(g)


def most_differing(larger: int, t: Fraction) -> int:
    """Most elements by which sets of Jaccard t or more, the larger with so many, can differ."""
    return int(2 * larger * (1 - t) / (1 + t))


class Sizes:
    """Size classes: class c holds the sizes from bounds[c] to bounds[c + 1] - 1; sets of a pair whose larger one is there differ in differ[c] elements at most, and are cut into parts[c] parts."""

    def __init__(self, t: Fraction, most: int = 1 << 40):
        self.t, b = t, [1]
        while b[-1] <= most:  # wider classes than partners need: fewer sets have to be keyed under two of them
            b.append(max(b[-1] + 1, int(b[-1] * 1.6)))
        self.bounds = np.array(b)
        self.differ = np.array([most_differing(int(u) - 1, t) for u in b[1:]])
        self.parts = (self.differ + 1) * SLACK[0] // SLACK[1] + 1

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, n, "right") - 1

    def reach(self, n: int) -> range:
        """Classes of the larger set that a set of size n can be paired under."""
        return range(int(self.of(np.array([n]))[0]), int(self.of(np.array([int(Fraction(n) / self.t)]))[0]) + 1)


def signatures(g: np.ndarray, n: int, sizes: Sizes) -> np.ndarray:
    """A key for each part under each size class; equal sets of n-grams in a part give equal keys.

    If one set of a pair has more parts with an n-gram in them than the pair can differ in n-grams, one of these parts
    is equal in both, so empty parts, which many sets have in common, need no key. A set with too few such parts is cut
    by another hash too; only if that fails TURNS times its empty parts get keys as well.
    """
    out = []
    for c in sizes.reach(n):
        differ, parts = int(sizes.differ[c]), int(sizes.parts[c])
        if not differ:
            continue  # such sets link only if equal
        for turn in range(TURNS):
            h = g if not turn else mix(g ^ MIXERS[turn])
            part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            sums = np.zeros(len(g) + 1, dtype=np.uint64)
            np.cumsum(mix(g[order] ^ MIXERS[20]), out=sums[1:])
            edge = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            size = edge[1:] - edge[:-1]
            content = sums[edge[1:]] - sums[edge[:-1]] + mix(size.astype(np.uint64))
            key = mix(content * MIXERS[21] + np.arange(parts, dtype=np.uint64) * MIXERS[22] + np.array([c * TURNS + turn + 1], dtype=np.uint64) * MIXERS[23])
            enough = np.count_nonzero(size) > differ
            out.append(key if turn == TURNS - 1 and not enough else key[size > 0])
            if enough:
                break
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def overlap_needed(a: np.ndarray | int, b: np.ndarray | int, t: Fraction) -> np.ndarray:
    """Least overlap of sets of sizes a and b whose Jaccard is t or more."""
    p, q = t.numerator, t.denominator
    return -(-(np.asarray(a) + np.asarray(b)) * p // (p + q))


def point(g: np.ndarray) -> bytes:
    """Counts by group, the groups a power of two; a coarser point is the finer one folded."""
    wanted = max(min(len(g) // PER_GROUP[0], FINE), len(g) // PER_GROUP[1])
    groups = max(GROUPS, 1 << (max(1, wanted) - 1).bit_length())
    while (counts := np.bincount((g & np.uint64(groups - 1)).astype(np.int64), minlength=groups)).max() > 255:
        groups *= 2
    return counts.astype(np.uint8).tobytes()


def names(s: np.ndarray, bits: int) -> tuple[np.uint64, np.uint64]:
    """Two hashes that tell sets of n-grams apart; the first, of so many bits, is usually enough."""
    return mix(s).sum(dtype=np.uint64) & np.uint64((1 << bits) - 1), mix(s ^ MIXERS[30]).sum(dtype=np.uint64)


def _names(parts: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """s1 and s2 of every set."""
    own = np.array([names(s, bits) for s in parts], dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return np.ascontiguousarray(own[:, 0]), np.ascontiguousarray(own[:, 1])


def likeness(bound: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The overlap bound against the sizes, in millionths."""
    return (bound * 2_000_000) // (n + m)


class Tree:
    """Sets in tree order, every FAN of them a box."""

    def __init__(self, n: np.ndarray, component: np.ndarray, set_: np.ndarray, points: np.ndarray, first: tuple[np.ndarray, np.ndarray]):
        order = np.lexsort((points[:, 1], points[:, 0], n)) if len(n) > FAN else np.arange(len(n))
        self.n, self.component, self.set, self.points, self.at, self.first = n[order], component[order], set_[order], points[order], order, first

    def blocks(self, i: int) -> set[int]:
        starts, values = self.first
        return set(values[starts[self.at[i]] : starts[self.at[i] + 1]].tolist())

    def gives(self, i: np.ndarray, other: Tree, j: np.ndarray, key: int) -> np.ndarray:
        """Whether the pairs come out of this block: of two sets' common blocks the least comes first in both lists, if it is in both."""
        own, others = {x: self.blocks(x) for x in set(i.tolist())}, {x: other.blocks(x) for x in set(j.tolist())}
        return np.array([not (both := own[u] & others[v]) or min(both) == key for u, v in zip(i.tolist(), j.tolist(), strict=True)], dtype=bool)


class Members:
    """The trees of a column of lists of (n, component, set, point, first)."""

    def __init__(self, lists: pa.ListArray):
        self.offsets = np.asarray(lists.offsets)
        held = lists.values
        self.n, self.component, self.set = (np.asarray(held.field(c)) for c in ("n", "component", "set"))
        points, first = held.field("point"), held.field("first")
        self.ends, self.points = buffers(points)
        self.first = np.asarray(first.offsets), np.asarray(first.values)

    def size(self, row: int) -> int:
        return int(self.offsets[row + 1] - self.offsets[row])

    def of(self, row: int) -> Tree:
        a, b = self.offsets[row], self.offsets[row + 1]
        ends = self.ends[a : b + 1]
        length = np.diff(ends)
        groups = int(length.min())
        if (length == groups).all():
            points = self.points[ends[0] : ends[-1]].reshape(-1, groups)
        else:
            points = np.array([self.points[x:y].reshape(-1, groups).sum(0, dtype=np.int32) for x, y in zip(ends, ends[1:], strict=False)])
        return Tree(self.n[a:b], self.component[a:b], self.set[a:b], points, (self.first[0][a : b + 1], self.first[1]))


def sums_of_minima(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.minimum(p[..., :, None, :], q[..., None, :, :]).sum(-1, dtype=np.int64)


def search(a: Tree, b: Tree, t: Fraction, same: bool, most: int = 1 << 23) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in a, places in b, bounds) of the pairs of different components whose overlap bound reaches what their sizes need."""
    p, q = a.points, b.points
    if (groups := min(p.shape[1], q.shape[1])) < max(p.shape[1], q.shape[1]):
        p, q = (x.reshape(len(x), -1, groups).sum(1, dtype=np.int32) for x in (p, q))
    if len(p) <= FAN and len(q) <= FAN:
        bound = sums_of_minima(p, q)
        ok = (bound >= overlap_needed(a.n[:, None], b.n[None], t)) & (a.component[:, None] != b.component[None])
        i, j = np.nonzero(np.triu(ok, 1) if same else ok)
        return i, j, bound[i, j]
    (p, na, ca), (q, nb, cb) = _boxed(p, a), _boxed(q, b)
    least_a, least_b = (np.where(n > 0, n, np.iinfo(np.int64).max // 4).min(1) for n in (na, nb))
    tops_a, tops_b = p.max(1), q.max(1)
    rows = max(1, most // max(1, tops_b.size))
    near = np.concatenate([sums_of_minima(tops_a[k : k + rows], tops_b) >= overlap_needed(least_a[k : k + rows, None], least_b[None], t) for k in range(0, len(tops_a), rows)])
    x, y = np.nonzero(np.triu(near) if same else near)
    out: list[tuple[np.ndarray, ...]] = []
    at_once = max(1, most // (FAN * FAN * groups * p.itemsize))
    for k in range(0, len(x), at_once):
        u, v = x[k : k + at_once], y[k : k + at_once]
        bound = sums_of_minima(p[u], q[v])
        ok = (bound >= overlap_needed(na[u][:, :, None], nb[v][:, None], t)) & (ca[u][:, :, None] != cb[v][:, None]) & (na[u][:, :, None] > 0) & (nb[v][:, None] > 0)
        w, i, j = np.nonzero(ok)
        out.append((u[w] * FAN + i, v[w] * FAN + j, bound[w, i, j]))
    if not out:
        return (np.zeros(0, dtype=np.int64),) * 3
    i, j, bound = (np.concatenate(c) for c in zip(*out, strict=True))
    return (i[i < j], j[i < j], bound[i < j]) if same else (i, j, bound)


def _boxed(points: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, sizes and components by box, the last box filled up with empty sets."""
    more = -len(points) % FAN
    fill = lambda x: np.concatenate([x, np.zeros((more, *x.shape[1:]), dtype=x.dtype)]).reshape(-1, FAN, *x.shape[1:])
    return fill(points), fill(tree.n), fill(tree.component)


def forest(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Which pairs of components join up all that are joined, by the likeliest pairs."""
    _, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    order = np.argsort(-near, kind="stable")
    label, keep = np.arange(int(ends.max()) + 1), np.zeros(len(a), dtype=bool)
    while True:
        x, y = label[u[order]], label[v[order]]
        order, x, y = (z[x != y] for z in (order, x, y))
        if not len(order):
            return keep
        best = np.full(len(label), len(order))
        np.minimum.at(best, x, np.arange(len(order)))
        np.minimum.at(best, y, np.arange(len(order)))
        pick = np.unique(best[best < len(order)])
        keep[order[pick]] = True
        for c, d in zip(x[pick].tolist(), y[pick].tolist(), strict=True):
            while label[c] != c:
                c = label[c]
            while label[d] != d:
                d = label[d]
            label[max(c, d)] = min(c, d)
        while (label[label] != label).any():
            label = label[label]


def unasked(a: np.ndarray, b: np.ndarray, asked: pa.StructArray) -> np.ndarray:
    """Which pairs are not among those asked."""
    before = set(zip(asked.field("a").to_pylist(), asked.field("b").to_pylist(), strict=True))
    return np.array([(min(x, y), max(x, y)) not in before for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=bool)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


class Join:
    """The join of one table with itself.

    sized: doc_id, n, s1, s2, set (the set's id); links: verified pairs of set ids that connect every component;
    classes(): one row per row of the table.
    """

    def __init__(self, df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, t: str = "0.8", box: int = 256, star_rounds: int = 2, forest_rounds: int = 3, name_bits: int = 64):
        self.n, self.t, self.box, self.bits = n, Fraction(t), box, name_bits
        self.work = work = Work(df.sparkSession, "ngrams")
        self.rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        found = work.save(self.rows.mapInArrow(self._shingler(), "doc_id long, n long, s1 long, s2 long, point binary"), "found")
        self.sized = work.save(found.select("doc_id", "n", "s1", "s2"), "sized")
        self.clash = None
        ids = self.sized.filter("n > 0").groupBy("s1").agg(F.min("s2").alias("low"), F.max("s2").alias("high"))
        clash = work.save(ids.filter("low <> high").select("s1"), "clash")
        if not clash.isEmpty():
            self.clash = clash
        self.sized, found_ = self._named(self.sized), self._named(found)
        self.reps = work.save(self.sized.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set", "s1", "s2").agg(F.min("doc_id").alias("rep")), "reps")
        # keys are many times the rest of a set, so they are made where they are shuffled and never stored
        met = work.save(self._shared(self._keyed(), self._keyed(SAMPLED)), "met")
        work.sweep()
        met = self._told_apart(met)
        work.sweep()
        sets_ = found_.filter("n > 0").select("set", "n", "point").join(met.select("set").distinct(), "set", "left_semi")
        self.points = work.save(sets_.dropDuplicates(["set"]), "points")
        work.drop(found)
        self.links, self.comp, left = None, None, met
        for k in range(star_rounds):
            # each set against the set that leads most of its blocks; every round has other leads
            turn = F.lit(int(MIXERS[50 + k].view(np.int64)))
            lead = left.groupBy("key").agg(F.min(F.col("set").bitwiseXOR(turn)).alias("lead"))
            led = left.join(lead, "key").withColumn("lead", F.col("lead").bitwiseXOR(turn)).filter("lead <> set").groupBy("set", "lead").agg(F.count("*").alias("blocks"))
            pairs = led.groupBy(F.col("set").alias("b")).agg(F.max_by("lead", F.struct("blocks", "lead")).alias("a"))
            if not self._join_up(self._bounded(self._across(pairs))):
                break
            left = self._mixed(met)
        met_sets = self.points.count()
        # of the pairs that the trees leave over each set's likeliest ones, until none is left but refuted ones
        tiles, flagged, asked = work.save(self._tiles(self._mixed(met)), "tiles"), None, None
        few = False  # whether the last round verified every tile's likeliest pairs
        for k in range(forest_rounds + 1):
            whole = few or k == forest_rounds
            got = work.save(self._trees(tiles, flagged, asked, whole), "trees")
            pairs, flagged = got.filter("a IS NOT NULL"), got.filter("a IS NULL").select("key", "t1", "t2")
            if asked is not None:
                asked = work.save(asked, "asked")
            new = pairs.select("a", "b").distinct()
            new = work.save(new if asked is None else new.join(asked.select("a", "b").distinct(), ["a", "b"], "left_anti"), "new")
            few = new.count() <= met_sets
            if not whole and not few:  # each set's likeliest pair first
                best = pairs.join(new, ["a", "b"], "left_semi").select(F.explode(F.array("a", "b")).alias("set"), F.struct("near", "a", "b").alias("p")).groupBy("set").agg(F.max("p").alias("p"))
                new = best = work.save(best.select("p.a", "p.b").distinct(), "best")
                flagged = flagged.unionByName(pairs.join(best, ["a", "b"], "left_anti").select("key", "t1", "t2"))
                pairs = pairs.join(best, ["a", "b"], "left_semi").select(pairs.columns)
            flagged = work.save(flagged.distinct(), "flagged")
            asked = pairs if asked is None else asked.unionByName(pairs)
            self._join_up(new)
            if flagged.isEmpty():
                break

    def _named(self, df: DataFrame) -> DataFrame:
        """df with the id of each row's set: s1, or where two sets have the same s1 a hash of both."""
        if self.clash is None:
            return df.withColumn("set", F.col("s1"))
        known = F.broadcast(self.clash.select(F.col("s1").alias("clash")))
        return df.join(known, F.col("s1") == F.col("clash"), "left").withColumn("set", F.when(F.col("clash").isNull(), F.col("s1")).otherwise(F.xxhash64("s1", "s2"))).drop("clash")

    def _keyed(self, one_in: int = 1) -> DataFrame:
        """(key, set) of every set, or of about one set in so many."""
        keys = self.rows.mapInArrow(self._keyer(one_in), "s1 long, s2 long, keys array<long>")
        return self._named(keys).select(F.explode("keys").alias("key"), "set")

    def _shared(self, keyed: DataFrame, sample: DataFrame) -> DataFrame:
        """(key, set) of the keys that several sets have. Keys that many sets have, told by a sample of the sets, are counted without meeting in a task."""
        often = sample.groupBy("key").agg(F.count("*").alias("n")).filter("n >= 32").select("key")
        # never empty, so that the plan is the same at every size; any key may go either way
        often = self.work.sized(often.unionByName(keyed.sparkSession.range(1).select(F.lit(0).cast("long").alias("key"))), MOST_BROADCAST, "often")
        # a key that many sets have is dealt by set, so that keys are made and shuffled once
        dealt = keyed.join(often.withColumn("often", F.lit(True)), "key", "left").withColumn("spread", F.when(F.col("often"), F.col("set")).otherwise(F.lit(0)))
        whole = Window.partitionBy("key", "spread")
        rest = dealt.select("key", "spread", "set", "often", F.min("set").over(whole).alias("low"), F.max("set").over(whole).alias("high"))
        return rest.filter("often OR low <> high").select("key", "spread", "set").distinct().select("key", "set")

    def _told_apart(self, met: DataFrame) -> DataFrame:
        """One block of those with the same two members or more."""
        own = met.groupBy("key").agg(F.count("*").alias("members"), F.min("set").alias("low"), F.max("set").alias("high"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("set", F.lit(2))).alias("y"))
        once = own.filter("low <> high").groupBy("members", "low", "high", "x", "y").agg(F.min("key").alias("key")).select("key")
        out = self.work.save(met.join(once, "key", "left_semi"), "blocks")
        self.work.drop(met)
        return out

    def _join_up(self, pairs: DataFrame) -> bool:
        """Verifies the pairs a, b and adds what links; whether any pair did."""
        new = self._verify(pairs)
        if new.isEmpty():
            self.links = new if self.links is None else self.links
            return False
        links = new if self.links is None else self.work.save(self.links.unionByName(new), "links")
        if self.links is not None:
            self.work.drop(self.links, new)
        if self.comp is not None:
            self.work.drop(self.comp)
        self.links, self.comp = links, self.work.save(components(self.work, links), "components")
        self.work.sweep()
        return True

    def _shingler(self):
        n, bits = self.n, self.bits

        def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, counts, g in sets(batch.column(1), n):
                    parts = [g[e - c : e] for c, e in zip(counts, np.cumsum(counts), strict=True)]
                    s1, s2 = _names(parts, bits)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(counts)), pa.array(counts, pa.int64()), pa.array(s1), pa.array(s2), pa.array([point(s) for s in parts], pa.binary())], ["doc_id", "n", "s1", "s2", "point"])

        return shingle

    def _keyer(self, one_in: int):
        n, bits, sizes = self.n, self.bits, Sizes(self.t)

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[tuple[int, int]] = set()  # copies of a set met before in this task emit no keys: the map side of pre-aggregation
            for batch in batches:
                for i, counts, g in sets(batch.column(1), n):
                    parts = [g[e - c : e] for c, e in zip(counts, np.cumsum(counts), strict=True)]
                    s1, s2 = _names(parts, bits)
                    new = []
                    for k, name in enumerate(zip(s1.tolist(), s2.tolist(), strict=True)):
                        if counts[k] and batch.column(0)[i + k].is_valid and name[0] % one_in == 0 and name not in seen:
                            seen.add(name)
                            new.append(k)
                    if new:
                        keys = [signatures(parts[k], int(counts[k]), sizes) for k in new]
                        yield pa.RecordBatch.from_arrays([pa.array(s1[new]), pa.array(s2[new]), long_list(np.concatenate(keys), np.array([len(k) for k in keys]))], ["s1", "s2", "keys"])

        return key

    def _packer(self):
        n, bits = self.n, self.bits

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, counts, g in sets(batch.column(3), n):
                    parts = [g[e - c : e] for c, e in zip(counts, np.cumsum(counts), strict=True)]
                    own = np.array([names(s, bits) for s in parts], dtype=np.uint64).view(np.int64)
                    s1, s2 = (np.asarray(batch.column(k).slice(i, len(counts))) for k in (1, 2))
                    same = pa.array((own[:, 0] == s1) & (own[:, 1] == s2))  # a doc_id may come with other texts too
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(counts)), pa.array([s.astype("<u8").tobytes() for s in parts], pa.binary())], ["set", "grams"]).filter(same)

        return pack

    def _bounded(self, pairs: DataFrame) -> DataFrame:
        """The pairs a, b whose count-vector bound reaches what their sizes need."""
        t = self.t

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, m = (np.asarray(batch.column(k)) for k in (2, 3))
                need, ok = overlap_needed(n, m, t), []
                for p, q, least in zip(batch.column(4), batch.column(5), need, strict=True):
                    p, q = (np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in (p, q))
                    if len(p) != len(q):
                        p, q = (x.reshape(-1, min(len(p), len(q))).sum(0, dtype=np.int64) for x in (p, q))
                    ok.append(int(np.minimum(p, q).sum(dtype=np.int64)) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        left, right = (self.points.select(F.col("set").alias(c), F.col("n").alias(f"n{c}"), F.col("point").alias(f"p{c}")) for c in ("a", "b"))
        met = pairs.join(left, "a").join(right, "b").filter((F.col("na") * self.t.denominator >= F.col("nb") * self.t.numerator) & (F.col("nb") * self.t.denominator >= F.col("na") * self.t.numerator))
        return met.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(bound, "a long, b long")

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs a, b whose whole sets reach the threshold."""
        t, work = self.t, self.work

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = (np.frombuffer(z.as_buffer(), dtype="<u8") for z in (x, y))
                    ok.append(overlap(x, y) >= int(overlap_needed(len(x), len(y), t)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        pairs = work.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(self.reps, "set").select("set", "s1", "s2", F.col("rep").alias("doc_id"))
        texts = self.rows.join(work.sized(wanted, MOST_BROADCAST, "wanted"), "doc_id").select("set", "s1", "s2", "text")
        whole = work.save(texts.mapInArrow(self._packer(), "set long, grams binary").dropDuplicates(["set"]), "sets")
        left, right = (whole.select(F.col("set").alias(c), F.col("grams").alias(f"g{c}")) for c in ("a", "b"))
        out = work.save(pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb").mapInArrow(verify, "a long, b long"), "verified")
        work.drop(pairs, whole)
        return out

    def _across(self, pairs: DataFrame) -> DataFrame:
        """The pairs a, b whose sets are of different components."""
        if self.comp is None:
            return pairs.select("a", "b")
        for c in ("a", "b"):
            pairs = pairs.join(self.comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
        return pairs.filter("ca <> cb").select("a", "b")

    def _placed(self, met: DataFrame) -> DataFrame:
        """met with every set's component."""
        if self.comp is None:
            return met.withColumn("component", F.col("set"))
        return met.join(self.comp.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))

    def _mixed(self, met: DataFrame) -> DataFrame:
        """The rows of met in blocks of more than one component."""
        rows = self._placed(met)
        more = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
        return rows.join(more, "key", "left_semi").select("key", "set", "component")

    def _tiles(self, left: DataFrame) -> DataFrame:
        """key, set, team, tile, first, alone: blocks in tiles of about box members. Components with so many members in a block have tiles of their own (team), which need not meet each other."""
        first = left.groupBy("set").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRST_BLOCKS).alias("first"))
        left = self.work.save(left.join(first, "set"), "left")
        large = left.groupBy("key").agg(F.count("*").alias("members")).filter(F.col("members") > self.box).select("key")
        alone = left.join(large, "key", "left_anti").select("key", "set", F.lit(None).cast("long").alias("team"), F.lit(0).cast("long").alias("tile"), "first", F.lit(True).alias("alone"))
        rows = left.join(large, "key", "left_semi")
        teams = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
        some = F.when(F.col("c") < self.box, F.col("c")).otherwise(0)
        others = teams.groupBy("key").agg(F.sum(some).alias("others"))
        rows = rows.join(teams, ["key", "component"]).join(others, "key")
        own = F.col("c") >= self.box
        tile = F.pmod("set", F.ceil(F.when(own, F.col("c")).otherwise(F.col("others")) / self.box))
        return alone.unionByName(rows.select("key", "set", F.when(own, F.col("component")).alias("team"), F.xxhash64(F.when(own, F.col("component")), tile).alias("tile"), "first", F.lit(False).alias("alone")))

    def _trees(self, tiles: DataFrame, flagged: DataFrame | None, asked: DataFrame | None, whole: bool) -> DataFrame:
        """Pairs of different components that the R-trees of tiles of a block leave over: key, t1, t2, a, b, near.

        Of two tiles' pairs those that join up their components likeliest are given, and a row without a and b if there
        are others; all pairs if whole.
        """
        t, again, columns = self.t, flagged is not None, ["n", "component", "set", "point", "first"]
        if flagged is not None:
            tiles = tiles.join(flagged.select("key").distinct(), "key", "left_semi")
        rows = self._placed(tiles).join(self.points, "set")
        held = rows.groupBy("key", "tile", "team", "alone").agg(F.collect_list(F.struct(*columns)).alias("m"))
        single = held.filter("alone").select("key", F.col("tile").alias("t1"), F.col("tile").alias("t2"), F.col("m").alias("m1"), F.expr("slice(m, 1, 0)").alias("m2"))
        many = held.filter("NOT alone")
        x, y = (many.select("key", F.col("tile").alias(f"t{k}"), F.col("team").alias(f"team{k}"), F.col("m").alias(f"m{k}")) for k in (1, 2))
        if flagged is None:
            met = x.join(y, "key").filter("t1 <= t2 AND (team1 IS NULL OR team2 IS NULL OR team1 <> team2)")
            met = single.unionByName(met.select("key", "t1", "t2", "m1", F.expr("CASE WHEN t1 = t2 THEN slice(m2, 1, 0) ELSE m2 END").alias("m2"))).withColumn("asked", F.expr("CAST(array() AS array<struct<a: long, b: long>>)"))
        else:
            before = asked.groupBy("key", "t1", "t2").agg(F.collect_list(F.struct("a", "b")).alias("asked"))
            met = flagged.join(x, ["key", "t1"]).join(y, ["key", "t2"]).select("key", "t1", "t2", "m1", F.expr("CASE WHEN t1 = t2 THEN slice(m2, 1, 0) ELSE m2 END").alias("m2"))
            met = single.join(flagged, ["key", "t1", "t2"]).unionByName(met).join(before, ["key", "t1", "t2"])

        def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                where = [np.asarray(batch.column(k)) for k in range(3)]
                one, two = Members(batch.column(3)), Members(batch.column(4))
                before = batch.column(5)
                out: list[tuple[np.ndarray, ...]] = []
                for r in range(batch.num_rows):
                    left = one.of(r)
                    right = two.of(r) if two.size(r) else left
                    i, j, near = search(left, right, t, right is left)
                    if not len(i):
                        continue
                    a, b = left.set[i], right.set[j]
                    keep = left.gives(i, right, j, where[0][r])
                    if again:
                        keep &= unasked(a, b, before[r].values)
                    i, j, a, b, near = i[keep], j[keep], a[keep], b[keep], near[keep]
                    if not len(i):
                        continue
                    if not whole:
                        chosen = forest(left.component[i], right.component[j], likeness(near, left.n[i], right.n[j]))
                        if not chosen.all():
                            out.append((*(w[r : r + 1] for w in where), *np.zeros((3, 1), dtype=np.int64), np.ones(1, dtype=bool)))
                        i, j, a, b, near = i[chosen], j[chosen], a[chosen], b[chosen], near[chosen]
                    out.append((*(np.full(len(a), w[r]) for w in where), np.minimum(a, b), np.maximum(a, b), likeness(near, left.n[i], right.n[j]), np.zeros(len(a), dtype=bool)))
                if out:
                    *cols, none = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols[:3]), *(pa.array(c, mask=none) for c in cols[3:])], ["key", "t1", "t2", "a", "b", "near"])

        return met.select("key", "t1", "t2", "m1", "m2", "asked").mapInArrow(trees, "key long, t1 long, t2 long, a long, b long, near long")

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id."""
        if self.comp is None:
            sets_ = self.reps.withColumn("component", F.col("set"))
        else:
            sets_ = self.reps.join(self.comp.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
        least = sets_.groupBy("component").agg(F.min("rep").alias("component_id"))
        ids = sets_.join(least, "component").select("set", "component_id")
        out = self.sized.join(ids, "set", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of df, all columns as they are, of the least doc_id of each group; of rows equal in doc_id and text one stays, rows without doc_id all stay."""
    join = Join(df, doc_id, text, **more)
    gone = join.classes().filter("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    rows = df.join(join.work.sized(gone, MOST_BROADCAST, "gone"), doc_id, "left_anti").select(df.columns)
    twice = df.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id)).agg(F.count("*").alias("__rows")).filter("__rows > 1").select(doc_id)
    twice = join.work.sized(twice, MOST_BROADCAST, "twice")
    return rows.join(twice, doc_id, "left_anti").select(df.columns).unionByName(rows.join(twice, doc_id, "left_semi").select(df.columns).dropDuplicates([doc_id, text]))
