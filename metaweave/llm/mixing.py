"""Mixing sources to target weights.

The words of a source, its documents end to end, are packed into blocks of a fixed length. The mix is a row of output
shards with a fixed number of slots each; a shard's count for every source is a multinomial draw conditioned on the
source's total, made by splitting the totals down a binary tree of shards, so every task finds its own shards' counts
and its place in each source's slots without a shuffle, and totals come out exactly. A source's i-th slot takes block
p(i): p is a keyed pseudorandom permutation of its blocks, another one for each pass. Blocks and slots meet in a join
by (source, block).

Defined cases: a null text has no words; a null source is a source of its own, after all others; repeated rows count
each on its own; a null doc_id is carried; other columns are ignored unless texts are asked for; an empty table or one
without words takes nothing. The list of sources, with one sum each, is the only thing the driver gathers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import MASK, mix
from ._work import Work, partitions

#: Java's form of [^\x20\x09-\x0D]+, the words that count.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[float, ...], cap: float) -> list[float]:
    """Shares of the sum of sizes by repeating weights; none above cap times its size, the excess reshared by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out: list[float | None] = [None] * len(sizes)
    while True:
        open_ = [i for i, t in enumerate(out) if t is None]
        left = sum(sizes) - sum(t for t in out if t is not None)
        total = sum(w[i] for i in open_)
        over = [i for i in open_ if left * w[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            return [float(t) for t in out]
        for i in over:
            out[i] = cap * sizes[i]


class Permutation:
    """A keyed bijection of 0..n-1: four Feistel rounds on the next even number of bits, walked back into range."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, (max(1, (n - 1).bit_length()) + 1) // 2)
        self.keys = mix(np.uint64(key & MASK) + np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        h, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        a, b = x >> h, x & low
        for k in self.keys[::-1] if back else self.keys:
            a, b = (b ^ (mix(a + k) & low), a) if back else (b, a ^ (mix(b + k) & low))
        return (a << h) | b

    def __call__(self, i: np.ndarray, back: bool = False) -> np.ndarray:
        x = self._once(np.asarray(i, dtype=np.uint64), back)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)


def _key(seed: int, source: int, turn: int) -> int:
    return int(mix(np.array([(seed * 1_000_003 + source) * 4_099 + turn], dtype=np.uint64))[0])


class Source:
    """How many slots a source has, and the words its last one takes."""

    def __init__(self, index: int, size: int, target: float, block: int, seed: int):
        self.index, self.size, self.block, self.seed = index, size, block, seed
        self.blocks, self.want = -(-size // block), round(target)
        self.slots = 0
        if self.want and size:
            full, rest = divmod(self.want, size)
            self.slots = full * self.blocks + rest // block
            while self.words(self.slots) < self.want:
                self.slots += 1
        self.trim = self.words(self.slots) - self.want if self.slots else 0

    def permutation(self, turn: int) -> Permutation:
        return Permutation(self.blocks, _key(self.seed, self.index, turn))

    def words(self, slots: int) -> int:
        turns, rest = divmod(slots, self.blocks)
        short = self.blocks * self.block - self.size
        return turns * self.size + rest * self.block - (short if rest and int(self.permutation(turns)(np.array([self.blocks - 1]), back=True)[0]) < rest else 0)

    def take(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pass, block, words from the block's head) of the slots i."""
        turn, at = np.divmod(i, self.blocks)
        block = np.empty(len(i), dtype=np.int64)
        for t in np.unique(turn):
            block[turn == t] = self.permutation(int(t))(at[turn == t])
        words = np.minimum(self.block, self.size - block * self.block)
        words[i == self.slots - 1] -= self.trim
        return turn, block, words


def _stirling(n: int) -> float:
    """What Stirling's formula lacks of log n!."""
    if n < 16:
        return math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi) if n else 0)
    return (1 / 12 - (1 / 360 - 1 / 1260 / n**2) / n**2) / n


def _log_binomial(x: int, n: int, p: float) -> float:
    """Log of the binomial probability of x in n, by its saddle point, which loses no digits however large n is."""
    if x in (0, n):
        return n * math.log(p) if x else n * math.log1p(-p)

    def off(x: int, mean: float) -> float:
        u = (x - mean) / mean
        return mean * ((1 + u) * math.log1p(u) - u)

    near = _stirling(n) - _stirling(x) - _stirling(n - x) - off(x, n * p) - off(n - x, n * (1 - p))
    return near - 0.5 * math.log(2 * math.pi * x * ((n - x) / n))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn without replacement, by rejection under the envelope that all log-concave probabilities share: about five tries at every size."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    p = n / (good + bad)
    log = lambda k: _log_binomial(k, good, p) + _log_binomial(n - k, bad, p)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    at = log(mode)
    top = math.exp(at - _log_binomial(n, good + bad, p))
    w = 1 + top / 2
    while True:
        y = (rng.random() * w if rng.random() <= w / (1 + w) else w + rng.standard_exponential()) / top
        k = mode + round(y) * (1 if rng.random() < 0.5 else -1)
        if low <= k <= high and rng.random() * min(1.0, math.exp(w - top * y)) <= math.exp(log(k) - at):
            return k


class Tree:
    """Counts of each source in every shard: the totals, split at random between the halves of ever shorter rows of shards."""

    def __init__(self, slots: list[int], shard_slots: int, seed: int):
        self.slots, self.width, self.seed = np.array(slots, dtype=np.int64), shard_slots, seed
        self.shards = -(-int(self.slots.sum()) // shard_slots)
        self.seen: dict = {}

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(counts, slots of each source before this shard)."""
        lo, hi, counts, before = 0, self.shards, self.slots, np.zeros_like(self.slots)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if (lo, hi) not in self.seen:
                if len(self.seen) > 4096:
                    self.seen.clear()
                self.seen[lo, hi] = self._split(counts, (mid - lo) * self.width, lo, hi)
            left = self.seen[lo, hi]
            if k < mid:
                hi, counts = mid, left
            else:
                lo, counts, before = mid, counts - left, before + left
        return counts, before

    def _split(self, counts: np.ndarray, n: int, lo: int, hi: int) -> np.ndarray:
        rng, left, rest = np.random.default_rng([self.seed, lo, hi]), np.zeros_like(counts), int(counts.sum())
        for s, c in enumerate(counts):
            rest -= int(c)
            left[s] = hypergeometric(rng, int(c), rest, n)
            n -= int(left[s])
        return left


class Mix:
    """The mix of one table. sizes: rows with their source's figures; slots: the shards' slots; pieces: which words of which row each slot holds."""

    def __init__(self, df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, block: int = 64, shard_slots: int = 1024, seed: int = 7, keep: bool = False):
        self.work, self.block, self.shard_slots, self.seed = Work(df.sparkSession, "mixing"), block, shard_slots, seed
        spark = df.sparkSession
        n = df.count()
        chunks = max(1, n // 2000)
        kept = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if keep else []
        sized = self.work.save(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.pmod(F.xxhash64(doc_id, text), F.lit(chunks)).alias("chunk"), F.hash(doc_id, text, source).alias("tie"), *kept), "sized")
        found = sorted(((r.source, r.size) for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()), key=lambda r: (r[0] is None, r[0]))
        self.targets = targets([s for _, s in found], weights, cap) if found else []
        self.sources = [Source(i, s, t, block, seed) for i, ((_, s), t) in enumerate(zip(found, self.targets, strict=True))]
        names = spark.createDataFrame([(i, name, s, t) for i, ((name, s), t) in enumerate(zip(found, self.targets, strict=True))], "source_index int, source string, source_size long, target double")
        sized = sized.withColumn("source_key", F.col("source")).drop("source").join(F.broadcast(names), F.col("source_key").eqNullSafe(names.source)).drop("source_key", "source")
        own = Window.partitionBy("source_index", "chunk").orderBy("doc_id", "size", "tie")
        base = sized.groupBy("source_index", "chunk").agg(F.sum("size").alias("words"))
        base = base.select("source_index", "chunk", (F.sum("words").over(Window.partitionBy("source_index").orderBy("chunk")) - F.col("words")).alias("base"))
        rows = sized.withColumn("n", F.row_number().over(own)).withColumn("start", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        self.sizes = rows.join(base, ["source_index", "chunk"]).withColumn("start", F.col("start") + F.col("base")).drop("base", "tie")

    def slots(self) -> DataFrame:
        """shard, slot, source_index, turn, block, words."""
        sources, shard_slots, seed = self.sources, self.shard_slots, self.seed
        tree = Tree([s.slots for s in sources], shard_slots, seed)
        spark = self.work.spark

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for lo in range(0, len(batch), 64):
                    shards = batch["id"].to_numpy()[lo : lo + 64]
                    counted = [tree.shard(int(k)) for k in shards]
                    for s in sources:
                        runs = [(k, c[s.index], b[s.index]) for k, (c, b) in zip(shards, counted, strict=True) if c[s.index]]
                        if not runs:
                            continue
                        i = np.concatenate([np.arange(b, b + c) for _, c, b in runs])
                        turn, block, words = s.take(i)
                        at = [(int(c[: s.index].sum()), int(c[s.index])) for c, _ in counted if c[s.index]]
                        yield pd.DataFrame({"shard": np.repeat([k for k, _, _ in runs], [c for _, c, _ in runs]), "slot": np.concatenate([np.arange(a, a + c) for a, c in at]), "source_index": s.index, "turn": turn, "block": block, "words": words})

        tasks = max(1, min(tree.shards, max(partitions(spark), tree.shards // 256)))
        return spark.range(0, tree.shards, 1, tasks).mapInPandas(draw, "shard long, slot long, source_index int, turn long, block long, words long")

    def blocks(self, *more: str) -> DataFrame:
        """source_index, block, a row's key (chunk, n) and the words of it there: from_word in the row, at in the block, length."""
        end, b = F.col("start") + F.col("size"), F.lit(self.block)
        first = F.floor(F.col("start") / b)
        each = F.when(F.col("size") > 0, F.sequence(first, F.floor((end - 1) / b)))
        rows = self.sizes.select("source_index", "chunk", "n", "start", "size", *more, F.explode_outer(each).alias("block"))
        low = F.greatest(F.col("start"), F.col("block") * b)
        return rows.select("source_index", "block", "chunk", "n", *more, "size", (low - F.col("start")).alias("from_word"), (low - F.col("block") * b).alias("at"), (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - low).alias("length"))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: one row per row of the table."""
        times = self.slots().groupBy("source_index", "block", "words").agg(F.count("*").alias("times"))
        got = F.col("times") * F.greatest(F.least(F.col("words") - F.col("at"), F.col("length")), F.lit(0))
        met = self.blocks("doc_id", "source_size", "target").join(times.hint("merge"), ["source_index", "block"], "left")  # both sides grow with the table
        return met.groupBy("source_index", "chunk", "n", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum(got), F.lit(0)).cast("long").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")

    def texts(self, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
        """The kept columns, once for each pass that takes words of a row, its text cut down to those words in their order."""
        hits = self.blocks().join(self.slots().hint("merge"), ["source_index", "block"]).withColumn("got", F.least(F.col("words") - F.col("at"), F.col("length"))).filter("got > 0")
        runs = hits.groupBy("source_index", "chunk", "n", "turn").agg(F.array_sort(F.collect_list(F.struct("from_word", "got"))).alias("runs"))
        rows = self.sizes.select("source_index", "chunk", "n", "row").join(runs, ["source_index", "chunk", "n"])
        words = F.regexp_extract_all(F.col(f"row.{text}"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
        # bound to a variable, the words are split once for all runs
        of = lambda w: F.flatten(F.transform("runs", lambda r: F.slice(w, (r["from_word"] + 1).cast("int"), r["got"].cast("int"))))
        cut = F.array_join(F.transform(F.array(words), of)[0], "")
        out = rows.withColumn("cut", cut)
        names = self.sizes.schema["row"].dataType.names
        return out.select(*[F.col("cut").alias(c) if c == text else F.length("cut").cast("long").alias(c) if c == n_chars else F.col(f"row.`{c}`").alias(c) for c in names])
