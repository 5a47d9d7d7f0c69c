"""Connected components of ids: links that fit a task are joined up there, more by minima that spread over joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaweave.session import saved

#: Links that one task joins up at once.
PER_TASK = 1 << 18
CHUNK = 1 << 20


def _least(links: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(node, least id reachable) of these links; places in the order of ids stand for them."""
    t = pa.Table.from_batches(links)
    both = pa.chunked_array([*t.column(0).chunks, *t.column(1).chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(both.dictionary)
    place = np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    at, ids = place[both.indices.to_numpy()], both.dictionary.take(order)
    u, v, label = at[: t.num_rows], at[t.num_rows :], np.arange(len(ids))
    while (label[u] != label[v]).any():
        np.minimum.at(label, np.maximum(label[u], label[v]), np.minimum(label[u], label[v]))
        while (label[label] != label).any():
            label = label[label]
    return pa.RecordBatch.from_arrays([ids, ids.take(pa.array(label))], ["node", "component"])


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least id reachable) of all links of a task."""
    links = [b for b in batches if b.num_rows]
    if links:
        yield _least(links)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task, chunk by chunk, as stars to the least id that each node reaches within its chunk: a node has one link for each chunk."""

    def star(links: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = _least(links)
        x = x.filter(pc.not_equal(x.column(0), x.column(1)))
        return pa.RecordBatch.from_arrays(x.columns, ["u", "v"])

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= CHUNK:
            yield star(held)
            held, n = [], 0
    if held:
        yield star(held)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (least id reachable): stars drawn to the least neighbour in turn until nothing moves.

    Before the first round links are dealt by range and joined up chunk by chunk, so that rounds work on a link for each
    node of a chunk; where ids near each other are linked that is about a link a node.
    """
    e = saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v"), "links")
    mark, kind, n = None, e.schema["u"].dataType.simpleString(), e.count()
    if n > PER_TASK:
        # chunks are of neighbouring ids, and whole ones where there are so many links
        e = saved(e.repartitionByRange(max(1, -(-n // CHUNK)), "u").mapInArrow(_stars, f"u {kind}, v {kind}"), "joined")
        n = e.count()
    if n <= PER_TASK:
        return _with_loops(links, e.coalesce(1).mapInArrow(_joined_up, f"node {kind}, component {kind}"), a, b)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        e = saved(small.select("x.*").filter("u <> v").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    stars = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return _with_loops(links, stars, a, b)


def _with_loops(links: DataFrame, stars: DataFrame, a: str, b: str) -> DataFrame:
    stars = saved(stars, "components")
    loops = links.filter(F.col(a) == F.col(b)).select(F.col(a).alias("node")).distinct().join(stars, "node", "left_anti")
    return stars.unionByName(loops.select("node", F.col("node").alias("component")))
