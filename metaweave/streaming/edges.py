"""Edges that keep arriving: deduplicated within a watermark and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def edges(stream: DataFrame, source: str, target: str, time: str, late: str = "10 minutes") -> DataFrame:
    """n1, n2, ts of a stream of events, one for each pair and watermark."""
    e = stream.select(F.col(source).cast("string").alias("n1"), F.col(target).cast("string").alias("n2"), F.col(time).cast("timestamp").alias("ts"))
    return e.filter("n1 <> n2").withWatermark("ts", late).dropDuplicatesWithinWatermark(["n1", "n2"])


def append(e: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return e.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
