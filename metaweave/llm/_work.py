"""Shared working tables: where an operator cuts lineage and keeps intermediate rows."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where it is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="metaweave-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


BATCH_BYTES = 8 << 20
#: Bytes of a saved table that a join may broadcast.
MOST_BYTES = 256 << 20


class Work:
    """Tables of one operator run, each written once and reread, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        # Arrow batches that fit several times into a small Python worker, whatever the rows' size
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._work_path = path
        return out

    def sized(self, df: DataFrame, most_rows: int, name: str = "t") -> DataFrame:
        """The saved rows, to be broadcast in a join if they are counted to be most_rows at most and their files MOST_BYTES; beyond it the join shuffles."""
        saved = self.save(df, name)
        return F.broadcast(saved) if saved.count() <= most_rows and self.bytes(saved) <= MOST_BYTES else saved

    def bytes(self, saved: DataFrame) -> int:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(saved._work_path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.remove(t._work_path)

    def sweep(self) -> None:
        """Lets Spark's cleaner find the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def remove(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def mkdir(self, name: str) -> str:
        path = f"{self.path}/{name}"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(where)
        return path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
