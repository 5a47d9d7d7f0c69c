"""WARC archives: a deterministic sharded writer, and a reader.

Records are range-sorted by page_id into shards whose bounds are quantiles of a hash sample of the ids, so the same
table always gives the same shards. Each shard is written as gzip members in files that roll when their compressed size
passes a limit. Headers and digests are regenerated from the payload; nothing in a file depends on when or where it was
written. A file is written under a temporary name, moved to its own, and counts only once the manifest lists it, so
a task that is lost or run twice leaves no trace.

Of records with equal payloads of at least revisit_bytes, that with the largest page_id is the response, the others
are revisits of it without a payload (identical-payload-digest).

Defined cases: a null payload is empty; a null page_id is written as such, sorted first, and is response only if no
other record has its payload; rows equal in page_id and payload are told apart by a number, the first is the response;
a null url is the empty one; other columns are ignored; an empty table gives no file and an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ._work import Work

MANIFEST = "file string, shard long, records long, bytes long, sha256 string, first_page long, last_page long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Fixed names of the WARC 1.1 format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Rows of a counted side that a join may broadcast.
MOST_BROADCAST = 500_000
#: Files that a task reads.
FILES_A_TASK = 2


def marked(work: Work, df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(page_id, url, payload, digest, n (number among equal rows), revisit, refers_to; page_id, digest, bytes). Only digests are shuffled."""
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = df.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    narrow = work.save(rows.select("page_id", "digest", F.octet_length("payload").alias("bytes")), "digests")
    large = narrow.filter(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    twice = narrow.groupBy("digest", "page_id").agg(F.count("*").alias("copies")).filter("copies > 1").select(F.col("digest").alias("d"), F.col("page_id").alias("p"))
    twice = work.sized(twice, MOST_BROADCAST, "twice")
    same = (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p"))
    number = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url")) - 1
    rows = rows.join(twice, same, "left_anti").withColumn("n", F.lit(0)).unionByName(rows.join(twice, same, "left_semi").withColumn("n", number))
    rows = rows.join(work.sized(large, MOST_BROADCAST, "large"), "digest", "left")
    revisit = F.col("largest").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("largest")) | (F.col("n") > 0))
    return rows.select("page_id", "url", "payload", "digest", "n", F.coalesce(revisit, F.lit(False)).alias("revisit"), F.when(revisit, F.col("largest")).alias("refers_to")), narrow


def bounds(df: DataFrame, shards: int, each: int = 64) -> np.ndarray:
    """Quantiles of page_id over a sample chosen by its hash, so they depend on the rows alone: about each ids for a shard, 1024 at least."""
    if shards < 2:
        return np.zeros(0, dtype=np.int64)
    buckets = max(1, df.count() // max(1024, each * shards))
    ids = df.filter(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(buckets)) == 0)).select("page_id").distinct().toArrow()["page_id"]
    ids = np.sort(np.asarray(ids.combine_chunks(), dtype=np.int64))
    return np.unique(ids[len(ids) * np.arange(1, shards) // shards]) if len(ids) else ids


def record_id(page_id: int | None, n: int) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{n}>"


def record(page_id: int | None, n: int, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, its HTTP head regenerated; the head's Content-Length is the full payload's also in a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    b32 = lambda d: "sha1:" + base64.b32encode(d).decode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, n)), ("WARC-Date", date), ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, 0))]
    fields += [("WARC-Payload-Digest", b32(bytes.fromhex(digest))), ("WARC-Block-Digest", b32(hashlib.sha1(block).digest())), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time or name."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Roll:
    """The files of one shard: each is written under a temporary name and moved when complete."""

    def __init__(self, path: str, shard: int, limit: int):
        self.fs, self.root = pafs.FileSystem.from_uri(path)
        self.shard, self.limit, self.number = shard, limit, 0
        self._open()

    def _open(self) -> None:
        t = TaskContext.get()
        self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
        self.temp = f"{self.root}/_writing-{self.name}-{t.taskAttemptId()}"
        self.out, self.sha = self.fs.open_output_stream(self.temp), hashlib.sha256()
        self.bytes = self.records = 0
        self.first = self.last = None

    def add(self, page_id: int | None, data: bytes) -> dict | None:
        """Writes a record; the finished file's manifest row, if that filled it."""
        self.out.write(data)
        self.sha.update(data)
        self.first = page_id if not self.records else self.first
        self.last, self.bytes, self.records = page_id, self.bytes + len(data), self.records + 1
        return self.close(again=True) if self.bytes >= self.limit else None

    def close(self, again: bool = False) -> dict | None:
        self.out.close()
        if not self.records:
            self.fs.delete_file(self.temp)
            return None
        to = f"{self.root}/{self.name}"
        if self.fs.get_file_info(to).type != pafs.FileType.NotFound:
            self.fs.delete_file(to)  # an earlier attempt's, with the same bytes
        self.fs.move(self.temp, to)
        row = {"file": self.name, "shard": self.shard, "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest(), "first_page": self.first, "last_page": self.last}
        if again:
            self.number += 1
            self._open()
        return row


def write(rows: DataFrame, ids: DataFrame, path: str, shards: int, roll_bytes: int = 16 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes the marked rows, whose page_ids are ids, under path, an existing shared folder, and commits them by the table path/manifest, written by the tasks and then moved to its name; gives the manifest."""
    edges, spark = bounds(ids, shards), rows.sparkSession
    shared = spark.sparkContext.broadcast(edges)

    def shard_of(ids: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ids:
            of = batch.column("page_id")
            found = np.where(np.asarray(of.is_null()), 0, np.searchsorted(shared.value, np.asarray(pc.fill_null(of, 0)), "right"))
            yield batch.append_column("shard", pa.array(found, pa.int64()))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("shard", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_page", pa.int64()), ("last_page", pa.int64())])
        roll, done = None, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("shard", "page_id", "n", "url", "payload", "digest", "refers_to", "revisit")), strict=True):
                shard, page, n, url, payload, digest, to, revisit = (v.as_py() for v in row)
                if roll is None or roll.shard != shard:
                    done += [roll.close()] if roll else []
                    roll = Roll(path, shard, roll_bytes)
                done.append(roll.add(page, member(record(page, n, url, payload, digest, to, revisit, date))))
        done += [roll.close()] if roll else []
        yield pa.RecordBatch.from_pylist([r for r in done if r], schema=schema)

    schema = StructType([*rows.schema.fields, StructField("shard", LongType())])
    dealt = rows.mapInArrow(shard_of, schema).repartitionById(len(edges) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "digest", "n", "url")
    dealt.mapInArrow(put, MANIFEST).write.parquet(f"{path}/_manifest")
    names = [spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in ("_manifest", "manifest")]
    names[0].getFileSystem(spark._jsc.hadoopConfiguration()).rename(*names)
    return manifest(spark, path).orderBy("file")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row per committed file."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)\r\n", re.M)


def records(stream: io.RawIOBase, piece: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, decompressed one at a time."""
    held, d, out = b"", zlib.decompressobj(31), []
    while data := held or stream.read(piece):
        held = b""
        out.append(d.decompress(data))
        if d.eof:
            yield b"".join(out)
            held, d, out = d.unused_data, zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> dict:
    """A record's fields; digests are checked against what it holds."""
    if not data.startswith(VERSION):
        raise ValueError("not a WARC record")
    at = data.index(b"\r\n\r\n") + 4
    head = {k.decode(): v.decode() for k, v in FIELD.findall(data[len(VERSION) : at])}
    block = data[at : at + int(head["Content-Length"])]
    if data[at + len(block) :] != b"\r\n\r\n" or base64.b32encode(hashlib.sha1(block).digest()).decode() != head["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    cut = block.index(b"\r\n\r\n") + 4
    http = dict(FIELD.findall(block[:cut]))
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = head["WARC-Type"] == "revisit"
    payload = None if revisit else block[cut:]
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"wrong payload digest in {head['WARC-Record-ID']}")
    page = lambda u: None if (p := u.split(":")[2]) == "null" else int(p)
    return {"page_id": page(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "payload_bytes": int(http[b"Content-Length"]), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": page(head["WARC-Refers-To"]) if revisit else None, "payload": payload}


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the committed files under path."""
    fields = RECORD if with_payload else RECORD.rsplit(",", 1)[0]
    files = manifest(spark, path).select("file")
    files = files.repartition(max(1, files.count() // FILES_A_TASK))
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip([c.split()[0] for c in fields.split(", ")], types, strict=False)))

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in records(stream):
                        rows.append(parse(data))
                        size += len(data)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)

    return files.mapInArrow(open_, fields)


def round_trip(df: DataFrame, shards: int | None = None, shard_bytes: int = 16 << 20, roll_bytes: int = 16 << 20, **columns) -> DataFrame:
    """Writes df as archives under the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = df.sparkSession
    work = Work(spark, "warc")
    path = work.mkdir("archive")
    if "://" not in path:
        path = "file://" + path
    rows, ids = marked(work, df, **columns)
    size = ids.agg(F.sum("bytes").alias("n")).first().n or 0
    write(rows, ids, path, shards or max(1, size // shard_bytes), roll_bytes)
    return read(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
