"""Deterministic sharded WARC writer and reader.

Writing: payload digests are computed and records of equal payload found (the smallest id of a group is its `response`, the others are
`revisit` records that refer to it); records are range-sorted by id; each task writes its range as gzip-per-record archives and rolls to the
next file once the compressed size passes a limit. Headers and digests are made anew from the payload, and record ids and dates from the
record's id, so the same rows give the same records. A file is written under a temporary name of its own attempt and moved to its final name when complete;
a second attempt of a task writes the same bytes to the same names. A manifest (file, records, bytes, SHA-256) is written last and commits the archive.

Reading: the manifest's rows are dealt out, each task opens the archives that its rows name and parses them member by member. Lengths, sums, numbers of records and
digests are checked; a file that the manifest doesn't list, as a failed attempt leaves it, is never opened.

Group sizes: digests are pre-aggregated with their smallest id; only groups of two or more are looked up again, by broadcast if their count allows,
else the few largest (each at least a thousandth of all copies, so a thousand at most) by broadcast and the others by a shuffled join.

Nulls: a null payload is empty, a null url an empty target; a null id sorts last, gets a nil record id and is read back as null. Repeated rows give a record each: of
rows with equal payload all that have the smallest id are responses. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir

FILE_BYTES = 8 << 20
#: Bytes of archives that a task reads, about.
TASK_BYTES = 64 << 20
#: Groups of equal payloads that may be sent to every executor (some 100 bytes each).
BROADCAST_GROUPS = 100_000
#: Fixed value: the date that all records bear.
DATE = "2024-01-01T00:00:00Z"
_NAMED = re.compile(rb"\r\n([^:\r\n]+):[ \t]*([^\r\n]*)")


def record_id(key: int | None) -> str:
    """A custom (version 8) UUID that holds the 64-bit id."""
    if key is None:
        return "urn:uuid:" + str(uuid.UUID(int=0))
    k = key & (1 << 64) - 1
    return "urn:uuid:" + str(uuid.UUID(int=(0xD0C << 116) | 8 << 76 | (k >> 62) << 64 | 2 << 62 | k & (1 << 62) - 1))


def key_of(record: str) -> int | None:
    n = uuid.UUID(record.removeprefix("urn:uuid:")).int
    if not n:
        return None
    k = (n >> 64 & 3) << 62 | n & (1 << 62) - 1
    return k - (1 << 64) if k >> 63 else k


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int | None, url: str, payload: bytes, refers_to: int | None, response: bool) -> bytes:
    """One gzip member with a response, or a revisit that has the payload's headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if response else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: <{record_id(key)}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if not response:
        head += [f"WARC-Refers-To: <{record_id(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, in time that grows with its bytes."""
    view, at = memoryview(data), 0
    while at < len(view):
        squeeze, parts, step = zlib.decompressobj(31), [], 1024
        while not squeeze.eof:  # by growing steps: what a step reads beyond the record's end is read again
            if at == len(view):
                raise ValueError("the archive ends within a record")
            part = view[at : at + step]
            parts.append(squeeze.decompress(part))
            at, step = at + len(part), min(2 * step, 1 << 20)
        at -= len(squeeze.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = {k.decode().lower(): v.decode() for k, v in _NAMED.findall(head)}
        block = rest[: int(headers["content-length"])]
        if headers["warc-block-digest"] != f"sha1:{digest(block)}":
            raise ValueError("a block's digest is wrong")
        yield headers, block


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class _Shards:
    """The files of one task: temporary until complete."""

    def __init__(self, folder: str, part: int, attempt: int, limit: int):
        self.fs, self.folder = _store(folder)
        self.part, self.attempt, self.limit, self.count = part, attempt, limit, 0
        self.out = None

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            name = f"part-{self.part:05d}-{self.count:05d}"
            self.final = f"{self.folder}/{name}.warc.gz"
            self.temporary = f"{self.folder}/_temporary-{name}-{self.attempt}"
            self.out, self.records, self.size, self.sum = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.records, self.size = self.records + 1, self.size + len(data)
        self.sum.update(data)
        if self.size >= self.limit:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, self.final)
            yield os.path.basename(self.final), self.records, self.size, self.sum.hexdigest()
            self.out, self.count = None, self.count + 1


def with_originals(rows: DataFrame, id_col: str = "_id", payload_col: str = "_payload", revisit_from: int = 0) -> DataFrame:
    """rows and _refers: the smallest id among rows of equal payload, of at least so many bytes, if that is another."""
    keyed = rows.withColumn("_sha", F.sha1(F.col(payload_col))).withColumn("_size", F.length(F.col(payload_col)))
    grouped = keyed.where(F.col("_size") >= revisit_from).groupBy("_sha", "_size").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = materialise(grouped.where("_n > 1"))
    groups, copies = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if groups <= BROADCAST_GROUPS:
        joined = keyed.join(F.broadcast(repeated.select("_sha", "_size", "_first")), ["_sha", "_size"], "left")
    else:
        hot = repeated.where(F.col("_n") * 1000 >= copies).select("_sha", "_size", F.col("_first").alias("_hot"))  # a thousand groups at most
        usual = repeated.where(F.col("_n") * 1000 < copies).select(F.concat_ws(":", "_sha", "_size").alias("_key"), "_first")
        keyed = keyed.join(F.broadcast(hot), ["_sha", "_size"], "left")
        # rows of hot groups need no second look-up: their join key is their own
        own = F.concat_ws(":", F.lit("hot"), F.xxhash64(id_col))
        keyed = keyed.withColumn("_key", F.when(F.col("_hot").isNull(), F.concat_ws(":", "_sha", "_size")).otherwise(own))
        joined = keyed.join(usual.hint("merge"), "_key", "left").withColumn("_first", F.coalesce("_hot", "_first")).drop("_hot", "_key")
    refers = F.when(F.col(id_col).isNull() | (F.col("_first") != F.col(id_col)), F.col("_first"))
    return joined.withColumn("_refers", refers).drop("_sha", "_size", "_first")


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES, revisit_from: int = 0, shards: int | None = None) -> DataFrame:
    """Write the archives into the folder, which all executors can reach; returns the manifest."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(url_col, F.lit("")).alias("_url"), F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8").alias("_payload"))
    fs, path = _store(folder)
    fs.create_dir(path, recursive=True)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = with_originals(rows, revisit_from=revisit_from)
    # the last key lets a range end within rows that are all alike
    marked = marked.withColumn("_row", F.monotonically_increasing_id())
    ordered = marked.repartitionByRange(n, F.col("_id").asc_nulls_last(), F.xxhash64("_url", "_payload"), "_row").sortWithinPartitions(F.col("_id").asc_nulls_last(), F.xxhash64("_url", "_payload"), "_url", "_payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        shards, done = _Shards(folder, task.partitionId(), task.taskAttemptId(), file_bytes), []
        for batch in batches:
            ids, refers = batch["_id"].astype("object"), batch["_refers"].astype("object")
            for key, url, payload, other in zip(ids, batch["_url"], batch["_payload"], refers, strict=True):
                key, other = (None if pd.isna(x) else int(x) for x in (key, other))
                done += shards.add(record(key, url, bytes(payload), other, other is None))
        done += shards.close()
        if done:
            yield pd.DataFrame(done, columns=["file", "records", "bytes", "sha256"])

    manifest = ordered.mapInPandas(run, "file string, records long, bytes long, sha256 string")
    manifest.write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives that the manifest lists, and of no other file; a missing, longer, shorter or changed archive is an error."""
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    manifest = spark.read.parquet(f"{folder}/_manifest")
    size = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _store(folder)
        for batch in batches:
            for name, records, size, sha in zip(batch["file"], batch["records"], batch["bytes"], batch["sha256"], strict=True):
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    content = stream.read()
                if len(content) != size or hashlib.sha256(content).hexdigest() != sha:
                    raise ValueError(f"{name} is not the archive that the manifest lists")
                rows, seen = [], 0
                for headers, block in parse(content):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    refers = headers.get("warc-refers-to")
                    rows.append((key_of(headers["warc-record-id"][1:-1]), headers["warc-target-uri"], headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:"), length, key_of(refers[1:-1]) if refers else None, payload if not refers else None))
                    if not refers and digest(payload) != rows[-1][3]:
                        raise ValueError("a payload's digest is wrong")
                    seen += 1
                    if len(rows) >= 1000:
                        yield _frame(rows)
                        rows = []
                if seen != records:
                    raise ValueError(f"{name} has {seen} records, the manifest lists {records}")
                yield _frame(rows)

    return manifest.repartition(parts, "file").mapInPandas(run, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"], dtype=object)
    return out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def op5_warc(spark, sf_dir):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    folder = shared_dir(spark)
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
