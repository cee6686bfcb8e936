"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that a set may have at most to be sent to every executor (8 bytes each, so about 16 MB with its hash table); digests may be a fifth as many.
BROADCAST_IDS = 500_000


_KEPT: dict = {}


def once(key, make):
    """make() of this key, kept by this process for its next tasks, in place of what it kept before.

    Functions that Spark ships take their module's variables along as copies; this one they find by name, so that it keeps what it made.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    """Arrow batches of few rows: texts may be long, and a worker holds a whole batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name under spark.checkpoint.dir, which driver and executors share; a local one only where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.doctally.local.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="doctally-")
        spark.conf.set("spark.doctally.local.dir", base)
    return f"{base.rstrip('/')}/doctally/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the folders of materialised frames that no plan needs any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_name(columns: list[str], name: str) -> str:
    """A column name with which no name among the columns begins, whatever their case."""
    while any(c.lower().startswith(f"_{name}") for c in columns):
        name = f"_{name}"
    return f"_{name}"


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is not in keys (null keys stay).

    keys is materialised first; the set goes to every executor only if its counted size allows, else both sides are shuffled.
    """
    keys = materialise(keys.select(key).distinct())
    keys = keys.hint("broadcast") if keys.count() <= BROADCAST_IDS // 5 else keys.hint("merge")
    return df.join(keys, key, "left_anti")


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
