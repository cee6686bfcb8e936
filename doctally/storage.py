"""Tables in the folder that driver and executors share: spark.checkpoint.dir, or, in a local session without one, a temporary folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder name; a cluster must name the shared folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.doctally.core.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="doctally-")
        spark.conf.set("spark.doctally.core.dir", base)
    return f"{base.rstrip('/')}/doctally/{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """rows written to the shared folder and read again: the lineage is cut, and lost executors cost no more than a retry."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def filesystem(path: str):
    """pyarrow's file system of a folder and the folder's name in it, for workers that read parts of a stored table."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
