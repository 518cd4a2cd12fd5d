"""Intermediate tables of the library: written once to the shared folder, deleted when they are no longer read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: set[str] = set()


def path(spark: SparkSession, tag: str = "core") -> str:
    """A new path in the folder that the cluster names; on one machine, where none is named, in a temporary folder.

    What is left under such paths is deleted when the driver's Python ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="taskloom-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = f"file://{_own[0]}"
    if not _written:
        atexit.unregister(release)
        atexit.register(release)  # after the JVM was started, so it runs while that is still there
    out = f"{root.rstrip('/')}/taskloom/{tag}-{uuid.uuid4().hex}"
    _written.add(out)
    return out


def written(df: DataFrame, tag: str = "core") -> DataFrame:
    """``df`` as a table in the shared folder, which outlives any executor; ``.scratch`` names its path."""
    spark = df.sparkSession
    where = path(spark, tag)
    df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out.scratch = where
    return out


def delete(spark: SparkSession | None, where: str) -> None:
    jvm = SparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(where)
    conf = spark.sparkContext._jsc.hadoopConfiguration() if spark else jvm.org.apache.hadoop.conf.Configuration()
    p.getFileSystem(conf).delete(p, True)
    _written.discard(where)


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind DataFrames of :func:`written`, once nothing reads them any more."""
    for df in frames:
        delete(df.sparkSession, df.scratch)


def release() -> None:
    for where in list(_written):
        try:
            delete(None, where)
        except Exception:  # the JVM or the store is gone already
            return
