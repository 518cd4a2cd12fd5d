"""Shared plumbing of the training-data operators: scratch tables and small helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []
_written: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is named, on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="taskloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is left there is deleted when the driver's Python ends."""
    if not _written:
        atexit.unregister(release)
        atexit.register(release)  # after the JVM was started, so it runs while that is still there
    path = f"{scratch_root(spark)}/taskloom/{tag}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, tag: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts the lineage.

    Unlike a cache, the table outlives any executor. ``batch_rows``: rows that go to a Python worker at a time
    while the table is written, for rows that may be large.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(_ARROW_ROWS)
    try:
        if batch_rows:
            spark.conf.set(_ARROW_ROWS, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW_ROWS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind DataFrames from :func:`materialize`, once nothing reads them any more."""
    for df in frames:
        delete(df.sparkSession, df.scratch)


def delete(spark: SparkSession | None, path: str) -> None:
    jvm = SparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration() if spark else jvm.org.apache.hadoop.conf.Configuration()
    p.getFileSystem(conf).delete(p, True)
    _written.discard(path)


def release(spark: SparkSession | None = None) -> None:
    """Delete all scratch tables that are left; their readers must have ended."""
    for path in list(_written):
        try:
            delete(spark, path)
        except Exception:  # the JVM or the store is gone already
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SLICE = 1 << 20


def _row_bytes(b) -> np.ndarray:
    """About the bytes that each row holds in texts, binaries and lists."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = np.full(b.num_rows, 16, np.int64)
    for c in b.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type):
            size += 16 * pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return size


def slices(batches, most: int = SLICE, rows: int = 8192):
    """Arrow batches in pieces of ``most`` bytes and ``rows`` rows at most; a longer row is a piece of its own.

    At the end, free memory goes back to the system: workers live on from task to task, and what one
    operator has freed is no use to the JVM.
    """
    for b in batches:
        end, at = np.cumsum(_row_bytes(b)), 0
        while at < b.num_rows:
            room = (end[at - 1] if at else 0) + most
            stop = min(max(at + 1, int(np.searchsorted(end, room, "right"))), at + rows)
            yield b.slice(at, stop - at)
            at = stop
    give_back()


def give_back() -> None:
    """Free memory of this process goes back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def whole_groups(batches, keys: list[str]):
    """Tables of whole groups, from Arrow batches in which rows of equal keys stand together."""
    import pyarrow as pa

    held: list = []

    def table_of(parts: list):
        return pa.Table.from_batches(parts).combine_chunks()

    def differs(a, b) -> bool:
        return any(a.column(k)[a.num_rows - 1].as_py() != b.column(k)[0].as_py() for k in keys)

    for b in batches:
        if not b.num_rows:
            continue
        if held and differs(held[-1], b):
            yield table_of(held)
            held = []
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            c = b.column(k)
            gone, value = c.is_null().to_numpy(zero_copy_only=False), c.fill_null(0).to_numpy(zero_copy_only=False)
            new[1:] |= (gone[1:] != gone[:-1]) | (value[1:] != value[:-1])
        cut = int(np.nonzero(new)[0][-1]) if new.any() else 0
        if cut:
            yield table_of([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield table_of(held)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n in taken:
            n = f"_{n}"
        taken.add(n)
        out.append(n)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Keys that so large a part of all rows have are hot; there are as many at most.
HOT_PART = 256


def look_up(rows: DataFrame, named: DataFrame, keys: list[str], count_col: str) -> DataFrame:
    """``rows`` with the columns of ``named``, which holds each of their keys once, and in ``count_col`` how many rows have it.

    Hot keys, 256 at most by their share of the rows, are broadcast, so their rows stay where they are; the others are
    shuffled. Both tables are read twice and should be written ones. Keys are not null; rows whose key is not named go;
    repeated rows stay; empty tables give none.
    """
    total = named.agg(F.sum(count_col)).first()[0] or 0
    large = F.col(count_col) * HOT_PART >= total
    hot, rest = named.where(large).drop(count_col), named.where(~large).drop(count_col)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(others.join(rest, keys))


def first_rows(rows: DataFrame, order: list[str], text_col: str, most_rows: int, most_bytes: int) -> DataFrame:
    """The first rows by ``order``: at most so many, and bytes of text; the very first in any case."""
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # over most_rows rows
    limited = rows.orderBy(*order).limit(most_rows)
    taken = F.coalesce(F.sum(F.octet_length(text_col)).over(so_far), F.lit(0)) + F.octet_length(text_col)
    return limited.withColumn("__taken", taken).withColumn("__n", F.row_number().over(Window.orderBy(*order))).where((F.col("__taken") <= most_bytes) | (F.col("__n") == 1)).drop("__taken", "__n").orderBy(*order)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
