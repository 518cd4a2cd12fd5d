"""Segmented prefix scans over a global order: running counts, running sums, last value seen.

A window with ``partitionBy`` puts each key into one task, and a window without it puts everything there. Here rows
are dealt by ranges of (keys, order), so a key may span any number of tasks: each task scans its own range, its last
row is what it hands on, and these rows (one a task) are summed into what every following range starts with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch

PART, LAST = "__part", "__last"


def _changes(batch, keys: list[str], before) -> np.ndarray:
    """Whether each row begins another key than the row before; nulls are a value. ``before``: the keys of the row before the batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    new = np.zeros(batch.num_rows, bool)
    new[0] = before is None
    for i, k in enumerate(keys):
        c = batch.column(k)
        if pa.types.is_floating(c.type):  # -0.0 and 0.0, and all NaN, are one key for Spark
            c = pc.if_else(pc.is_nan(c), pa.scalar(float("nan"), c.type), pc.add(c, pa.scalar(0.0, c.type)))
            same = pc.or_kleene(pc.equal(c[1:], c[:-1]), pc.and_(pc.is_nan(c[1:]), pc.is_nan(c[:-1])))
        else:
            same = pc.equal(c[1:], c[:-1])
        gone = c.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= np.where(gone[1:] | gone[:-1], gone[1:] != gone[:-1], ~pc.fill_null(same, False).to_numpy(zero_copy_only=False))
        a, b = (before[i] if before else None), c[0].as_py()
        if before is not None and a != b and (a == a or b == b):
            new[0] = True
    return new


def _scanned(keys: list[str], count: str | None, sums: dict[str, str], fills: dict[str, str]):
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, held = TaskContext.get().partitionId(), None, None
        n, total, seen = 0, dict.fromkeys(sums, 0), dict.fromkeys(fills)
        for b in batches:
            if not b.num_rows:
                continue
            new = _changes(b, keys, before)
            before = [b.column(k)[b.num_rows - 1].as_py() for k in keys]
            at = np.arange(b.num_rows)
            start = np.maximum.accumulate(np.where(new, at, -1))  # -1: the key of the batch before goes on
            cols = list(b.columns)
            if count:
                own = np.where(start < 0, at + 1 + n, at - start + 1)
                n = int(own[-1])
                cols.append(pa.array(own))
            for out, c in sums.items():
                run_sum = np.cumsum(pc.fill_null(b.column(c), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                own = run_sum - np.where(start > 0, run_sum[np.maximum(start, 1) - 1], 0) + np.where(start < 0, total[out], 0)
                total[out] = int(own[-1])
                cols.append(pa.array(own))
            for out, c in fills.items():
                source = b.column(c)
                valid = source.is_valid().to_numpy(zero_copy_only=False)
                last = np.maximum.accumulate(np.where(valid, at, -1))
                inside = last >= np.maximum(start, 0)
                own = source.take(pa.array(np.where(inside, last, 0), mask=~inside))
                if seen[out] is not None and (open_ := (start < 0) & ~inside).any():
                    own = pc.if_else(pa.array(open_), pa.scalar(seen[out], source.type), own)
                seen[out] = own[b.num_rows - 1].as_py()
                cols.append(own)
            if held is not None:
                yield held
            names = [*b.schema.names, *([count] if count else []), *sums, *fills, PART, LAST]
            held = pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(at), part, np.int32)), pa.array(np.zeros(len(at), bool))], names)
        if held is not None:
            flag = np.zeros(held.num_rows, bool)
            flag[-1] = True
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(flag)], held.schema.names)

    return run


def scan(df: DataFrame, keys: list[str], order: list[str], count: str | None = None, sums: dict[str, str] | None = None, fills: dict[str, str] | None = None) -> DataFrame:
    """``df`` with running values within each key, in ``order``: ``count`` names a column of places from 1, ``sums``
    maps new columns to the integer columns that they sum up to the row, ``fills`` to those whose last value that is
    not null they hold.

    Nulls come first in the order and are keys like others; a null summand counts as 0. No ``keys``: one sequence over
    the whole table. Rows equal in keys and order stand in any order and in one task. The scanned rows are a table
    in the shared folder (``.scratch``), with a row for each task's end that is read into a broadcast of as many rows.
    """
    sums, fills = sums or {}, fills or {}
    spark = df.sparkSession
    at = [*keys, *order]
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *at).sortWithinPartitions(*at)
    own = {**({count: T.LongType()} if count else {}), **dict.fromkeys(sums, T.LongType()), **{o: df.schema[c].dataType for o, c in fills.items()}}
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema), *(T.StructField(o, t) for o, t in own.items()), T.StructField(PART, T.IntegerType()), T.StructField(LAST, T.BooleanType())])
    out = scratch.written(dealt.mapInArrow(_scanned(keys, count, sums, fills), schema), "scan")
    names = [f"__c{i}" for i in range(len(own))]
    run = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, 0)
    handed = [(F.last(o, ignorenulls=True) if o in fills else F.sum(o)).over(run).alias(c) for o, c in zip(own, names)]
    ends = out.where(LAST).select(PART, *keys, *own)  # one row a task
    ends = ends.withColumn("__next", F.lead(PART).over(Window.orderBy(PART))).select("__next", *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *handed)
    on = F.col(PART) == F.col("__next")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = out.join(F.broadcast(ends.where("__next is not null")), on, "left")
    values = [(F.coalesce(o, c) if o in fills else F.col(o) + F.coalesce(F.col(c), F.lit(0))).alias(o) for o, c in zip(own, names)]
    done = joined.select(*(F.col(c) for c in df.columns), *values)
    done.scratch = out.scratch
    return done
