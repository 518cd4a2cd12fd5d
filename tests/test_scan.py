"""Segmented scans against plain loops, with keys that span tasks."""

import random

import pytest

from taskloom.operators.scan import scan


def plain(rows, keys, order):
    rows = sorted(rows, key=lambda r: tuple((r[c] is not None, r[c] if r[c] is not None else 0) for c in keys + order))
    out, last = [], object()
    for r in rows:
        if (k := tuple(r[c] for c in keys)) != last:
            last, n, total, seen = k, 0, 0, None
        n, total, seen = n + 1, total + (r["v"] or 0), r["w"] if r["w"] is not None else seen
        out.append((r["id"], n, total, seen))
    return sorted(out)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("batch", ["3", "10000"])
def test_scan_equals_a_loop(spark, keys, batch):
    rng = random.Random(5)
    ks = ["a"] * 300 + ["b", "c", None] * 30 + ["d"] * 200  # "a" holds over half of all rows
    rows = [{"id": i, "k": k, "o": i * 7919 % 1009, "v": rng.choice([None, 1, -2, 10**12]), "w": rng.choice([None, None, "x", "y"])} for i, k in enumerate(ks)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, k string, o long, v long, w string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = scan(df, keys, ["o", "id"], "n", {"total": "v"}, {"seen": "w"})
        assert sorted((r.id, r.n, r.total, r.seen) for r in got.collect()) == plain(rows, keys, ["o", "id"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_scan_of_nothing_and_of_one_row(spark):
    empty = spark.createDataFrame([], "k long, o long, v long")
    assert scan(empty, ["k"], ["o"], "n", {"s": "v"}, {"f": "v"}).collect() == []
    one = spark.createDataFrame([(None, 1, None)], "k long, o long, v long")
    assert [tuple(r) for r in scan(one, ["k"], ["o"], "n", {"s": "v"}, {"f": "v"}).collect()] == [(None, 1, None, 1, 0, None)]


def test_floating_keys(spark):
    df = spark.createDataFrame([(0.0, 1), (-0.0, 2), (float("nan"), 3), (float("nan"), 4), (None, 5)], "k double, o long")
    assert sorted(r.n for r in scan(df, ["k"], ["o"], "n").collect()) == [1, 1, 1, 2, 2]
