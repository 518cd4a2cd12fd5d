"""Containment joins, numbering and fills over tasks, requests as a table, imports by upload."""

import random

import pytest
from pyspark.sql import functions as F

from taskloom.operators import segment, sheets
from taskloom.sources import pool


def keyed(t):
    import re

    return re.sub("[^a-zäöüß0-9]+", " ", t.lower()).strip()


def fits(a, b):
    a, b = keyed(a), keyed(b)
    return a == b or (len(a) > 3 and (a in b or b in a))


@pytest.mark.parametrize("by", [[], ["upload"]])
def test_first_match_when_all_titles_begin_alike(spark, by):
    rng = random.Random(6)
    words = ["Terme", "Terme und Klammern", "x", "ab", "Brüche", "Brüche kürzen", "", "der Größe nach ordnen", "Winkel"]
    rows = [(i, i % 3, f"Aufgabe {rng.choice(words)} {rng.choice(['', '7', 'a'])}" if i % 7 else rng.choice(words)) for i in range(150)]
    expected = [(i, i % 3, f"Aufgabe {rng.choice(words)}" if i % 5 else rng.choice([*words, "auf", "gabe"])) for i in range(60)]
    got = segment.first_match(spark.createDataFrame(rows, "draft_id long, upload long, title string"), spark.createDataFrame(expected, "ord long, upload long, title string"), *by)
    want = {i: min((o for o, v, e in expected if fits(t, e) and (not by or u == v)), default=None) for i, u, t in rows}
    assert {r.draft_id: r.ord for r in got.collect()} == want


def test_shared_beginnings_bring_no_titles_together(spark):
    n = 400
    rows = spark.createDataFrame([(f"aufgabe nummer {i:04d} der reihe",) for i in range(n)], "s string")
    long = spark.createDataFrame([(f"zur aufgabe nummer {i:04d} der reihe", i) for i in range(n)], "l string, ord long")
    found = segment._contained(rows, long)
    assert found.count() == n
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_document_with_a_third_of_all_lines(spark):
    rng = random.Random(7)
    rows = [(d, i, rng.random() < 0.1, rng.choice([None, None, i])) for d, n in [(1, 400), *((k, 8) for k in range(2, 90))] for i in range(n)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "doc long, line_no long, start boolean, page long").repartition(5)
    got = {(r.doc, r.line_no): r.segment for r in segment.segments(df, F.col("start")).collect()}
    filled = {(r.doc, r.line_no): r.page for r in segment.forward_fill(df, "doc", "line_no", "page").collect()}
    want, pages, n, page, at = {}, {}, 0, None, None
    for d, i, start, p in sorted(rows, key=lambda r: r[:2]):
        n, page, at = (n, page, at) if d == at else (0, None, d)
        n, page = n + start, p if p is not None else page
        pages[d, i] = page
        if n:
            want[d, i] = n
    assert got == want and filled == pages


def test_numbers_of_one_long_sheet(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("ord")).repartition(6)
    got = sheets.numbered(df)
    assert [(r.number, r.grid_row, r.grid_col) for r in got.orderBy("ord").collect()] == [(i + 1, i // 3, i % 3) for i in range(1000)]
    assert not [n for n in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in n and "ord" in n]


def test_requests_as_a_table(spark, tmp_path):
    cat = spark.createDataFrame([("7", "Terme", "Mathematik", "a", 0), ("7", "Terme", "Modellieren", "b", 1), ("8", "Körper", "Mathematik", "c", 2)], "class_level string, topic string, competence string, source_id string, ord long")
    asked = spark.createDataFrame([(1, "7", "Terme"), (2, "8", "Körper"), (3, "9", "Terme"), (4, "7", None), (5, "", "Terme")], "n long, class_level string, topic string")
    got = {(r.n, r.competence): r.error or r.source_id for r in pool.sources_of(cat, asked, ["Mathematik", "Modellieren"]).collect()}
    required = "class and topic are required"
    assert got == {(1, "Mathematik"): "a", (1, "Modellieren"): "b", (2, "Mathematik"): "c", (2, "Modellieren"): "no source for Modellieren", **{(3, c): "no sources for class 9, topic Terme" for c in ("Mathematik", "Modellieren")}, **{(n, c): required for n in (4, 5) for c in ("Mathematik", "Modellieren")}}
    path = f"{tmp_path}/pool"
    pool.write_pool(spark.createDataFrame([(i, str(7 + i % 3), "Terme" if i % 2 else "Körper", "Mathematik") for i in range(60)], "task long, class_level string, topic string, competence string"), path)
    found = pool.scan_requests(spark, path, asked)
    assert sorted((r.n, r.task) for r in found.collect()) == sorted((n, i) for n, level, topic in ((1, "7", "Terme"), (2, "8", "Körper"), (3, "9", "Terme")) for i in range(60) if (str(7 + i % 3), "Terme" if i % 2 else "Körper") == (level, topic))
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("FileScan") == 1


def test_classes_in_german_order(spark):
    names = ["10", "Übung", "9", "Zebra", "Ufer", "11", "Oberstufe", "Öffnung", "7"]
    rows = spark.createDataFrame([(n,) for n in names], "level string").orderBy(*pool.class_order(F.col("level"))).collect()
    assert [r.level for r in rows] == ["7", "9", "10", "11", "Oberstufe", "Öffnung", "Übung", "Ufer", "Zebra"]


@pytest.mark.parametrize("by", [[], ["upload"]])
def test_pieces_of_titles_are_not_sent_through_the_driver(spark, by):
    short = spark.createDataFrame([(1, f"nummer {i}") for i in range(20)], "upload long, s string")
    long = spark.createDataFrame([(1, f"aufgabe nummer {i} der reihe", i) for i in range(20)], "upload long, l string, ord long")
    found = segment._contained(short.select(*by, "s"), long.select(*by, "l", "ord"), *by)
    assert {(r.s, r.l) for r in found.collect()} == {(f"nummer {i}", f"aufgabe nummer {j} der reihe") for i in range(20) for j in range(20) if f"nummer {i}" in f"aufgabe nummer {j} der reihe"}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_written_tables_of_many_rows_are_not_broadcast(spark, monkeypatch):
    from taskloom import scratch
    from taskloom.operators import layout

    rows = scratch.written(spark.range(50).select(F.lit("x").alias("k"), "id"))
    other = scratch.written(spark.range(900).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")))
    plan = lambda: layout.by_rows(rows).join(other, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(layout, "FEW", 49)
    assert "Broadcast" not in plan() and "SortMergeJoin" in plan()
