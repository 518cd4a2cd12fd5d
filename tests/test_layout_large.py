"""Costly work on small rows: it is dealt over all tasks, and done only where it is asked for."""

import pytest

from taskloom.operators import imports, segment, similarity
from taskloom.plans import reviewing

DIR = "/root/testdata/sf0.001"


def test_files_of_one_table_are_read_by_all_tasks(spark):
    assert reviewing._uploads(spark, DIR).rdd.getNumPartitions() >= 4  # one before: a task read all files of a row group


def test_corrections_are_judged_by_all_tasks(spark):
    outcomes = imports.corrected_sources(*reviewing._corrections(spark, DIR))[1]
    assert outcomes.where("page = 1").rdd.getNumPartitions() >= 4  # adaptive execution left one before


def test_a_summary_looks_no_duplicates_up(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("looked up")

    monkeypatch.setattr(similarity, "candidates", refuse)
    done = imports.import_documents(reviewing._uploads(spark, DIR), reviewing._pool(spark, DIR))
    assert done.summary.count() == spark.read.parquet(f"{DIR}/part.parquet").count()
    with pytest.raises(AssertionError):
        done.drafts  # noqa: B018


def test_drafts_of_one_expectation_meet_it_by_their_titles(spark):
    rows = spark.createDataFrame([(1, "Terme"), (2, "Terme"), (3, "x")], "id int, title string").selectExpr("*", "'' AS expectation", "named_struct('topic', 0.45D, 'competence', 0.4D, 'afb', 0.35D, 'time', 0.45D, 'expectation', 0D) AS confidence")
    expected = spark.createDataFrame([(0, "Terme", "a"), (0, "Terme", "b"), (1, "Terme", "c")], "ord int, title string, expectation string")
    got = segment.matched(rows, expected)  # two rows of one place: a join by places gave a draft twice
    assert {(r.id, r.expectation) for r in got.collect()} == {(1, "a"), (2, "a"), (3, "")} and got.count() == 3


def test_texts_of_sub_tasks_are_read_once(spark):
    from pyspark.sql import functions as F

    from taskloom.functions import points

    rows = spark.range(1).select(points.sub_tasks(F.lit("a) x"), F.col("id").cast("string"), F.col("id").cast("string")))
    assert rows._jdf.queryExecution().analyzed().toString().count("max") <= 2  # six before: the text of points was read anew for each sub-task


def test_texts_of_worksheets_are_not_shuffled(spark):
    from taskloom.plans import catalogue

    plan = catalogue.QUERIES["worksheet_drafts"](spark, DIR)._jdf.queryExecution()
    assert plan.executedPlan().toString().count("Exchange") == 1  # three before: lines, and the finished texts once more by rows
    assert plan.optimizedPlan().toString().count("Urhebern.*$") == 1  # two before: the filter cleaned a text again
