import random

import pytest
from pyspark.sql import functions as F

from taskloom.functions import points, scoring
from taskloom.schema import TASK


@pytest.mark.parametrize(
    "raw, values, most",
    [("1+1+2+2 (max. 4)", [1, 1, 2, 2], 4), ("2,5+3", [2.5, 3], 5.5), ("", [], 0), (None, [], 0), ("3 x 2", [3, 2], 5), ("4 (max)", [4], 4), ("(Max 3,5)", [], 3.5)],
)
def test_points_spec(ev, raw, values, most):
    c = F.lit(raw).cast("string")
    assert ev(points.point_values(c)) == values
    assert ev(points.max_points(c)) == most


@pytest.mark.parametrize("raw, levels", [("AFB III, AFB I", ["AFB1", "AFB3"]), ("AFB 12", ["AFB1"]), ("", []), ("afb ii", ["AFB2"]), (None, [])])
def test_levels(ev, raw, levels):
    assert ev(points.afb_labels(F.lit(raw).cast("string"))) == levels


def test_worked_example(ev):
    q, a, p = "a) w\nb) x\n*c) y\n* d) z", "a: AFB 1, b: AFB 1, c: AFB 1, d: AFB 2", "1+1+2+2 (max. 4)"
    parts = points.sub_tasks(F.lit(q), F.lit(a), F.lit(p))
    rows = ev(parts)
    assert [r.label for r in rows] == ["a)", "b)", "*c)", "*d)"]
    assert [(r.is_star, r.afb, r.points) for r in rows] == [(False, "AFB1", 1), (False, "AFB1", 1), (True, "AFB1", 2), (True, "AFB2", 2)]
    by = points.points_by_afb(parts, F.lit(a), F.lit(4.0))
    assert tuple(ev(scoring.mandatory(parts, by))) == (2, 0, 0)
    assert tuple(ev(scoring.star_greedy(parts, by, F.lit(4.0)))) == (2, 2, 0)


def test_sub_task_sources(ev):
    e = F.lit("")
    assert [r.label for r in ev(points.sub_tasks(e, F.lit("b AFB 1 a: AFB 2"), e))] == ["b)", "a)"]
    assert [r.label for r in ev(points.sub_tasks(e, e, F.lit("1+2")))] == ["a)", "b)"]
    assert ev(points.sub_tasks(e, e, F.lit("2"))) == []
    assert ev(points.points_by_afb(points.sub_tasks(e, e, F.lit("2")), F.lit("AFB 3"), F.lit(2.0))) == {"AFB3": 2.0}
    # of a repeated label the last star counts and both rows stay
    twice = ev(points.sub_tasks(F.lit("a) x\n*a) y"), e, F.lit("1+2")))
    assert [(r.is_star, r.points) for r in twice] == [(True, 1), (True, 2)]


def greedy(rows, most):
    if not any(s for s, _, _ in rows):
        out = dict.fromkeys(("AFB1", "AFB2", "AFB3"), 0.0)
        for _, k, p in rows:
            out[k] += p
        return tuple(out.values())
    used, out = 0.0, dict.fromkeys(("AFB1", "AFB2", "AFB3"), 0.0)
    for s, k, p in [r for r in rows if r[0]] + [r for r in rows if not r[0]]:
        if s or (used < most and used + p <= most):
            used += p
            out[k] += p
    return tuple(out.values())


def test_greedy_against_loop(spark):
    rng = random.Random(1)
    cases = []
    for i in range(300):
        rows = [(rng.random() < 0.3, f"AFB{rng.randint(1, 3)}", float(rng.randint(0, 5))) for _ in range(rng.randint(0, 6))]
        cases.append((i, [("x", s, k, p) for s, k, p in rows], float(rng.randint(0, 12))))
    sub = TASK["sub_tasks"].dataType.simpleString()
    df = spark.createDataFrame(cases, f"id int, sub_tasks {sub}, max_points double").withColumn("by", points.points_by_afb(F.col("sub_tasks"), F.lit(""), F.col("max_points")))
    got = df.select("id", "sub_tasks", "max_points", scoring.star_greedy(F.col("sub_tasks"), F.col("by"), F.col("max_points")).alias("r")).collect()
    for r in got:
        rows = [(p.is_star, p.afb, p.points) for p in r.sub_tasks]
        want = greedy(rows, r.max_points) if rows else (r.max_points, 0, 0)
        assert tuple(r.r) == want, (rows, r.max_points)


def test_shares_and_grades(spark, ev):
    assert [ev(scoring.percent(F.lit(a), F.lit(b))) for a, b in ((1.0, 3.0), (1.0, 8.0), (1.0, 0.0))] == [33, 13, 0]
    rows = scoring.grade_table(spark.createDataFrame([(57.0,)], "total double")).orderBy("grade_points").collect()
    assert [r.from_points for r in rows] == [0, 6, 11, 16, 21, 26, 29, 35, 38, 40, 43, 46, 49, 52, 55, 57]
    assert tuple(ev(scoring.form_split(scoring.form_points(F.lit("3,5"))))) == (1, 1, 1.5)
    assert ev(scoring.date_german(F.lit("2024-02-09"))) == "09.02.2024"
    assert ev(scoring.date_german(F.lit("9.2.24"))) == "9.2.24"


def test_competences_are_zero_filled(spark):
    df = spark.createDataFrame([("Mathematik", 3.0), ("Modellieren", 1.0)], "competence string, max_points double")
    rows = {r.competence: (r.points, r.share) for r in scoring.by_competence(df).collect()}
    assert len(rows) == 6 and rows["Mathematik"] == (3.0, 75) and rows["Darstellungen"] == (0.0, 0)


def test_points_in_worksheets(ev):
    assert ev(points.document_points(F.lit("3 (Je 2 P.) Rechne\na) 1\nb) 2\nc) 3"))) == "2+2+2"
    assert ev(points.document_points(F.lit("4 (6 P.) x\n(6 P.) y"))) == "6+6"
    assert ev(points.document_points(F.lit("Text (3+4 BE) mehr"))) == "3+4"
    assert ev(points.document_points(F.lit("nichts"))) == ""
    assert ev(points.heuristic_points(F.lit("a) Begründe\nb) 3+4"))) == "3+1"
    assert ev(points.heuristic_points(F.lit("Zeichne"))) == "3"
    assert ev(points.estimated_time(F.lit(6.0), F.lit("a) x\nb) y"))) == 12
    assert [ev(points.safe_points(F.lit(x), F.lit("f"))) for x in ("2 + 3,5", "2-3")] == ["2+3.5", "f"]
    assert ev(points.afb_display(F.create_map(F.lit("AFB2"), F.lit(1.0)), F.lit(""))) == "AFB 2"
    assert ev(points.afb_display(F.create_map(F.lit("AFB2"), F.lit(0.0)), F.lit("afb 3, AFB3"))) == "AFB 3, AFB 3"
