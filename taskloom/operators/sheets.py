"""Sheets of a selection: order, totals, overview, exam sheet, expectation sheet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import latex, scoring
from ..functions.points import points_heading
from ..functions.textual import js_number, lines, or_else, text, trim
from ..schema import COMPETENCES
from .scan import scan

# Texts of a sheet.
NO_TITLE, NO_EXPECTATION, NO_NAME = "Aufgabe", "–", "Klassenarbeit"
FORM_ROWS = [("Sprache", "language"), ("Schriftbild", "handwriting"), ("Mathematische Form", "math_form")]
TOTAL_ROW, MARKS = "Punktzahl", [1, 2, 3, 4, 5, 6]
HINTS = ["Aufgaben mit diesem Symbol müssen auf einem Extrablatt erledigt werden.", "Aufgaben mit diesem Symbol sollen auf dem Aufgabenblatt erledigt werden."]


def selection(tasks: DataFrame, chosen: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Tasks of a selection (ord, id) with sheet flags (id, on_extra_sheet), in the user's order."""
    rows = chosen.join(tasks, "id")
    if flags is not None:
        rows = rows.withColumnRenamed("on_extra_sheet", "__own") if "on_extra_sheet" in rows.columns else rows.withColumn("__own", F.lit(None).cast("boolean"))
        rows = rows.join(flags, "id", "left").withColumn("on_extra_sheet", F.coalesce("on_extra_sheet", "__own", F.lit(False))).drop("__own")
    return rows


def numbered(rows: DataFrame, order: str = "ord", *by: str) -> DataFrame:
    """Rows of a sheet with number, grid row and grid column (three to a row); a sheet may span tasks."""
    out = scan(rows, list(by), [order], count="__number")
    return out.withColumn("number", F.col("__number").cast("int")).drop("__number").withColumn("grid_row", F.floor((F.col("number") - 1) / 3).cast("int")).withColumn("grid_col", ((F.col("number") - 1) % 3).cast("int"))


def overview(rows: DataFrame, *by: str) -> DataFrame:
    """The sheet's grid of numbered rows: ``Aufgabe n`` and points of three tasks a row, blank where there is none."""
    cell = F.concat(F.lit("Aufgabe "), F.col("number").cast("string"))
    grid = rows.groupBy(*by, "grid_row").pivot("grid_col", [0, 1, 2]).agg(F.first(cell).alias("cell"), F.first(js_number(F.col("max_points"))).alias("points"))
    return grid.select(*by, "grid_row", *[text(f"{i}_{k}").alias(f"{k}_{i}") for i in range(3) for k in ("cell", "points")])


def heading(no: Column, title: Column, points_raw: Column, most: Column) -> Column:
    """``Aufgabe n: title (points P.)``."""
    return F.concat(F.lit("Aufgabe "), no.cast("string"), F.lit(": "), or_else(title, F.lit(NO_TITLE)), F.lit(" ("), points_heading(points_raw, most), F.lit(" P.)"))


def totals(rows: DataFrame, *by: str) -> DataFrame:
    """Points and minutes of a selection."""
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for c, n in (("max_points", "points"), ("estimated_time", "minutes"))]
    return rows.groupBy(*by).agg(F.count("*").alias("n_tasks"), *sums)


def grouped(tasks: DataFrame, order: str, names: list[str] = COMPETENCES) -> DataFrame:
    """Tasks of the named competences with the competence's place and its number of tasks, in display order.

    A row a task: a competence may hold a third of the pool, so its tasks are sorted and never collected.
    """
    dim = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    rows = tasks.withColumn("competence_ord", F.try_element_at(dim, F.col("competence"))).where("competence_ord is not null")
    sizes = rows.groupBy("competence_ord").agg(F.count("*").alias("n_tasks"))  # a row a name
    return rows.join(F.broadcast(sizes), "competence_ord").orderBy("competence_ord", order)


def exam_sheet(rows: DataFrame, form: Column, tools: Column, *by: str) -> DataFrame:
    """(by, section, part, line, text, points, extra): an exam's rows in order.

    rows: numbered tasks with title, question_text, points_raw, max_points, image_url, on_extra_sheet;
    ``form`` points for form and ``tools`` are the sheet's. Sections: 0 tools, 1 overview, 2 points for
    form, 3 total, 4 grade mirror, 5 hints, 6 tasks. A task has its heading (line 0, with the flag of the
    extra sheet), the lines of its text, and its image last. Sheets are dealt by ``by``; a task's rows
    come from itself alone.
    """
    none, blank = F.lit(None).cast("boolean"), F.lit("")

    def part(df: DataFrame, section: int, part: Column, line: Column, content: Column, points: Column = blank, extra: Column = none) -> DataFrame:
        return df.select(*by, F.lit(section).alias("section"), part.cast("int").alias("part"), line.cast("int").alias("line"), content.alias("text"), points.alias("points"), extra.alias("extra"))

    zero = F.lit(0)
    one = totals(rows.withColumn("estimated_time", F.lit(0.0)), *by).withColumn("form", form)
    split = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("text"), scoring.form_split(F.col("form"))[k].alias("points")) for i, (n, k) in enumerate(FORM_ROWS)])
    forms = one.where("form > 0").select(*by, F.explode(split).alias("f"))
    fixed = lambda texts: one.select(*by, F.posexplode(F.array(*map(F.lit, texts))).alias("i", "t"))
    body = F.concat(F.array(heading(F.col("number"), F.col("title"), F.col("points_raw"), F.col("max_points"))), lines(text("question_text")), F.when(text("image_url") != "", F.array(F.concat(F.lit("[[IMG:"), F.col("image_url"), F.lit("]]")))).otherwise(F.array().cast("array<string>")))
    written = rows.select(*by, "number", "on_extra_sheet", F.posexplode(body).alias("i", "t"))
    parts = [
        part(one, 0, zero, zero, F.concat(F.lit("Hilfsmittel: "), or_else(trim(text(tools)), F.lit("/")))),
        part(rows, 1, F.col("number"), zero, F.concat(F.lit("Aufgabe "), F.col("number").cast("string")), js_number(F.col("max_points"))),
        part(forms, 2, F.col("f.i"), zero, F.col("f.text"), js_number(F.col("f.points"))),
        part(one, 3, zero, zero, F.lit(TOTAL_ROW), js_number(F.col("points") + F.col("form"))),
        part(fixed([str(m) for m in MARKS]), 4, F.col("i"), zero, F.col("t")),
        part(fixed(HINTS), 5, F.col("i"), zero, F.col("t"), extra=F.col("i") == 0),
        part(written, 6, F.col("number"), F.col("i"), F.col("t"), extra=F.when(F.col("i") == 0, F.coalesce("on_extra_sheet", F.lit(False)))),
    ]
    return reduce(DataFrame.unionByName, parts)


def expectation_sheet(rows: DataFrame, *by: str) -> DataFrame:
    """(by, number, title, expectation, lines, points) of a sheet's tasks; an empty expectation is a dash."""
    expected = or_else(text("expectation"), F.lit(NO_EXPECTATION))
    points = or_else(text("points_raw"), js_number(F.col("max_points")))
    return rows.select(*by, "number", or_else(text("title"), F.lit(NO_TITLE)).alias("title"), expected.alias("expectation"), lines(expected).alias("lines"), points.alias("points"))


def with_formulas(rows: DataFrame, line_col: str = "text") -> DataFrame:
    """Lines of a sheet in pieces of text and formula: ``rows`` with piece (from 0), kind, value, and the formula's nodes.

    The nodes of a formula (:func:`latex.formula_nodes`) are what a document writes as fractions, roots and scripts.
    """
    out = rows.select(*(c for c in rows.columns if c != line_col), F.posexplode(latex.inline(F.col(line_col))).alias("piece", "__p"))
    out = out.select(*(c for c in rows.columns if c != line_col), "piece", "__p.kind", "__p.value")
    return out.withColumn("nodes", latex.nodes(F.when(F.col("kind") == "math", F.col("value"))))


def file_names(title: Column) -> Column:
    """struct<test, expectation, archive>: names of a sheet's files, without signs that file systems forbid."""
    safe = F.regexp_replace(or_else(text(title), F.lit(NO_NAME)), r'[\\/:*?"<>|]+', "-")
    return F.struct(F.concat(safe, F.lit(".docx")).alias("test"), F.concat(safe, F.lit("_Erwartung.docx")).alias("expectation"), F.concat(safe, F.lit(".zip")).alias("archive"))


def toggled(chosen: Column, item: Column) -> Column:
    """A list of ids without the item if it has it, else with it at the end."""
    return F.when(F.array_contains(chosen, item), F.array_remove(chosen, item)).otherwise(F.array_append(chosen, item))


def moved(chosen: Column, at: Column, by: Column) -> Column:
    """A list with the element at ``at`` (from 0) and its neighbour ``by`` places on exchanged; unchanged beyond its ends."""
    n = F.size(chosen)
    target = at + by
    inside = (at >= 0) & (at < n) & (target >= 0) & (target < n)
    return F.when(inside, F.transform(chosen, lambda x, i: F.when(i == at, F.get(chosen, target)).when(i == target, F.get(chosen, at)).otherwise(x))).otherwise(chosen)
