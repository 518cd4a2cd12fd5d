"""Points by difficulty level: mandatory and star variants, totals, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import AFBS, COMPETENCES, GRADES
from .textual import js_round, number, text


def _levels(value) -> Column:
    return F.struct(*[value(k).cast("double").alias(k.lower()) for k in AFBS])


def _plain(by_afb: Column) -> Column:
    return _levels(lambda k: F.coalesce(F.try_element_at(by_afb, F.lit(k)), F.lit(0.0)))


def _any(parts: Column) -> Column:
    return F.coalesce(F.size(parts), F.lit(0)) > 0


def mandatory(parts: Column, by_afb: Column) -> Column:
    """struct<afb1, afb2, afb3>: points of sub-tasks without star; without sub-tasks ``by_afb``."""
    own = F.filter(parts, lambda p: ~p["is_star"])
    sums = _levels(lambda k: F.aggregate(own, F.lit(0.0), lambda a, p: a + F.when(p["afb"] == k, p["points"]).otherwise(0.0)))
    return F.when(_any(parts), sums).otherwise(_plain(by_afb))


def star_greedy(parts: Column, by_afb: Column, most: Column) -> Column:
    """struct<afb1, afb2, afb3>: all star sub-tasks, then others in order while they fit in ``most``.

    One that does not fit is skipped and later ones are still tried. Without a star ``by_afb``.
    """
    order = F.concat(F.filter(parts, lambda p: p["is_star"]), F.filter(parts, lambda p: ~p["is_star"]))
    zero = F.struct(F.lit(0.0).alias("used"), *[F.lit(0.0).alias(k.lower()) for k in AFBS])

    def take(acc: Column, p: Column) -> Column:
        fits = p["is_star"] | ((acc["used"] < most) & (acc["used"] + p["points"] <= most))
        gain = F.when(fits, p["points"]).otherwise(0.0)
        return F.struct((acc["used"] + gain).alias("used"), *[(acc[k.lower()] + F.when(p["afb"] == k, gain).otherwise(0.0)).alias(k.lower()) for k in AFBS])

    got = F.aggregate(order, zero, take)
    picked = _levels(lambda k: got[k.lower()])
    return F.when(_any(parts) & F.exists(parts, lambda p: p["is_star"]), picked).otherwise(_plain(by_afb))


def afb_sum(row: Column) -> Column:
    return row["afb1"] + row["afb2"] + row["afb3"]


def total_afb(tasks: DataFrame, mode: str = "mandatory", *keys: str) -> DataFrame:
    """Sums by level over tasks (sub_tasks, points_by_afb, max_points), by ``keys`` if given."""
    row = mandatory(F.col("sub_tasks"), F.col("points_by_afb")) if mode == "mandatory" else star_greedy(F.col("sub_tasks"), F.col("points_by_afb"), F.col("max_points"))
    sums = [F.coalesce(F.sum(f"row.{k.lower()}"), F.lit(0.0)).alias(k.lower()) for k in AFBS]
    return tasks.select(*keys, row.alias("row")).groupBy(*keys).agg(*sums)


def task_sums(parts: DataFrame, *keys: str) -> DataFrame:
    """A row a task: n_parts, points, and level sums ``mandatory`` and ``by_afb``, from rows of its sub-tasks.

    parts: keys, afb, is_star, points. One aggregate with partial sums, for variants that need no order.
    """

    def levels(when: Column) -> Column:
        return F.struct(*[F.sum(F.when(when & (F.col("afb") == k), F.col("points")).otherwise(0.0)).alias(k.lower()) for k in AFBS])

    return parts.groupBy(*keys).agg(F.count("*").alias("n_parts"), F.sum("points").alias("points"), levels(~F.col("is_star")).alias("mandatory"), levels(F.lit(True)).alias("by_afb"))


def level_totals(rows: DataFrame, level: str, *keys: str) -> DataFrame:
    """Sums by level of a struct column; null rows count as nothing."""
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(f"{level}.{k.lower()}"), F.lit(0.0)).alias(k.lower()) for k in AFBS])


def percent(part: Column, total: Column) -> Column:
    """Rounded share in percent; 0 if the total is not positive."""
    return F.when(total > 0, js_round(part / F.when(total > 0, total) * 100)).otherwise(F.lit(0)).cast("long")


def distribution(totals: DataFrame) -> DataFrame:
    """(afb, points, share) from one row of level sums."""
    whole = F.col("afb1") + F.col("afb2") + F.col("afb3")
    rows = F.array(*[F.struct(F.lit(k).alias("afb"), F.col(k.lower()).alias("points"), percent(F.col(k.lower()), whole).alias("share")) for k in AFBS])
    return totals.select(F.inline(rows))


def by_competence(tasks: DataFrame, names: list[str] = COMPETENCES) -> DataFrame:
    """(ord, competence, n_tasks, points, share) of all names in order, zero-filled; others are left out."""
    dim = tasks.sparkSession.createDataFrame(list(enumerate(names)), "ord int, competence string")
    sums = tasks.groupBy("competence").agg(F.sum("max_points").alias("points"), F.count("*").alias("n_tasks"))
    rows = dim.join(sums, "competence", "left").select("ord", "competence", F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"), F.coalesce("points", F.lit(0.0)).alias("points"))
    total = F.sum("points").over(Window.partitionBy())  # over one row a name
    return rows.select("ord", "competence", "n_tasks", "points", percent(F.col("points"), total).alias("share"))


def form_points(raw: Column) -> Column:
    n = number(text(raw))
    return F.when(n > 0, n).otherwise(F.lit(0.0))


def form_split(total: Column) -> Column:
    """struct<language, handwriting, math_form>: one point each at most, the rest for form."""
    language = F.least(F.lit(1.0), total)
    hand = F.least(F.lit(1.0), F.greatest(F.lit(0.0), total - language))
    return F.struct(language.alias("language"), hand.alias("handwriting"), F.greatest(F.lit(0.0), total - language - hand).alias("math_form"))


def grade_table(totals: DataFrame, total_col: str = "total") -> DataFrame:
    """A row for each grade threshold: columns of ``totals``, percent, grade_points, least points."""
    rows = F.array(*[F.struct(F.lit(p).alias("percent"), F.lit(g).alias("grade_points")) for p, g in GRADES])
    return totals.select("*", F.inline(rows)).withColumn("from_points", F.ceil(F.col(total_col) * F.col("percent") / 100).cast("long"))


def date_german(c: Column) -> Column:
    """yyyy-mm-dd as dd.mm.yyyy; other texts unchanged."""
    return F.regexp_replace(c, r"^(\d{4})-(\d{2})-(\d{2})\z", "$3.$2.$1")
