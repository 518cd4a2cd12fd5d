"""The mini-language of points, difficulty levels and sub-tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textual import BLANKS, S, first_of, found, js_number, js_round, let, mentions, number, or_else, sub, sub_where, text, trim

# Patterns of the mini-language.
NUMBER = r"\d+(?:[.,]\d+)?"
MAX = rf"(?i)\({S}*max\.?{S}*({NUMBER}){S}*\)"
MAX_BLOCK = r"(?i)\(\s*max\.?[^)]*\)"
LEVELS = {"AFB1": rf"AFB{S}*(?:1|I)(?!I)", "AFB2": rf"AFB{S}*(?:2|II)(?!I)", "AFB3": rf"AFB{S}*(?:3|III)"}
LABEL = rf"(?m)^[{BLANKS}]*([*⋆✱]?{S}*[a-zA-Z])\){S}*"
EXPLICIT = rf"(?i)([a-zA-Z]){S}*[:)]?{S}*AFB{S}*([123]|I{{1,3}})"
PART = rf"(?im)(?:^|\n){S}*\*?([a-z])\){S}*"
SUM = rf"{NUMBER}(?:{S}*\+{S}*{NUMBER})*"
LINE_POINTS = rf"(?i)(?:^|\n){S}*(?:Aufgabe{S}*)?\d{{0,2}}{S}*[:.)\-–]?{S}*\({S}*(je{S}*)?({SUM}){S}*(?:P\.?|BE){S}*\)"
INLINE = (rf"(?i)\(({SUM}){S}*(?:P\.?|BE)?\)", rf"(?i)({SUM}){S}*(?:P\.|BE)(?![A-Za-z0-9_])")
SAFE = r"^\d+(?:\.\d+)?(?:\+\d+(?:\.\d+)?)*\z"
HARD = r"begr(?:ü|u)nd|beweis|beurteil|bewert|erkl(?:ä|a)r|erl(?:ä|a)uter|analys|interpret|modellier"
HARD_WHOLE = r"begr(?:ü|u)nd|beweis|beurteil|bewert|analys|interpret|modellier"
DRAW = r"zeichn|skizz|konstrui"


def point_values(raw: Column) -> Column:
    """All numbers of a points text but its ``(max. n)``."""
    return F.transform(found(sub_where(trim(text(raw)), "(", MAX_BLOCK), NUMBER), number)


def max_points(raw: Column) -> Column:
    """The number of ``(max. n)``, else the sum of the values."""
    stated = let(text(raw), lambda t: F.when(t.contains("("), number(F.nullif(F.regexp_extract(t, MAX, 1), F.lit("")))))
    return F.coalesce(stated, F.aggregate(point_values(raw), F.lit(0.0), lambda a, x: a + x))


def afb_labels(raw: Column) -> Column:
    """Levels that a text names, in order 1, 2, 3."""
    upper = F.upper(text(raw))
    return F.array_compact(F.array(*[F.when(upper.rlike(p), F.lit(k)) for k, p in LEVELS.items()]))


def explicit_levels(raw: Column) -> Column:
    """array<struct<label, afb>>: levels given to single labels; the last one of a label counts."""
    labels = F.transform(found(text(raw), EXPLICIT, 1), F.lower)
    marks = F.transform(found(text(raw), EXPLICIT, 2), F.upper)
    pairs = F.arrays_zip(labels.alias("label"), F.transform(marks, lambda m: F.concat(F.lit("AFB"), F.when(m.startswith("I"), F.length(m).cast("string")).otherwise(m))).alias("afb"))

    def last(own: Column) -> Column:
        keys = F.array_distinct(F.transform(own, lambda p: p["label"]))
        return F.transform(keys, lambda k: F.struct(k.alias("label"), F.element_at(F.filter(own, lambda p: p["label"] == k), -1)["afb"].alias("afb")))

    return let(pairs, last)


def sub_tasks(question: Column, afb_raw: Column, points_raw: Column) -> Column:
    """array<struct<label, is_star, afb, points>> in order.

    Labels come from ``a)`` line beginnings, else from explicit levels, else one letter a value if
    there are several values. Of a repeated label the last star mark counts for all its rows.
    """
    # each text is read once: what a row needs is bound before the rows are formed
    marks = F.transform(found(text(question), LABEL, 1), lambda m: sub(m, S))
    starred = F.transform(marks, lambda m: F.struct(F.lower(sub(m, "^[*⋆✱]")).alias("label"), m.rlike("^[*⋆✱]").alias("star")))
    general = F.coalesce(first_of(afb_labels(afb_raw)), F.lit("AFB1"))
    read = F.struct(starred.alias("starred"), explicit_levels(afb_raw).alias("explicit"), point_values(points_raw).alias("values"), general.alias("general"))

    def rows(v: Column) -> Column:
        letters = F.transform(v["values"], lambda _, i: F.char(i + 97))
        named = lambda items: F.transform(items, lambda x: x["label"])
        none = F.array().cast("array<string>")
        labels = F.when(F.size(v["starred"]) > 0, named(v["starred"])).when(F.size(v["explicit"]) > 0, named(v["explicit"])).when(F.size(v["values"]) > 1, letters).otherwise(none)

        def row(label: Column, i: Column) -> Column:
            star = F.coalesce(F.try_element_at(F.filter(v["starred"], lambda s: s["label"] == label), F.lit(-1))["star"], F.lit(False))
            own = first_of(F.filter(v["explicit"], lambda e: e["label"] == label))["afb"]
            marked = lambda s: F.struct(F.concat(F.when(s, F.lit("*")).otherwise(F.lit("")), label, F.lit(")")).alias("label"), s.alias("is_star"), F.coalesce(own, v["general"]).alias("afb"), F.coalesce(F.get(v["values"], i), F.lit(0.0)).alias("points"))
            return let(star, marked)

        return F.transform(labels, row)

    return let(read, rows)


def points_by_afb(parts: Column, afb_raw: Column, most: Column) -> Column:
    """map<level, points> of the sub-tasks; without any, all points at the first level named."""
    levels = F.array_distinct(F.transform(parts, lambda p: p["afb"]))
    sums = F.transform(levels, lambda k: F.aggregate(F.filter(parts, lambda p: p["afb"] == k), F.lit(0.0), lambda a, p: a + p["points"]))
    alone = F.create_map(F.coalesce(first_of(afb_labels(afb_raw)), F.lit("AFB1")), most.cast("double"))
    return F.when(F.size(parts) > 0, F.map_from_arrays(levels, sums)).otherwise(alone)


def document_points(chunk: Column) -> Column:
    """Points text found in a task: line marks ``(n P.)`` joined by +, else an inline mark, else ''."""
    labels = F.array_distinct(F.transform(found(text(chunk), rf"(?im)^[{BLANKS}\u200B]*[*]?([a-z])\){S}*", 1), F.lower))

    def chosen(flat: Column, marks: Column) -> Column:
        each = F.coalesce(first_of(found(flat, LINE_POINTS, 1)), F.lit("")) != ""
        bracketed, bare = (sub(F.regexp_extract(flat, p, 1), S) for p in INLINE)
        raws = F.transform(marks, lambda m: sub(m, S))
        first = sub(F.coalesce(first_of(marks), F.lit("")), S)
        repeated = let(labels, lambda names: F.when(F.size(names) > 1, F.array_join(F.array_repeat(first, F.size(names)), "+")))
        marked = F.coalesce(F.when(each & ~first.contains("+"), repeated), F.array_join(raws, "+"))
        inline = let(F.when(flat.contains("("), bracketed), lambda b: or_else(b, bare))
        return F.when(F.size(marks) > 0, marked).otherwise(inline)

    def read(flat: Column) -> Column:
        none = F.array().cast("array<string>")
        return let(F.when(flat.contains("("), found(flat, LINE_POINTS, 2)).otherwise(none), lambda marks: chosen(flat, marks))

    return let(F.replace(text(chunk), F.lit("\r"), F.lit("")), read)


def heuristic_points(chunk: Column) -> Column:
    """Points by wording: 3, 2 or 1 for each sub-task, else 4, 3 or 2 for the whole."""

    def worth(low: Column) -> Column:
        plain = low.rlike(r"[=+\-*/:^]") & low.rlike(r"\d")
        return F.when(mentions(low, HARD), "3").when(mentions(low, DRAW) | (F.length(low) > 180), "2").when(plain, "1").otherwise("2")

    def whole(body: Column) -> Column:
        hard = lambda low: F.when(mentions(low, HARD_WHOLE), "4").when(mentions(low, DRAW) | (F.length(body) > 350), "3").otherwise("2")
        return let(F.lower(body), hard)

    def judged(body: Column) -> Column:
        # what follows each label up to the next; a split would compile its pattern for each text
        parts = found(body, rf"{PART}((?s:.*?))(?={PART}|\z)", 2)
        each = lambda p: F.array_join(F.transform(p, lambda x: let(F.lower(x), worth)), "+")
        return let(parts, lambda p: F.when(F.size(p) > 0, each(p)).otherwise(whole(body)))

    return let(text(chunk), judged)


def safe_points(raw: Column, fallback: Column) -> Column:
    """A clean sum like ``2+3.5``, else the fallback."""
    clean = F.replace(sub(text(raw), S), F.lit(","), F.lit("."))
    return F.when(clean.rlike(SAFE), clean).otherwise(fallback)


def estimated_time(points: Column, question: Column) -> Column:
    """Minutes: 1.8 a point (4 without points) and one for each further sub-task; at least 2."""
    parts = F.size(found(text(question), rf"(?im)^[{BLANKS}]*[*]?[a-z]\){S}*"))
    minutes = F.when(points > 0, points * 1.8).otherwise(F.lit(4.0)) + F.greatest(F.lit(0), parts - 1)
    return F.greatest(F.lit(2), js_round(minutes)).cast("long")


def afb_display(by_afb: Column, raw: Column) -> Column:
    """Levels with points, else levels named in the text, else a dash."""
    some = F.filter(F.array(*[F.lit(f"AFB{i}") for i in (1, 2, 3)]), lambda k: F.coalesce(F.try_element_at(by_afb, k), F.lit(0.0)) > 0)
    named = F.array_distinct(found(text(raw), rf"(?i)AFB{S}*[123]"))
    shown = F.transform(named, lambda m: sub(F.upper(m), rf"AFB{S}*", "AFB "))
    return F.when(F.size(some) > 0, F.array_join(F.transform(some, lambda k: F.replace(k, F.lit("AFB"), F.lit("AFB "))), ", ")).when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise(F.lit("–"))


def points_heading(raw: Column, most: Column) -> Column:
    return or_else(trim(text(raw)), js_number(most))
