"""Guard for proposed corrections, and field-by-field validation of model output."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import COMPETENCES, CONFIDENCE, MODEL_JSON, TOPICS_BY_CLASS
from .points import PART, max_points, safe_points
from .textual import BLANKS, S, circled, found, jaccard, js_number, js_round, let, lines, nfkc, or_else, sub, text, trim

# Words that do not count when prose is compared.
STOP = [
    "aufgabe", "aufgaben", "punkt", "punkte", "berechne", "bestimme", "gib", "zeichne", "ordne", "löse", "loese", "folgende", "folgenden", "wenn",
    "dabei", "eine", "einer", "einen", "einem", "eines", "und", "oder", "mit", "die", "der", "das", "den", "dem", "des", "von", "zur", "zum", "ist",
    "sind",
]
TASK_LINE = rf"(?i)^{S}*(?:Aufgabe{S}*)?(\d{{1,2}}){S}*(?:[:.)]|{S}+\()"
LEAST_PROSE, LEAST_RATIO, MOST_RATIO = 0.78, 0.62, 1.55
# Characters of a text that can be trusted, and of texts that are sent to a model.
TRUSTED_CHARS, QUESTION_CHARS, PAGE_CHARS = 120, 10_500, 13_000
# Why a correction is rejected; a to d stand for what both sides have.
REASONS = {
    "empty": "leerer Text",
    "tasks": "Aufgabennummern wurden verändert ({a} → {b})",
    "parts": "Teilaufgaben wurden verändert ({a} → {b})",
    "numbers": "Zahleninhalt wurde verändert; Korrektur aus Sicherheitsgründen verworfen",
    "prose": "zu große Textabweichung ({a} % Prosa-Übereinstimmung)",
    "size": "Textlänge unplausibel verändert ({a} %)",
    "headings": "zusätzliche Aufgabenüberschriften erkannt",
}
# Seconds to wait if no limit is named, and the least ones.
DEFAULT_WAIT, LEAST_WAIT = 8.0, 1.0


def _reason(name: str, **values: Column) -> Column:
    """The text of a reason with values in place of its letters."""
    parts = re.split(r"\{([a-d])\}", REASONS[name])
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def task_numbers(c: Column) -> Column:
    """Distinct task numbers 1 to 50 of line beginnings, in order."""
    numbers = F.transform(lines(circled(text(c), ".")), lambda x: F.regexp_extract(x, TASK_LINE, 1).try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n.between(1, 50)))


def prose_words(c: Column) -> Column:
    """Words of three letters and more that are no commands. Whatever is no letter parts words, digits and operators too."""
    plain = lambda x: F.when(x.contains("\\"), sub(x, r"\\[a-z]+", " ")).otherwise(x)
    return F.filter(F.split(sub(let(F.lower(text(c)), plain), "(?iu)[^a-zäöüß]+", " "), " "), lambda w: (F.length(w) >= 3) & ~w.isin(STOP))


def part_labels(c: Column) -> Column:
    return F.transform(found(text(c), PART, 1), F.lower)


def numbers(c: Column, normal: bool = True) -> Column:
    """All numbers with points, sorted as text. normal: in NFKC, so that special digits count."""
    return F.array_sort(F.transform(found(nfkc(text(c)) if normal else text(c), r"\d+(?:[.,]\d+)?"), lambda n: F.replace(n, F.lit(","), F.lit("."))))


def check_correction(original: Column, corrected: Column, normal: bool = True) -> Column:
    """struct<ok, reason>: the first rule that a correction breaks, in order. What a rule compares is worked out only if none before it is broken."""
    joined = lambda x, sep: F.array_join(x.cast("array<string>"), sep)
    pct = lambda x: js_number(js_round(x * 100))

    def side(c: Column) -> Column:
        return F.struct(c.alias("text"), (nfkc(c) if normal else c).alias("normal"))

    def judged(pair: Column) -> Column:
        x, y = pair["a"]["text"], pair["b"]["text"]

        def rule(of, broken, then) -> Column:
            """What ``of`` gives for both sides, once; the reason if ``broken`` holds of it, else what ``then`` says."""
            return let(F.struct(of(pair["a"]).alias("a"), of(pair["b"]).alias("b")), lambda v: F.when(broken(v["a"], v["b"])[0], broken(v["a"], v["b"])[1]).otherwise(then))

        def lists(name: str, sep: str):
            return lambda a, b: (joined(a, sep) != joined(b, sep), _reason(name, a=joined(a, ","), b=joined(b, ",")) if name != "numbers" else _reason(name))

        heads = rule(lambda c: F.size(found(c["text"], rf"(?im)^[{BLANKS}]*Aufgabe{S}+\d+")), lambda a, b: (b > a + 1, _reason("headings")), F.lit(""))
        ratio = F.length(y) / F.greatest(F.lit(1), F.length(x))
        size = F.when((ratio < LEAST_RATIO) | (ratio > MOST_RATIO), _reason("size", a=pct(ratio))).otherwise(heads)
        alike = lambda words: F.when(words < LEAST_PROSE, _reason("prose", a=pct(words))).otherwise(size)
        prose = let(let(F.struct(prose_words(x).alias("a"), prose_words(y).alias("b")), lambda w: jaccard(w["a"], w["b"])), alike)
        counted = rule(lambda c: numbers(c["normal"], False), lists("numbers", "|"), prose)
        parts = rule(lambda c: part_labels(c["text"]), lists("parts", "|"), counted)
        tasks = rule(lambda c: task_numbers(c["text"]), lists("tasks", ","), parts)
        return F.when((x == "") | (y == ""), _reason("empty")).when(x == y, F.lit("")).otherwise(tasks)

    pair = F.struct(side(trim(text(original))).alias("a"), side(trim(text(corrected))).alias("b"))
    return let(let(pair, judged), lambda reason: F.struct((reason == "").alias("ok"), reason.alias("reason")))


def trusted_page(c: Column) -> Column:
    """A page's text can anchor a correction: long enough and with a task number."""
    c = trim(text(c))
    return (F.length(c) >= TRUSTED_CHARS) & (F.size(task_numbers(c)) > 0)


def trusted_document(c: Column, n_drafts: Column, n_pages: Column) -> Column:
    """A document's text can be corrected: long enough, with tasks and pages."""
    return (F.length(trim(text(c))) >= TRUSTED_CHARS) & (n_drafts > 0) & (n_pages > 0)


def apply_corrections(pages: DataFrame, corrections: DataFrame, trusted: bool = False) -> DataFrame:
    """pages (doc, page, text) with the corrected text where a correction passes, and an outcome.

    outcome: repaired, rejected (with reason), or skipped where no correction is proposed; with ``trusted``
    also on pages whose text can't anchor one.
    """
    both = pages.join(corrections.select("doc", "page", F.col("text").alias("proposed")), ["doc", "page"], "left")
    if trusted:
        both = both.withColumn("proposed", F.when(trusted_page(F.col("text")), F.col("proposed")))
    both = both.withColumn("check", check_correction(F.col("text"), F.col("proposed")))
    some = F.col("proposed").isNotNull()
    return both.select(
        "doc",
        "page",
        F.when(some & F.col("check.ok"), trim(F.col("proposed"))).otherwise(F.col("text")).alias("text"),
        F.when(~some, "skipped").when(F.col("check.ok"), "repaired").otherwise("rejected").alias("outcome"),
        F.when(some, F.col("check.reason")).otherwise(F.lit("")).alias("reason"),
    )


def corrected_text(answer: Column) -> Column:
    """The trimmed ``correctedText`` of a model's JSON answer; null if there is none that is a text."""
    is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json(answer), "$.correctedText", "variant")) == "STRING"
    return F.when(is_text, F.nullif(trim(F.from_json(answer, "correctedText string")["correctedText"]), F.lit("")))


def retry_seconds(retry_after: Column, reset: Column, least: float = LEAST_WAIT, default: float = DEFAULT_WAIT) -> Column:
    """Seconds to wait: a positive ``retry_after``, else the seconds, else milliseconds that ``reset`` names, else a default."""
    after = trim(text(retry_after)).try_cast("double")
    seconds, milli = (F.nullif(F.regexp_extract(text(reset), rf"(?i)([0-9.]+){unit}", 1), F.lit("")) for unit in ("s", "ms"))
    named = F.when(seconds.isNotNull(), F.greatest(F.lit(least), seconds.try_cast("double"))).when(milli.isNotNull(), F.greatest(F.lit(least), milli.try_cast("double") / 1000))
    return F.when(after > 0, after).otherwise(F.coalesce(named, F.lit(default)))


def prompt(template: str, limit: int, body: Column, **fields: Column) -> Column:
    """A template with ``{name}`` fields filled in, and ``{body}`` with the first ``limit`` characters of a text.

    The template is the caller's; a field that is null or empty leaves nothing.
    """
    values = {k: text(v) for k, v in fields.items()} | {"body": F.substring(text(body), 1, limit)}
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def answers(rows: DataFrame, prompt_col: str, ask, out_col: str = "answer") -> DataFrame:
    """``rows`` with the answers of an injected callable to the prompts, one after the other within a task.

    ``ask`` takes a prompt and returns a text or null. A failure leaves a null answer and its message in
    ``<out_col>_error``; retries and limits are the callable's.
    """

    def run(batches):
        for b in batches:
            said, failed = [], []
            for p in b[prompt_col]:
                try:
                    said.append(ask(p))
                    failed.append(None)
                except Exception as e:  # the callable is not ours
                    said.append(None)
                    failed.append(str(e))
            yield b.assign(**{out_col: said, f"{out_col}_error": failed})

    schema = T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType()), T.StructField(f"{out_col}_error", T.StringType())])
    return rows.mapInPandas(run, schema)


def page_outcomes(pages: DataFrame) -> DataFrame:
    """Page lists by outcome for each document."""
    listed = lambda k: F.sort_array(F.collect_list(F.when(F.col("outcome") == k, F.col("page")))).alias(f"{k}_pages")
    return pages.groupBy("doc").agg(*[listed(k) for k in ("repaired", "rejected", "skipped")])


def repair_mark(source_pages: Column, repaired: Column, rejected: Column) -> Column:
    """visual if a page of the draft was repaired, else rejected if one was rejected, else none."""
    met = lambda pages: F.coalesce(F.arrays_overlap(source_pages, pages), F.lit(False))
    return F.when(met(repaired), "visual").when(met(rejected), "rejected").otherwise("none")


def unit_interval(c: Column) -> Column:
    """A confidence in 0 to 1; null and NaN are 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))))


def refine(drafts: DataFrame, json_col: str, by_class: dict[str, list[str]] = TOPICS_BY_CLASS, default_class: str | None = None, default_topic: str | None = None) -> DataFrame:
    """Drafts with the fields of a model's JSON where they are valid, else their own.

    Points that the document states are preserved. A field that does not parse counts as missing. Without an
    answer, or with one that is no JSON object, the draft stays as it is. A default class or topic that is known
    goes before the draft's own.
    """
    own = F.lit(default_class) if default_class in by_class else F.col("class_level")
    m = F.when(F.try_parse_json(json_col).isNotNull() & trim(F.col(json_col)).startswith("{"), F.from_json(F.col(json_col), MODEL_JSON))
    rows = drafts.withColumn("__m", m)
    topics = F.create_map(*[x for k, v in by_class.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]).cast("array<string>"))])
    allowed = F.coalesce(F.try_element_at(topics, own), F.array().cast("array<string>"))
    kept = (F.col("points_source") == "document") & (text("points_raw") != "")
    said = safe_points(F.col("__m.pointsRaw"), or_else(text("points_raw"), F.lit("2")))
    raw = F.when(kept, F.col("points_raw")).otherwise(said)
    most = max_points(raw)
    fallback = F.when(F.array_contains(allowed, F.lit(default_topic)), F.lit(default_topic)).otherwise(F.col("topic")) if default_topic else F.col("topic")
    chosen = F.when(F.array_contains(allowed, F.col("__m.topic")), F.col("__m.topic")).when(F.array_contains(allowed, fallback), fallback).otherwise(F.coalesce(F.get(allowed, F.lit(0)), F.lit("")))
    truthy = lambda c, d: F.when(c.isNotNull() & (c != 0) & ~F.isnan(c), c).otherwise(d)
    names = ("Topic", "Competence", "Afb", "Time", "Expectation")
    new = {
        "title": or_else(trim(or_else(F.col("__m.title"), text("title"))), text("title")),
        "class_level": own,
        "topic": chosen,
        "competence": F.when(F.col("__m.competence").isin(COMPETENCES), F.col("__m.competence")).otherwise(F.col("competence")),
        "afb_raw": trim(or_else(F.col("__m.afbRaw"), or_else(text("afb_raw"), F.lit("AFB 1")))),
        "points_raw": raw,
        "max_points": truthy(most, F.coalesce("max_points", F.lit(0.0))),
        "points_source": F.when(kept, "document").otherwise("llm"),
        "estimated_time": F.greatest(F.lit(0.0), truthy(F.col("__m.estimatedTime"), F.coalesce(F.col("estimated_time").cast("double"), F.lit(0.0)))),
        "expectation": trim(or_else(F.col("__m.expectation"), text("expectation"))),
        "analysis_mode": F.lit("llm"),
        "confidence": F.struct(*[unit_interval(F.col(f"__m.confidence{n}")).alias(n.lower()) for n in names]),
    }
    types = dict(drafts.dtypes)
    before = {k: F.col(k).cast(CONFIDENCE if k == "confidence" else "double" if k == "estimated_time" else types[k]) if k in types else F.lit("heuristic") if k == "analysis_mode" else F.lit(None) for k in new}
    return rows.withColumns({k: F.when(F.col("__m").isNotNull(), v).otherwise(before[k]) for k, v in new.items()}).drop("__m")
