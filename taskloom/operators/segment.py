"""Lines of documents, their pages and tasks, and heuristic drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import classify, documents, points
from ..functions.textual import NOT_S, S, circled, lines, or_else, text, trim
from .layout import spread
from .scan import scan

# How a line goes on that begins a task.
STARTS = [
    rf"Aufgabe{S}*\d{{1,2}}{S}*[:.)\-–]?",
    rf"\d{{1,2}}{S}*[:.)\-–]?{S}*\({S}*(?:je{S}*)?{points.SUM}{S}*(?:P\.?|BE){S}*\)",
    rf"\d{{1,2}}{S}*[:.)]{S}+(?!(?:Klassenarbeit|Klausur|Test|Teil|Seite|Klasse|Jahrgang(?:sstufe)?)(?![A-Za-z0-9_]))(?![÷×·+=<>−-]){NOT_S}",
]
# Confidences of heuristic fields, and of an expectation that a document states.
CONFIDENCES, EXPECTED = {"topic": 0.45, "competence": 0.4, "afb": 0.35, "time": 0.45, "expectation": 0.0}, 0.95
PAGE_MARK = rf"(?i)^{S}*\[\[PAGE:(\d+)\]\]{S}*\z"
START = rf"(?i)^{S}*(?:{'|'.join(STARTS)})"


def starts_task(line: Column) -> Column:
    """Whether a line begins a task; circled numbers count as digits, white space in front does not."""
    return circled(text(line)).rlike(START)


def forward_fill(rows: DataFrame, doc: str, order: str, value: str) -> DataFrame:
    """``rows`` with nulls of ``value`` filled from the last row before in the document, which may span tasks."""
    out = scan(rows, [doc], [order], fills={"__filled": value})
    return out.withColumn(value, F.col("__filled")).drop("__filled")


def segments(rows: DataFrame, is_start: Column) -> DataFrame:
    """Lines (doc, line_no, ...) from the first start on with their segment number; a document may span tasks."""
    out = scan(rows.withColumn("__start", is_start.cast("int")), ["doc"], ["line_no"], sums={"__segment": "__start"})
    return out.withColumn("segment", F.col("__segment").cast("int")).where("segment > 0").drop("__start", "__segment")


def task_chunks(docs: DataFrame, doc_col: str, text_col: str, *keep: str, lie: bool = False) -> DataFrame:
    """(doc, segment, text, pages, ...keep) of each document's tasks, without headers and footers.

    One pass over a document's lines, which stay together: a running page and segment go with each line.
    lie: the documents are dealt over all tasks already, and their texts are not shuffled.
    """
    rows = (docs if lie else spread(docs)).select(F.col(doc_col).alias("doc"), *keep, lines(circled(text(text_col))).alias("l"))
    marked = F.transform("l", lambda x: F.struct(x.alias("line"), F.when(x.contains("[["), F.regexp_extract(x, PAGE_MARK, 1)).otherwise("").alias("mark"), x.rlike(START).alias("start")))
    rows = rows.select("doc", *keep, marked.alias("l"))
    starts = F.filter(F.transform("l", lambda x, i: F.when(x["start"] & (x["mark"] == ""), i)), lambda i: i.isNotNull())
    marks = F.filter(F.transform("l", lambda x, i: F.when(x["mark"] != "", F.struct(i.alias("at"), x["mark"].cast("int").alias("page")))), lambda m: m.isNotNull())
    rows = rows.select("doc", *keep, "l", F.size("l").alias("size"), starts.alias("starts"), marks.alias("marks"))

    def chunk(start: Column, n: Column) -> Column:
        end = F.coalesce(F.get("starts", n + 1), F.col("size"))
        own = F.filter(F.slice("l", start + 1, end - start), lambda x: x["mark"] == "")
        before = F.try_element_at(F.filter("marks", lambda m: m["at"] < start), F.lit(-1))["page"]
        # pages that begin within the task and have a line of it: the next mark or end isn't the next line
        after = F.transform("marks", lambda m, k: F.struct(m["at"].alias("at"), m["page"].alias("page"), F.least(F.coalesce(F.get("marks", k + 1)["at"], end), end).alias("until")))
        within = F.transform(F.filter(after, lambda m: (m["at"] > start) & (m["until"] > m["at"] + 1)), lambda m: m["page"])
        pages = F.array_distinct(F.filter(F.concat(F.array(before), within), lambda p: p.isNotNull()))
        return F.struct((n + 1).alias("segment"), documents.clean_chunk(F.array_join(F.transform(own, lambda x: x["line"]), "\n")).alias("text"), pages.alias("pages"))

    own = rows.select("doc", *keep, F.inline(F.transform("starts", chunk)))  # a text is cleaned before: the filter would clean it again
    return own.where(F.length("text") > 0)


def drafts(chunks: DataFrame, name: Column, default_class: Column | None = None, default_topic: Column | None = None, images: Column | None = None, is_pdf: Column | None = None) -> DataFrame:
    """Heuristic drafts of task chunks (doc, segment, text, pages).

    images: the images of the chunk's document; a PDF with a single image lends it to tasks that speak of one.
    Values used by several columns are bound once.
    """
    rows = chunks.withColumn("images", documents.image_indices(F.col("text"))).withColumn("body", documents.without_images(F.col("text")))
    first = F.get(F.filter(F.split("text", "\n"), lambda x: trim(x) != ""), F.lit(0))  # the first line that is not blank
    line = F.substring_index("body", "\n", 1)
    rows = rows.withColumn("heading", F.when(line != "", line).otherwise(F.coalesce(first, F.lit("Aufgabe"))))
    rows = rows.withColumn("clean", documents.clean_heading(F.col("heading")))
    rows = rows.withColumn("task_no", documents.task_number(F.col("heading"))).withColumn("stated", points.document_points(F.col("body")))
    rows = rows.withColumn("points_raw", or_else(F.col("stated"), points.heuristic_points(F.col("body"))))
    rows = rows.withColumn("max_points", points.max_points(F.col("points_raw")))
    rows = rows.withColumn("class_level", classify.guess_class(F.concat(name, F.lit("\n"), F.col("body")), default_class))
    rows = rows.withColumn("topic", classify.guess_topic(F.col("body"), F.col("class_level"), default_topic))
    rows = rows.withColumn("title", documents.title(F.col("body"), F.col("heading"), F.col("task_no"), F.col("clean")))
    rows = rows.withColumn("question_text", documents.question(F.col("body"), F.col("heading"), F.col("clean")))
    rows = rows.withColumn("visual", F.concat_ws(" ", "title", "question_text").rlike(documents.VISUAL))
    picture = F.lit(None).cast("struct<data_url:string,name:string,decorative:boolean>")
    if images is not None:
        single = F.when((F.size(images) == 1) & F.col("visual") & F.coalesce(is_pdf if is_pdf is not None else F.lit(False), F.lit(False)), F.get(images, F.lit(0)))
        picture = usable_image(F.col("images"), images, otherwise=single)
    rows = rows.withColumn("picture", picture)
    return rows.select(
        F.concat_ws("#", F.col("doc").cast("string"), F.col("segment").cast("string")).alias("id"),
        "doc", "segment", name.alias("source_file"), "title", "question_text", "class_level", "topic",
        classify.guess_competence(F.col("question_text")).alias("competence"),
        classify.guess_afb(F.col("question_text")).alias("afb_raw"),
        "points_raw", "max_points",
        F.when(F.col("stated") != "", "document").otherwise("heuristic").alias("points_source"),
        points.estimated_time(F.col("max_points"), F.col("question_text")).alias("estimated_time"),
        F.lit("").alias("expectation"),
        F.col("picture.data_url").alias("image_data_url"), F.col("picture.name").alias("image_name"),
        F.lit(True).alias("include"),
        F.lit("heuristic").alias("analysis_mode"),
        F.lit("none").alias("math_repair"),
        "visual", "images", F.col("pages").alias("source_pages"),
        F.struct(*[F.lit(v).alias(k) for k, v in CONFIDENCES.items()]).alias("confidence"),
    )


def with_expectations(rows: DataFrame, sources: DataFrame, order: str = "name", *by: str) -> DataFrame:
    """Drafts with the expectation of the first fitting row of the sources' tables, and its confidence.

    Rows come in the order of the sources and of their tables; with ``by``, of sources whose columns of these names are equal.
    """
    listed = sources.select(*by, F.col(order).alias("o"), F.posexplode("expectation_rows").alias("i", "r")).select(*by, F.struct("o", "i").alias("ord"), "r.title", "r.expectation")
    return matched(rows, listed, *by)


def matched(rows: DataFrame, expected: DataFrame, *by: str) -> DataFrame:
    """Drafts (title, expectation, confidence, *by) with what the first fitting row (ord, title, expectation, *by) says."""
    said = expected.withColumn("ord", F.struct("ord", "expectation"))  # what a row says goes with its place, so drafts of one row meet it by their titles
    out = first_match(rows, said, *by).withColumn("__said", F.col("ord.expectation"))
    hit = F.col("ord").isNotNull()
    confidence = F.struct(*[F.when(hit, F.when(text("__said") != "", F.lit(EXPECTED)).otherwise(F.lit(0.0))).otherwise(F.col("confidence.expectation")).alias(k) if k == "expectation" else F.col(f"confidence.{k}").alias(k) for k in CONFIDENCES])
    return out.withColumn("expectation", F.when(hit, text("__said")).otherwise(F.col("expectation"))).withColumn("confidence", confidence).select(*rows.columns)


def usable_image(indices: Column, images: Column, limit: int = 350_000, otherwise: Column | None = None) -> Column:
    """The first image of the indices that exists and is not decorative, else ``otherwise``, if it is small enough."""
    there = F.filter(F.transform(indices, lambda i: F.get(images, i)), lambda m: m.isNotNull() & ~F.coalesce(m["decorative"], F.lit(False)))
    first = F.get(there, F.lit(0))
    first = first if otherwise is None else F.coalesce(first, otherwise)
    return F.when(F.length(first["data_url"]) <= limit, first)


def decorative(images: DataFrame, doc: str, payload: str) -> DataFrame:
    """Images with ``n_uses`` in their document; several uses mark decoration."""
    uses = images.groupBy(doc, payload).agg(F.count("*").alias("n_uses"))
    a, b = images.alias("a"), uses.alias("b")
    both = a.join(b, F.col(f"a.{doc}").eqNullSafe(F.col(f"b.{doc}")) & F.col(f"a.{payload}").eqNullSafe(F.col(f"b.{payload}")))
    return both.select("a.*", "n_uses", (F.col("n_uses") > 1).alias("is_decorative"))


#: Sizes of the pieces by which a title and one that contains it meet: the largest that the shorter one has.
PIECES = [8, 4, 3, 2, 1]


def _contained(short: DataFrame, long: DataFrame, *by: str) -> DataFrame:
    """Rows of ``short`` (s, ...) and ``long`` (l, ...) whose key s stands within l, and whose ``by`` are equal.

    They meet at the rarest piece of s, by the number of keys l that have it; an s of which a piece is nowhere is
    in no l. So a beginning that all titles share brings none of them together. Pieces are many times the keys, whose
    bytes on disk say nothing of them, so no side goes through the driver.
    """

    def cut(c: Column, n: int) -> Column:
        size = F.length(c)
        some = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
        return F.when(size >= n, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))

    size = F.length("s")
    own = F.lit(None).cast("array<string>")
    for n in reversed(PIECES):
        own = F.when(size >= n, cut(F.col("s"), n)).otherwise(own)
    keys, others = short.select(*by, "s").distinct(), long.select(*by, "l").distinct()
    pieces = keys.select(*by, "s", F.size(own).alias("__n"), F.explode(own).alias("__piece"))
    where = others.select(*by, "l", F.explode(F.concat(*[cut(F.col("l"), n) for n in PIECES])).alias("__piece"))
    counts = where.groupBy(*by, "__piece").agg(F.count("*").alias("__f"))
    rarest = pieces.join(counts.hint("merge"), [*by, "__piece"]).groupBy(*by, "s", "__n").agg(F.min(F.struct("__f", "__piece")).alias("__r"), F.count("*").alias("__have"))
    rarest = rarest.where("__have = __n").select(*by, "s", F.col("__r.__piece").alias("__piece"))
    pairs = rarest.join(where.hint("merge"), [*by, "__piece"]).where(F.col("l").contains(F.col("s"))).select(*by, "s", "l")
    return short.join(pairs.hint("merge"), [*by, "s"]).join(long.hint("merge"), [*by, "l"])


def first_match(rows: DataFrame, expected: DataFrame, *by: str) -> DataFrame:
    """Drafts (draft_id, title, *by) with the first expectation row (ord, title, *by) whose title fits.

    Titles fit if their keys are equal or, for keys longer than 3, one contains the other. Distinct keys are
    compared; an empty expectation key is contained in every key longer than 3. ``by``: columns without nulls that have
    to be equal.
    """
    left = rows.withColumn("key", documents.title_key(F.col("title")))
    right = scratch.written(expected.withColumn("other", documents.title_key(F.col("title"))).groupBy(*by, "other").agg(F.min("ord").alias("ord")), "expected")
    keys = scratch.written(left.select(*by, "key").distinct(), "keys")
    long = keys.where(F.length("key") > 3)
    equal = keys.join(right.withColumnRenamed("other", "key").hint("merge"), [*by, "key"]).select(*by, "key", "ord")
    within = _contained(long.select(*by, F.col("key").alias("s")), right.select(*by, F.col("other").alias("l"), "ord"), *by).select(*by, F.col("s").alias("key"), "ord")
    around = _contained(right.where("other <> ''").select(*by, F.col("other").alias("s"), "ord"), long.select(*by, F.col("key").alias("l")), *by).select(*by, F.col("l").alias("key"), "ord")
    blank = right.where("other = ''").select(*by, "ord")  # one row at most for each of ``by``
    blank = long.join(blank.hint("merge"), list(by)) if by else long.join(F.broadcast(blank))
    best = equal.unionByName(within).unionByName(around).unionByName(blank.select(*by, "key", "ord")).groupBy(*by, "key").agg(F.min("ord").alias("ord"))
    # with ``by`` there may be as many keys as rows; without, titles of one key are many and go to their match
    return left.join(best.hint("merge") if by else best, [*by, "key"], "left").drop("key")
