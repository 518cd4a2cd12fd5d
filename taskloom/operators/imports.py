"""Import of documents: sources, corrections, drafts, expectations, duplicates, warnings, summary."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import guard
from ..schema import TOPICS_BY_CLASS
from ..sources import documents as files
from . import segment, similarity
from .layout import dealt


class Imported:
    """What an import returns: drafts, warnings (source, code, page, detail), summary (name, characters, images, method)
    and errors (name, error). Each table is worked out when it is first asked for; drafts are found for ``drafts`` and ``errors``,
    and their duplicates are looked up for ``drafts`` alone.
    """

    def __init__(self, drafts: Callable[[], DataFrame], warnings: DataFrame, summary: DataFrame, errors: Callable[[], DataFrame]) -> None:
        self._drafts, self.warnings, self.summary, self._errors = drafts, warnings, summary, errors

    @cached_property
    def drafts(self) -> DataFrame:
        return self._drafts()

    @cached_property
    def errors(self) -> DataFrame:
        return self._errors()


#: Stands between an upload's key and a file's name while files of several uploads are read together.
_JOINT = "\u001f"


def source_drafts(sources: DataFrame, default_class: str | None = None, default_topic: str | None = None, *by: str) -> DataFrame:
    """Heuristic drafts of sources, with images and the expectations of the sources' tables.

    by: columns of the sources that tell requests apart; drafts have them, too. Drafts are found once and written.
    """
    lit = lambda v: F.lit(v) if v else None
    body = sources.withColumn("__body", F.coalesce(F.nullif("simplified", F.lit("")), "text")).withColumn("__pdf", F.col("mime_type") == files.MIME["pdf"])
    pictures = body.select("name", "__body", F.col("images").alias("__images"), "__pdf")
    chunks = segment.task_chunks(pictures, "name", "__body", "__images", "__pdf")
    title = F.substring_index("doc", _JOINT, -1)
    rows = segment.drafts(chunks, title, lit(default_class), lit(default_topic), F.col("__images"), F.col("__pdf"))
    if by:
        rows = rows.join(sources.select(F.col("name").alias("doc"), *by).hint("merge"), "doc").select(*rows.columns, *by)
    return segment.with_expectations(scratch.written(rows, "drafts"), sources, "name", *by)


def corrected_sources(sources: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources with accepted corrections (name, page_number, text) of their pages, and the outcome of each page.

    Only PDF sources whose text can be trusted are corrected, and of these only trusted pages.
    """
    drafts = segment.task_chunks(sources.withColumn("__body", F.coalesce(F.nullif("simplified", F.lit("")), "text")), "name", "__body").groupBy(F.col("doc").alias("name")).agg(F.count("*").alias("__n"))
    pdf = F.col("mime_type") == files.MIME["pdf"]
    known = sources.join(drafts, "name", "left").withColumn("__ok", pdf & guard.trusted_document(F.col("text"), F.coalesce("__n", F.lit(0)), F.coalesce(F.size("pages"), F.lit(0)))).drop("__n")
    pages = known.where("__ok").select(F.col("name").alias("doc"), F.explode("pages").alias("p")).select("doc", F.col("p.page_number").alias("page"), "p.text")
    proposed = corrections.select(F.col("name").alias("doc"), F.col("page_number").cast("int").alias("page"), "text")
    judged = guard.apply_corrections(dealt(pages, "doc", "page"), dealt(proposed, "doc", "page"), trusted=True)
    listed = judged.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(F.col("page").alias("page_number"), "text"))).alias("__pages"))  # of one document
    both = known.join(listed, F.col("name") == F.col("doc"), "left")
    redone = F.col("__pages").isNotNull()
    out = both.select(
        *[
            {
                "pages": F.coalesce("__pages", "pages"),
                "text": F.when(redone, files.page_text(F.col("__pages"))).otherwise(F.col("text")),
                "simplified": F.when(redone, files.page_text(F.col("__pages"), True)).otherwise(F.col("simplified")),
                "method": F.when(redone, files.METHOD_REPAIRED).otherwise(F.col("method")),
            }.get(c, F.col(c)).alias(c)
            for c in sources.columns
        ]
    )
    untrusted = known.where(pdf & ~F.col("__ok")).select(F.col("name").alias("doc"), F.lit(None).cast("int").alias("page"), F.lit("untrusted").alias("outcome"), F.lit("").alias("reason"))
    return out, judged.select("doc", "page", "outcome", "reason").unionByName(untrusted)


def with_repair_marks(drafts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Drafts with ``math_repair``: visual, rejected or none, by the outcomes of their pages."""
    lists = guard.page_outcomes(outcomes.where("page is not null")).select(F.col("doc").alias("__doc"), F.col("repaired_pages").alias("__r"), F.col("rejected_pages").alias("__x"))
    rows = drafts.join(lists, F.col("doc") == F.col("__doc"), "left")
    return rows.withColumn("math_repair", guard.repair_mark(F.col("source_pages"), F.col("__r"), F.col("__x"))).select(*drafts.columns)


def import_documents(
    uploaded: DataFrame,
    pool: DataFrame,
    class_level: str | None = None,
    topic: str | None = None,
    pages: DataFrame | None = None,
    page_images: DataFrame | None = None,
    corrections: DataFrame | None = None,
    by_class: dict[str, list[str]] = TOPICS_BY_CLASS,
    upload: str | None = None,
) -> Imported:
    """Files as drafts for review, with their candidates of duplicates in ``pool``.

    uploaded: (name, extension, mime_type, content), see :func:`files.extract` for ``pages`` and ``page_images``;
    corrections: (name, page_number, text) that an injected model proposes. pool: task_id, title, question_text,
    class_level, topic, scan_ord. Warnings by code: untrusted, repaired, rejected, skipped, sparse; a file that
    can't be read, and a file without tasks, is in ``errors``.

    All files are one request, unless ``upload`` names a column (of ``uploaded`` and of the tables beside it) that tells
    requests apart. Then each upload is an import of its own: its limits (an upload that breaks one has an error
    without a name, and nothing else), its expectations, warnings and repair marks; all results have the column.
    Sources and drafts are read and found once, and written to the shared folder.
    """
    by = [upload] if upload else []
    refused = None
    if upload:
        said = uploaded.where(F.col(upload).isNotNull())
        limits = scratch.written(files.upload_problem(said.select(upload, F.octet_length("content").alias("bytes")), upload), "limits")
        refused = limits.where("problem is not null").select(upload, F.lit(None).cast("string").alias("name"), F.col("problem").alias("error"))
        # files, uploads and drafts are as many as the import has: joins of them are never sent through the driver
        uploaded = said.join(limits.where("problem is null").select(upload).hint("merge"), upload)
        joint = lambda df: None if df is None else df.withColumn("name", F.concat(F.col(upload).cast("string"), F.lit(_JOINT), "name")).drop(upload)
        requests = joint(uploaded.withColumn("__u", F.col(upload))).select("name", F.col("__u").alias(upload)).distinct()
        uploaded, pages, page_images, corrections = joint(uploaded), joint(pages), joint(page_images), joint(corrections)
    read = scratch.written(files.extract(uploaded, pages, page_images), "sources")
    sources = read.where("error is null").drop("error")
    errors = read.where("error is not null").select("name", "error")
    warnings = files.sparse(sources).select(F.col("name").alias("source"), F.lit("sparse").alias("code"), F.lit(None).cast("int").alias("page"), F.lit("").alias("detail"))
    outcomes = None
    if corrections is not None:
        sources, outcomes = corrected_sources(sources, corrections)
        sources, outcomes = scratch.written(sources, "corrected"), scratch.written(outcomes, "outcomes")
        warnings = warnings.unionByName(outcomes.select(F.col("doc").alias("source"), F.col("outcome").alias("code"), "page", F.col("reason").alias("detail")))
    plain = lambda df, c: df.join(requests.withColumnRenamed("name", c).hint("merge"), c).withColumn(c, F.substring_index(c, _JOINT, -1))

    @cache
    def found() -> DataFrame:
        told = sources.join(requests.hint("merge"), "name") if upload else sources
        rows = source_drafts(told, class_level, topic, *by)
        return rows if outcomes is None else with_repair_marks(rows, outcomes)

    def failed() -> DataFrame:
        empty = sources.select("name").join(found().select(F.col("doc").alias("name")).distinct().hint("merge"), "name", "left_anti").select("name", F.lit("no tasks").alias("error"))
        rows = errors.unionByName(empty)
        return plain(rows, "name").select(upload, "name", "error").unionByName(refused) if upload else rows

    def reviewed() -> DataFrame:
        rows = found()
        if upload:
            rows = rows.withColumns({c: F.replace(c, F.lit(_JOINT), F.lit("/")) for c in ("id", "doc")})
        return deduplicated(rows, pool, by_class)

    summary = files.summary(sources)
    if upload:
        warnings, summary = plain(warnings, "source").select(upload, *warnings.columns), plain(summary, "name").select(upload, *summary.columns)
    return Imported(reviewed, warnings, summary, failed)


def deduplicated(drafts: DataFrame, pool: DataFrame, by_class: dict[str, list[str]] = TOPICS_BY_CLASS) -> DataFrame:
    """Drafts (id, ...) with ``duplicates``, ``duplicate`` and ``include``; what they had of these before goes."""
    own = drafts.drop("duplicate", "duplicates").withColumn("draft_id", F.col("id"))
    own = own.withColumn("topics", similarity.topic_order(F.col("topic"), similarity.class_topics(F.col("class_level"), by_class), similarity.related_topics(F.col("topic"))))
    return similarity.add_duplicates(own, pool).drop("draft_id", "topics")


def refined(drafts: DataFrame, answer_col: str, pool: DataFrame, default_class: str | None = None, default_topic: str | None = None, by_class: dict[str, list[str]] = TOPICS_BY_CLASS) -> DataFrame:
    """Drafts with a model's answers applied, and their duplicates looked up anew."""
    return deduplicated(guard.refine(drafts, answer_col, by_class, default_class, default_topic).drop(answer_col), pool, by_class)


def changed_class(drafts: DataFrame, class_level: Column, by_class: dict[str, list[str]] = TOPICS_BY_CLASS) -> DataFrame:
    """Drafts moved to a class: their topic if the class has it, else its first; duplicates go."""
    topics = similarity.class_topics(class_level, by_class)
    topic = F.when(F.array_contains(topics, F.col("topic")), F.col("topic")).otherwise(F.coalesce(F.get(topics, F.lit(0)), F.lit("")))
    cleared = {c: F.lit(None).cast(t) for c, t in drafts.dtypes if c in ("duplicate", "duplicates")}
    return drafts.withColumns({"topic": topic, **cleared}).withColumn("class_level", class_level)
