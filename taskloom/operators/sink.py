"""Writing drafts: adaptation to a target schema, per-row outcomes, reports."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import data_url
from ..functions.textual import chunks, js_number, let, number, or_else, sub, text, trim
from ..sources.pool import ALIASES as SOURCE_ALIASES
from . import ledger

HISTORY, MOST_IMAGE, MOST_ATTACHED = 30, 20 * 1024 * 1024, 1024 * 1024
#: Rows of a commit that a task writes, about.
MOST_ROWS = 1 << 16
#: Aliases of the target's columns by the draft's field.
ALIASES = {{"image_url": "image_data_url"}.get(k, k): v for k, v in SOURCE_ALIASES.items()}


def target_column(columns: list[str], aliases: list[str]) -> str | None:
    """The target column for a field: an alias as it stands, else without regard to case."""
    lower = {c.lower(): c for c in columns}
    return next((a for a in aliases if a in columns), next((lower[a.lower()] for a in aliases if a.lower() in lower), None))


def coerce(value: Column, kind: str, numeric: Column | None = None) -> Column | None:
    """A text as a value of the target type; None for a type that is not known."""
    some = F.nullif(text(value), F.lit(""))
    if kind in ("title", "rich_text"):
        return chunks(text(value))
    if kind == "number":
        parsed = F.nullif(number(text(value)), F.lit(0.0))
        return parsed if numeric is None else F.coalesce(numeric, parsed)
    if kind in ("select", "status", "url"):
        return some
    if kind == "multi_select":
        return F.filter(F.transform(F.split(text(value), ","), trim), lambda t: t != "")
    return None


def adapt(rows: DataFrame, schema: dict[str, str], fields: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Rows with the target's columns that their fields have aliases for; the others are dropped.

    Points fall back from their text to the number; numbers go into number columns as they are, 0 too.
    A ``files`` column gets the draft's image as struct<name, mime, bytes>.
    """
    texts = {"points": or_else(text("points_raw"), js_number(F.col("max_points"))) if {"points_raw", "max_points"} <= set(rows.columns) else None}
    numbers = {"points": "max_points", "estimated_time": "estimated_time", "class_level": "class_level"}
    out = {}
    for field, aliases in fields.items():
        name = target_column(list(schema), aliases)
        if not name:
            continue
        if schema[name] == "files" and "image_data_url" in rows.columns:
            out.setdefault(name, image_file(rows))
            continue
        said = texts.get(field)
        if said is None:
            if field not in rows.columns:
                continue
            said = F.col(field).cast("double") if dict(rows.dtypes)[field] in ("double", "float") else F.col(field)
            said = js_number(said) if dict(rows.dtypes)[field] in ("double", "float") else said.cast("string")
        plain = F.col(numbers[field]).try_cast("double") if numbers.get(field) in rows.columns else None
        value = coerce(said, schema[name], plain)
        if value is not None:
            out.setdefault(name, value)
    return rows.select(*[v.alias(k) for k, v in out.items()])


def image_file(rows: DataFrame) -> Column:
    """struct<name, mime, bytes> of ``image_data_url``, named ``image_name`` or after the title; null without image.

    A malformed data URL and an image over 20 MiB are errors.
    """
    url = F.col("image_data_url")
    made = F.concat(or_else(sub(text("title"), "(?iu)[^a-z0-9äöüß_-]+", "-"), F.lit("aufgabe")), F.lit(".png"))
    name = or_else(text("image_name"), made) if "image_name" in rows.columns else made

    def checked(p: Column) -> Column:
        problem = image_problem(p)
        return F.when(problem.isNotNull(), F.raise_error(problem).cast("struct<name:string,mime:string,bytes:binary>")).otherwise(F.struct(name.alias("name"), p["mime"].alias("mime"), p["bytes"].alias("bytes")))

    return F.when(text(url) != "", let(data_url(url), checked))


def image_problem(parts: Column) -> Column:
    """Why the struct of :func:`data_url` can't be written: malformed or over 20 MiB; else null."""
    return F.when(parts.isNull(), "image is malformed").when(F.length(parts["bytes"]) > MOST_IMAGE, "image is over 20 MiB")


def attach_image(name: Column, mime: Column, content: Column) -> Column:
    """struct<image_data_url, image_name, problem> of a picture chosen by hand: of type image/*, 1 MiB at most."""
    problem = F.when(~text(mime).startswith("image/"), "not an image").when(F.length(content) > MOST_ATTACHED, "image is over 1 MiB")
    url = F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))
    return F.struct(F.when(problem.isNull(), F.replace(url, F.lit("\r\n"), F.lit(""))).alias("image_data_url"), F.when(problem.isNull(), name).alias("image_name"), problem.alias("problem"))


def outcomes(drafts: DataFrame, known: DataFrame) -> DataFrame:
    """Included drafts with ``ok`` and ``error``: title and question present, partition known, image sound."""
    # the partitions of a pool are few, and the drafts of one are many: a shuffle by partition would bring them into one task
    partitions = F.broadcast(known.select("class_level", "topic", "competence").distinct().withColumn("__known", F.lit(True)))
    rows = drafts.where("include").join(partitions, ["class_level", "topic", "competence"], "left")
    error = F.when(trim(text("title")) == "", "title is empty").when(trim(text("question_text")) == "", "text is empty").when(F.col("__known").isNull(), "partition is unknown")
    if "image_data_url" in drafts.columns:
        error = F.coalesce(error, F.when(text("image_data_url") != "", image_problem(data_url(F.col("image_data_url")))))
    return rows.withColumn("error", error).withColumn("ok", F.col("error").isNull()).drop("__known")


def report(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("ok")).alias("imported"), F.count_if(~F.col("ok")).alias("failed"))


def commit(drafts: DataFrame, known: DataFrame, path: str, work: str) -> DataFrame:
    """Append the good drafts to the pool at ``path``; the outcomes (``ok``, ``error``) of all included ones.

    Outcomes are judged once and written to the folder ``work``, which the returned rows are read from. If the
    pool can't be written, no draft of the commit counts as written and each has the failure as its error.
    """
    spark = drafts.sparkSession
    rows = outcomes(drafts, known)
    rows.write.mode("overwrite").parquet(work)
    rows = spark.read.schema(rows.schema).parquet(work)
    try:
        good = rows.where("ok").drop("ok", "error")
        # a task sorts its rows by partition before it writes them, so rows that a task has are bounded
        if (many := -(-good.count() // MOST_ROWS)) > 1:
            good = good.withColumn("__n", F.monotonically_increasing_id()).repartition(many, "__n").drop("__n")
        good.write.mode("append").partitionBy("class_level", "topic", "competence").parquet(path)
    except (PySparkException, Py4JError) as failure:
        cause = getattr(failure, "java_exception", None)
        reason = str(cause or failure).split("\n", 1)[0]
        return rows.withColumn("error", F.coalesce("error", F.lit(f"not written: {reason}"))).withColumn("ok", F.lit(False))
    return rows


def send(drafts: DataFrame, known: DataFrame, target, ledger_path: str, transaction: str) -> DataFrame:
    """The good drafts sent one by one to an injected ``target``; ``ok`` and ``error`` of all included ones.

    ``target`` takes a draft as JSON and may raise. A draft that fails has an error of its own and hinders no other.
    What a transaction has sent stands in the ledger, so a repeated one sends only what failed before; equal drafts of a
    transaction are one.
    """
    rows = outcomes(drafts, known)
    payload = F.when(F.col("ok"), F.to_json(F.struct(*drafts.columns)))
    sent = ledger.called(rows.withColumn("__payload", payload), "__payload", target, ledger_path, "__sent", scope=transaction)
    failed = F.col("__sent_error")
    return sent.withColumn("error", F.coalesce("error", failed)).withColumn("ok", F.col("error").isNull()).drop("__payload", "__sent", "__sent_error")


def still_open(drafts: DataFrame, failed: DataFrame) -> DataFrame:
    """Drafts that failed, by title."""
    return drafts.join(failed.select("title").distinct(), "title", "left_semi")


def history(log: DataFrame, most: int = HISTORY) -> DataFrame:
    """The newest entries."""
    return log.orderBy(F.desc("at")).limit(most)


def with_entry(log: DataFrame, committed: DataFrame, at: Column, files: list[str], most: int = HISTORY) -> DataFrame:
    """The history with an entry for a commit: at, files, imported, failed, titles; the newest ones stay."""
    titles = F.sort_array(F.collect_list(F.when(F.col("ok"), F.col("title"))))  # of the drafts of one commit
    entry = committed.agg(F.count_if(F.col("ok")).alias("imported"), F.count_if(~F.col("ok")).alias("failed"), titles.alias("titles"))
    entry = entry.select(at.alias("at"), F.array(*map(F.lit, files)).cast("array<string>").alias("files"), "imported", "failed", "titles")
    return history(log.unionByName(entry), most)
