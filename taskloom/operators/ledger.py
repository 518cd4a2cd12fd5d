"""Calls of an injected service whose results are kept: each distinct request is made once, whatever reads the results.

A ledger is a table (key, result, error) in a folder of the caller's; the key is a digest of the request. Requests that
have a result are not made again, by another action, a repeated task's job or a later run; those that failed are.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guard import DEFAULT_WAIT, LEAST_WAIT

LEDGER = "key string, result string, error string"
#: How often a request is made while the service says that it is busy, and the longest wait between.
TRIES, LONGEST_WAIT = 3, 60.0


class Busy(Exception):
    """Raised by a callable whose service asks to wait: ``retry_after`` in seconds, or ``reset`` like ``1.5s`` or ``80ms``."""

    def __init__(self, message: str = "busy", retry_after: str = "", reset: str = ""):
        super().__init__(message)
        self.retry_after, self.reset = retry_after, reset


class Unparsed(Exception):
    """Raised by a callable whose service could not put its answer into the form that was asked for."""


def wait_seconds(retry_after: str, reset: str, least: float = LEAST_WAIT, default: float = DEFAULT_WAIT) -> float:
    """What :func:`guard.retry_seconds` says, of one answer."""

    def number(t: str) -> float | None:
        try:
            return float(t)
        except ValueError:
            return None

    if (after := number((retry_after or "").strip())) is not None and after > 0:
        return after
    for unit, parts in (("s", 1), ("ms", 1000)):
        if m := re.search(rf"([0-9.]+){unit}", reset or "", re.I):
            if (value := number(m[1])) is not None:
                return max(least, value / parts)
    return default


def _made(call: Callable[[str], str | None], request: str, tries: int) -> tuple[str | None, str | None]:
    for left in reversed(range(tries)):
        try:
            return call(request), None
        except Busy as e:
            if not left:
                return None, str(e)
            time.sleep(min(LONGEST_WAIT, wait_seconds(e.retry_after, e.reset)))
        except Exception as e:  # the callable is not ours
            return None, str(e) or type(e).__name__
    return None, None


def called(rows: DataFrame, request_col: str, call: Callable[[str], str | None], path: str, out_col: str = "answer", scope: str = "", tries: int = TRIES) -> DataFrame:
    """``rows`` with ``out_col`` and ``<out_col>_error``: what ``call`` gave for each distinct request, from the ledger at ``path``.

    A null request is not made. Calls go one after the other within a task; a busy service is asked up to ``tries`` times,
    after the wait that it names. A failure is an error of its request alone. ``scope``: requests of different scopes
    (such as transactions) are different. The calls are made when this function is called, not when its rows are read.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("__key", F.sha2(F.concat(F.lit(f"{len(scope)}:{scope}"), F.col(request_col)), 256))
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    ledger = lambda: spark.read.schema(LEDGER).parquet(path)
    open_ = keyed.where(F.col(request_col).isNotNull()).groupBy(F.col("__key").alias("key")).agg(F.first(request_col).alias("request"))
    open_ = open_.join(ledger().where("error is null").select("key"), "key", "left_anti")

    def run(batches):
        for b in batches:
            got = [_made(call, r, tries) for r in b["request"]]
            yield pd.DataFrame({"key": b["key"], "result": [r for r, _ in got], "error": [e for _, e in got]})

    open_.mapInPandas(run, LEDGER).write.mode("append").parquet(path)
    best = F.min_by(F.struct("result", "error"), F.col("error").isNotNull())  # a result goes before failures
    said = ledger().groupBy(F.col("key").alias("__key")).agg(best.alias("__said"))
    out = keyed.join(said, "__key", "left")
    return out.select(*rows.columns, F.col("__said.result").alias(out_col), F.col("__said.error").alias(f"{out_col}_error"))


def answered(rows: DataFrame, prompt_col: str, ask: Callable[[str, bool], str | None], path: str, again: str = "", out_col: str = "answer", tries: int = TRIES) -> DataFrame:
    """:func:`called` for a model that is asked for JSON: ``ask`` takes a prompt and whether the form is strict.

    An answer that could not be put into the strict form (:class:`Unparsed`) is asked for once more, with ``again`` after
    the prompt and without that form.
    """

    def call(prompt: str) -> str | None:
        try:
            return ask(prompt, True)
        except Unparsed:
            return ask(prompt + again, False)

    return called(rows, prompt_col, call, path, out_col, tries=tries)
