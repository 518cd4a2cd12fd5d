"""Row-local rules on streams: pages repaired and checked, lines and tasks found, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.documents import repair_math
from ..operators import segment


def stream_drafts(docs: DataFrame, name_col: str, text_col: str) -> DataFrame:
    """Heuristic drafts of documents that arrive as a stream: each document's tasks depend on itself alone, so there is no state."""
    rows = docs.withColumn(text_col, repair_math(F.col(text_col)))
    return segment.drafts(segment.task_chunks(rows, name_col, text_col), F.col("doc"))


def drafts_by_window(drafts: DataFrame, at_col: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, class_level, n_drafts): drafts of a stream counted by time window and class; later ones than ``late`` are left out."""
    rows = drafts.withWatermark(at_col, late)
    counted = rows.groupBy(F.window(at_col, width), "class_level").agg(F.count("*").alias("n_drafts"))
    return counted.select(F.col("window.start").alias("start"), "class_level", "n_drafts")
