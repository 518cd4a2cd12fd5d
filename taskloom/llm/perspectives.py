"""Chat formatting by perspective rotation, in DataFrame operations only.

A conversation is rendered once for each of its participants (the distinct roles): that speaker's
turns stand as ``assistant``, all others as users with their own names. The loss mask marks what
the speaker says. A dialogue is rendered in segments, one a turn, each with its place (character
offset) in the dialogue; the dialogue is the segments in order of ``seq``. So a conversation of any
length, even one with a third of all turns, is never gathered in one row or task: places come from
block sums (turns are dealt into blocks by value ranges, and sums of blocks are few).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


#: What the marks begin with, and what stands for that in texts and names, so that none can forge a turn.
MARK, SAFE = "<|im_", r"<\|im_"


def safe(c: Column) -> Column:
    return F.replace(c, F.lit(MARK), F.lit(SAFE))


def header(role: Column, speaker: Column) -> Column:
    """Opening of a segment: assistant, system, or a user with the speaker's name, on one line."""
    name = F.regexp_replace(safe(role), r"[\r\n]", " ")
    return F.when(role == speaker, F.lit(f"{OPEN}assistant\n")).when(role == SYSTEM, F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, seq, turn, segment, start, mask_start, mask_end) of all renderings.

    perspective: every distinct role of the conversation other than ``system``; seq: the turn's
    place in the conversation, from 0, by turn, role, digest of the text (nulls first, so ties and repeated turns
    have a defined order). start: the segment's character offset in the dialogue. mask_start and
    mask_end: the span within the dialogue to train on (the text and closing mark of the speaker's
    turns), null in others' turns. Null texts render as empty, null roles as ``unknown``; a null
    conversation id is a conversation of its own. The beginning of a mark within a text or a name is
    written ``<\\|im_``, and line ends in a name as blanks, so that no turn can be forged. Other columns are
    not read; an empty table has no renderings; texts may be of any length.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), safe(F.coalesce(F.col(text_col), F.lit(""))).alias("text")
    )
    rows = rows.withColumn("digest", F.md5("text"))
    order = ["conv_id", "turn", "role", "digest"]
    spread = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # equal rows get equal renderings apart from their place, so they may stand in any order
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(spread, *order, "salt").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "turns")
    sizes = dealt.groupBy("conv_id", "part", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    people = sizes.select("conv_id", "role").where(F.col("role") != SYSTEM).distinct().withColumnRenamed("role", "perspective")
    sizes = sizes.alias("s").join(people.alias("p"), F.col("s.conv_id").eqNullSafe(F.col("p.conv_id"))).select("s.conv_id", "part", "role", "perspective", "n", "chars")
    width = F.col("chars") + F.col("n") * (F.length(header(F.col("role"), F.col("perspective"))) + len(CLOSE))
    # one row for each task that holds turns of the conversation
    blocks = sizes.groupBy("conv_id", "perspective", "part").agg(F.sum("n").alias("n"), F.sum(width).alias("width"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "perspective", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("width").over(before), F.lit(0)).alias("w0"))
    blocks = materialize(blocks, "blocks")
    a, b = dealt.alias("a"), blocks.alias("b")
    both = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.part") == F.col("b.part")))
    both = both.select("a.conv_id", "a.part", "perspective", "turn", "role", "text", "digest", "salt", "n0", "w0", header(F.col("role"), F.col("perspective")).alias("head"))
    both = both.withColumn("segment", F.concat("head", "text", F.lit(CLOSE)))
    own = Window.partitionBy("conv_id", "part", "perspective").orderBy("turn", "role", "digest", "salt")
    placed = both.select(
        "conv_id",
        "perspective",
        (F.row_number().over(own) - 1 + F.col("n0")).cast("long").alias("seq"),
        "turn",
        "segment",
        (F.coalesce(F.sum(F.length("segment")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("w0")).cast("long").alias("start"),
        (F.col("role") == F.col("perspective")).alias("mine"),
        F.length("head").alias("head"),
    )
    mask = lambda c: F.when(F.col("mine"), c.cast("long"))
    return placed.select(
        "conv_id", "perspective", "seq", "turn", "segment", "start", mask(F.col("start") + F.col("head")).alias("mask_start"), mask(F.col("start") + F.length("segment")).alias("mask_end")
    )


def op5_perspectives(conversations: DataFrame) -> DataFrame:
    return rotate(conversations)


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|im_', '<\|im_') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
b AS (
  SELECT t.*, p.perspective,
    CASE WHEN role = perspective THEN '<|im_start|>assistant' || chr(10) WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
      ELSE '<|im_start|>user name=' || regexp_replace(replace(role, '<|im_', '<\|im_'), '[\r\n]', ' ', 'g') || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM b),
o AS (
  SELECT *, row_number() OVER w - 1 AS seq,
    coalesce(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, md5(text)))
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, segment, CAST(start AS BIGINT) AS start,
  CASE WHEN role = perspective THEN CAST(start + length(head) AS BIGINT) END AS mask_start,
  CASE WHEN role = perspective THEN CAST(start + length(segment) AS BIGINT) END AS mask_end
FROM o
"""
