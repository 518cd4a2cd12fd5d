"""How rows lie over tasks before costly work on their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where fewer files than cores hold them; rows of more files, of none, or of a stream, as they are.

    One task reads a row group of Parquet, so a table of a few files leaves most cores idle, whatever its texts cost.
    Only such tables are shuffled, and a shuffle by rows: one large key does not stay together.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if rows.isStreaming or not 0 < len(rows.inputFiles()) < cores:
        return rows
    return rows.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))


#: Rows of a written table that a join may send through the driver.
FEW = 1 << 18


def by_rows(rows: DataFrame) -> DataFrame:
    """A written table for a join: by its bytes if its rows are few, never through the driver if they are many.

    Columns that compress well make a table of millions of rows smaller on disk than what Spark broadcasts.
    """
    return rows if rows.count() <= FEW else rows.hint("merge")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by keys over as many tasks as a shuffle has, for a join or an aggregate by them that costs more than its rows weigh.

    Adaptive execution puts the partitions of a shuffle together by bytes, so small rows with costly work would end in a
    few tasks; a stated number stays.
    """
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
