from pyspark.sql import functions as F

from taskloom.operators.layout import spread


def test_spread(spark, tmp_path):
    rows = spark.range(1000).withColumn("hot", F.lit("x"))
    cores = spark.sparkContext.defaultParallelism
    one, many, none = (str(tmp_path / n) for n in ("one", "many", "none"))
    rows.coalesce(1).write.parquet(one)
    rows.repartition(cores).write.parquet(many)
    rows.where("false").write.parquet(none)
    wide = spread(spark.read.parquet(one))
    sizes = [r["count"] for r in wide.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= cores and max(sizes) < 500  # rows of one key do not stay together
    assert sorted(r.id for r in wide.collect()) == list(range(1000)) and wide.columns == ["id", "hot"]
    kept = spark.read.parquet(many)
    assert spread(kept) is kept and spread(rows) is rows  # as many files as cores, and no files at all
    assert spread(spark.read.parquet(none)).count() == 0
