import datetime

from pyspark.sql import functions as F

from taskloom import streaming
from taskloom.operators import segment


def test_drafts_of_a_file_stream(spark, tmp_path):
    schema = "name string, text string"
    rows = [("Blatt Klasse 8", "1. Berechne 3 + 4\na) x\n2. Zeichne den Graph"), ("b", "nichts"), ("c", "Aufgabe 1: d) 4\nd) 4\n3 x = 7")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.json(str(tmp_path / "in" / f"{i}"))
    docs = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    out = streaming.stream_drafts(docs, "name", "text")
    q = out.writeStream.format("memory").queryName("drafts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.source_file, r.segment, r.question_text) for r in spark.table("drafts").collect()}
    batch = streaming.stream_drafts(spark.createDataFrame(rows, schema), "name", "text")
    assert got == {(r.source_file, r.segment, r.question_text) for r in batch.collect()} and len(got) == 3
    assert any("\\frac{3}{4}" in t for _, _, t in got)


def test_windowed_counts_with_late_rows(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    schema = "at timestamp, class_level string"
    for i, batch in enumerate([[(at(9, 1), "7"), (at(9, 5), "7"), (at(9, 12), "8")], [(at(12, 0), "7")], [(at(9, 2), "7"), (at(14, 0), "7")]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        docs = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        rows = streaming.drafts_by_window(docs, "at")
        q = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).where(F.col("start") < at(11, 0))
    assert {tuple(r) for r in out.collect()} == {(at(9, 0), "7", 2), (at(9, 10), "8", 1)}  # the late row isn't counted


def test_chunks_of_pages(spark):
    text = "vor\n[[PAGE:1]]\n1. Rechne 1\nx\n[[PAGE:2]]\n2. Rechne 2\n[[PAGE:3]]\ny\n[[PAGE:4]]\n[[PAGE:4]]\nz\n[[PAGE:5]]"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc int, text string")
    rows = [(r.segment, r.text, r.pages) for r in segment.task_chunks(df, "doc", "text").orderBy("segment").collect()]
    assert rows == [(1, "1. Rechne 1\nx", [1]), (2, "2. Rechne 2\ny\nz", [2, 3, 4])]
