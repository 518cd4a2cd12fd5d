import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from taskloom.operators import imports, sheets, sink
from taskloom.sources import documents, pool

RECORDS = [
    {"object": "page", "id": "p1", "properties": {
        "Titel": {"type": "title", "title": [{"plain_text": "Sum"}, {"text": {"content": "me"}}]},
        "aufgabe": {"type": "rich_text", "rich_text": [{"plain_text": "a) x\n*b) y"}]},
        "AFB": {"type": "select", "select": {"name": "AFB 2"}},
        "Punkte": {"type": "rich_text", "rich_text": [{"plain_text": "1+2"}]},
        "Kompetenz": {"type": "multi_select", "multi_select": [{"name": "Problem lösen"}, {"name": "x"}]},
        "Thema": {"type": "status", "status": {"name": "Terme"}},
        "Zeit": {"type": "select", "select": {"name": "10 min"}},
        "Bild": {"type": "files", "files": [{"external": {"url": " http://x/y.png "}}]},
        "Klasse": {"type": "rollup", "rollup": {"type": "array", "array": [{"type": "number", "number": 7}, {"type": "select", "select": {"name": "b"}}]}}}},
    {"object": "page", "id": "p2", "properties": {"Punktzahl": {"type": "formula", "formula": {"number": 4.5}}}},
    {"object": "list", "id": "no", "properties": {}},
]


def test_records_to_tasks(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in RECORDS))
    rows = {r.id: r for r in pool.read_tasks(pool.read_records(spark, str(tmp_path / "r.json"))).collect()}
    assert set(rows) == {"p1", "p2"}
    a, b = rows["p1"], rows["p2"]
    assert (a.title, a.competence, a.topic, a.class_level, a.max_points, a.estimated_time, a.image_url) == ("Summe", "Problemlösen", "Terme", "7, b", 3.0, 10.0, "http://x/y.png")
    assert [s.is_star for s in a.sub_tasks] == [False, True] and a.points_by_afb == {"AFB2": 3.0}
    assert (b.title, b.topic, b.max_points, b.points_by_afb) == ("Aufgabe", "Allgemein", 4.5, {"AFB1": 4.5})


def test_catalogue_and_scan(spark, tmp_path):
    cat = pool.catalogue(spark, json.dumps({"7": {"Terme": {"Mathematik": "a-1", "Modellieren": " "}}, "8": {"Flächen": {"Mathematik": "b"}}}))
    assert [tuple(r)[:4] for r in cat.orderBy("ord").collect()] == [("7", "Terme", "Mathematik", "a1"), ("8", "Flächen", "Mathematik", "b")]
    assert pool.first_source(cat).first().source_id == "a1"
    assert pool.sources_for(cat, "7", "Terme", ["Mathematik"]).count() == 1
    with pytest.raises(ValueError):
        pool.sources_for(cat, "7", "Terme")
    with pytest.raises(ValueError):
        pool.sources_for(cat, "9", "Terme")
    tasks = spark.createDataFrame([("1", "7", "Terme", "Mathematik"), ("2", "8", "Flächen", "Mathematik")], "id string, class_level string, topic string, competence string")
    pool.write_pool(tasks, str(tmp_path / "pool"))
    got = pool.scan_pool(spark, str(tmp_path / "pool"), "7", "Terme")
    assert [r.id for r in got.collect()] == ["1"]
    assert "PartitionFilters: [" in got._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        pool.scan_pool(spark, str(tmp_path / "pool"), "7")


def test_meta(spark):
    by_class, topics = pool.pool_meta(pool.default_meta(spark).withColumnRenamed("topic_ord", "ord"))
    assert [r.class_level for r in by_class.collect()] == ["7", "8", "9", "10"] and topics.count() == 20


def test_adapt(spark, ev):
    assert sink.target_column(["titel", "X"], ["Titel", "Name"]) == "titel" and sink.target_column(["X"], ["Y"]) is None
    assert ev(sink.coerce(F.lit("2,5"), "number")) == 2.5 and ev(sink.coerce(F.lit("0"), "number")) is None
    assert ev(sink.coerce(F.lit("a, b,,"), "multi_select")) == ["a", "b"] and ev(sink.coerce(F.lit(""), "select")) is None
    rows = spark.createDataFrame([("t", "3")], "title string, points string")
    out = sink.adapt(rows, {"Name": "title", "punkte": "number", "Z": "odd"}, {"title": ["Titel", "Name"], "points": ["Punkte"]})
    assert out.columns == ["Name", "punkte"] and tuple(out.first()) == (["t"], 3.0)


def test_commit(spark, tmp_path):
    d = spark.createDataFrame([("a", "q", "7", "T", "M", True), ("", "q", "7", "T", "M", True), ("b", "q", "7", "U", "M", True), ("c", "q", "7", "T", "M", False)], "title string, question_text string, class_level string, topic string, competence string, include boolean")
    known = spark.createDataFrame([("7", "T", "M")], "class_level string, topic string, competence string")
    assert tuple(sink.report(sink.commit(d, known, str(tmp_path / "p"), str(tmp_path / "w"))).first()) == (1, 2)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    failed = sink.outcomes(d, known).where("not ok")
    assert sorted(r.title for r in sink.still_open(d, failed).collect()) == ["", "b"]


def test_selection_and_sheet(spark):
    tasks = spark.createDataFrame([(i, f"t{i}", "", float(i), "") for i in range(1, 6)], "id int, title string, points_raw string, max_points double, expectation string")
    chosen = spark.createDataFrame([(0, 4), (1, 2), (2, 9), (3, 5), (4, 1)], "ord int, id int")
    flags = spark.createDataFrame([(2, True)], "id int, on_extra_sheet boolean")
    rows = sheets.numbered(sheets.selection(tasks, chosen, flags))
    assert [(r.id, r.number, r.on_extra_sheet) for r in rows.orderBy("number").collect()] == [(4, 1, False), (2, 2, True), (5, 3, False), (1, 4, False)]
    grid = [tuple(r) for r in sheets.overview(rows).orderBy("grid_row").collect()]
    assert grid == [(0, "Aufgabe 1", "4", "Aufgabe 2", "2", "Aufgabe 3", "5"), (1, "Aufgabe 4", "1", "", "", "", "")]
    first = sheets.expectation_sheet(rows).where("number = 1").first()
    assert (first.title, first.expectation, first.points) == ("t4", "–", "4")


def test_headings(ev):
    head = lambda title, raw: ev(sheets.heading(F.lit(1), F.lit(title), F.lit(raw), F.lit(2.0)))
    assert head("T", " 3+4 ") == "Aufgabe 1: T (3+4 P.)" and head("", "") == "Aufgabe 1: Aufgabe (2 P.)"


def test_unknown_source_is_an_error(spark):
    ids = spark.createDataFrame([("Mathematik", "d-b", "7", "Terme")], "competence string, source_id string, class_level string, topic string")
    kids = spark.createDataFrame([("db", 0, "k-1"), ("db", 1, "k2"), ("x", 0, "")], "database_id string, source_ord int, child_id string")
    known = spark.createDataFrame([("o-wn",)], "source_id string")
    assert sorted(r.data_source_id for r in pool.resolve_sources(ids, kids, known).collect()) == ["k1", "k2"]
    own = ids.withColumn("source_id", F.lit("ow-n"))
    assert [r.data_source_id for r in pool.resolve_sources(own, kids, known).collect()] == ["own"]
    with pytest.raises(Exception, match="Mathematik: unknown source no"):
        pool.resolve_sources(ids.withColumn("source_id", F.lit("no")), kids, known).collect()
    with pytest.raises(ValueError):
        pool.load_tasks(own, own, kids, known, "7", None)


def test_paged_source(spark, tmp_path):
    from taskloom.sources import paged

    def page(source, name, results, after=None):
        (tmp_path / source).mkdir(exist_ok=True)
        (tmp_path / source / f"{name}.json").write_text(json.dumps({"results": results, "has_more": after is not None, "next_cursor": after}))

    page("s1", "start", RECORDS[:1], "c2")
    page("s1", "c2", RECORDS[1:])
    page("s2", "start", [])
    rows = paged.read_paged(spark, str(tmp_path))
    assert sorted(r.id for r in rows.collect()) == ["p1", "p2"]
    assert {r.title for r in pool.read_tasks(rows).collect()} == {"Summe", "Aufgabe"}
    assert paged.read_paged(spark, str(tmp_path), ["s2"]).count() == 0
    page("s2", "start", [], "start")
    with pytest.raises(Exception, match="bad cursor"):
        paged.read_paged(spark, str(tmp_path), ["s2"]).collect()


def test_pages_written_and_read(spark, tmp_path):
    from taskloom.sources import paged

    rows = [("s", "start", "ä1", json.dumps(RECORDS[:1])), ("s", "ä1", None, json.dumps([*RECORDS[1:], {"object": "list"}])), ("none", "start", None, "[]")]
    pages = spark.createDataFrame(rows, "source string, page string, next string, results string")
    for _ in range(2):  # a second writing gives the same files
        paged.write_pages(pages, str(tmp_path / "p"))
    assert sorted((r.data_source_id, r.id) for r in paged.read_paged(spark, str(tmp_path / "p")).collect()) == [("s", "p1"), ("s", "p2")]


def test_repeated_requests_are_one(spark):
    cat = spark.createDataFrame([("7", "T", "M", "a"), ("7", "U", "M", "b"), ("7", "U", "N", "b")], "class_level string, topic string, competence string, source_id string")
    kids = spark.createDataFrame([], "database_id string, source_ord int, child_id string")
    asked = spark.createDataFrame([("7", "U"), ("7", "U"), ("7", "T"), (None, "T")], "class_level string, topic string")
    tasks, errors = pool.load_requested(spark.createDataFrame([], f"data_source_id string, {pool.RECORD}"), cat, kids, cat.select("source_id"), asked, ["M", "N"])
    assert tasks.count() == 0
    assert sorted((r.class_level or "", r.competence, r.error) for r in errors.collect()) == [("", "M", "class and topic are required"), ("", "N", "class and topic are required"), ("7", "N", "no source for N")]


def test_commit_that_cannot_be_written(spark, tmp_path):
    d = spark.createDataFrame([("a", "q", "7", "T", "M", True)], "title string, question_text string, class_level string, topic string, competence string, include boolean")
    known = spark.createDataFrame([("7", "T", "M")], "class_level string, topic string, competence string")
    (tmp_path / "p").write_text("a file, no folder")
    row = sink.commit(d, known, str(tmp_path / "p"), str(tmp_path / "w")).first()
    assert not row.ok and row.error.startswith("not written: ")


def test_import_without_tasks_and_bad_files(spark):
    files = spark.createDataFrame([("leer.txt", "txt", "", b"nichts"), ("x.odd", "odd", "", b"?"), ("kaputt.docx", "docx", "", b"no"), ("p.pdf", "pdf", "", b"%"), ("gut.txt", "txt", "", "1. Rechne 3 + 4\n2. Zeichne".encode())], "name string, extension string, mime_type string, content binary")
    pages = spark.createDataFrame([("p.pdf", 2, "Aufgabe 1: x"), ("p.pdf", 1, "vorab")], "name string, page_number int, text string")
    nothing = spark.createDataFrame([], "task_id string, title string, question_text string, class_level string, topic string, scan_ord int")
    done = imports.import_documents(files, nothing, "8", "Statistik", pages=pages)
    assert {tuple(r) for r in done.errors.collect()} == {("leer.txt", "no tasks"), ("x.odd", "unsupported type: odd"), ("kaputt.docx", "no tasks")}
    drafts = {(r.source_file, r.segment): r for r in done.drafts.collect()}
    assert set(drafts) == {("gut.txt", 1), ("gut.txt", 2), ("p.pdf", 1)}
    assert {r.class_level for r in drafts.values()} == {"8"} and {r.topic for r in drafts.values()} == {"Statistik"} and drafts["p.pdf", 1].source_pages == [2]
    assert [tuple(r) for r in done.warnings.collect()] == [("p.pdf", "sparse", None, "")]
    again = imports.refined(done.drafts.withColumn("said", F.lit('{"topic": "Flächen"}')), "said", nothing)
    assert {(r.topic, r.analysis_mode, r.duplicate) for r in again.collect()} == {("Flächen", "llm", None)}


def test_docx():
    w, m = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/math"
    xml = f'<w:document xmlns:w="{w}" xmlns:m="{m}"><w:body><w:p><w:r><w:t>x = </w:t></w:r><m:f><m:num><m:r><m:t>1</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f></w:p><w:p/><w:p><m:rad><m:e><m:t>3</m:t></m:e></m:rad></w:p></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    assert documents.docx_text(data.getvalue()) == "x = \\frac{1}{2}\n\\sqrt{3}" and documents.docx_text(b"no") == ""


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hallo")
    (tmp_path / "b.xyz").write_text("?")
    files = documents.read_files(spark, str(tmp_path))
    rows = {r.name: (r.text, r.error) for r in documents.extract(files).collect()}
    assert rows == {"a.txt": ("hallo", None), "b.xyz": ("", "unsupported type: xyz")}
    assert documents.upload_problem(files).first().problem is None


def test_pool_pruned_scan_covers_all_nations(spark):
    from taskloom.plans import catalogue

    sf_dir = "/root/testdata/sf0.001"
    rows = catalogue.QUERIES["pool_pruned_scan"](spark, sf_dir)
    own = spark.read.parquet(f"{sf_dir}/customer.parquet")
    assert rows.agg(F.sum("n_tasks")).first()[0] == own.count()
    assert rows.select("topic").distinct().count() == own.select("c_nationkey").distinct().count()
    assert "PartitionFilters: [" in rows._jdf.queryExecution().toString()


def test_a_commit_deals_drafts_of_one_partition_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "MOST_ROWS", 100)
    rows = spark.range(0, 1000, 1, 1).select("id", F.lit("t").alias("title"), F.lit("q").alias("question_text"), F.lit("7").alias("class_level"), F.lit("A").alias("topic"), F.lit("M").alias("competence"), F.lit(True).alias("include"))
    known = spark.createDataFrame([("7", "A", "M")], "class_level string, topic string, competence string")
    assert "SortMergeJoin" not in sink.outcomes(rows, known)._jdf.queryExecution().executedPlan().toString()
    assert sink.commit(rows, known, f"{tmp_path}/pool", f"{tmp_path}/work").where("ok").count() == 1000
    back = spark.read.parquet(f"{tmp_path}/pool")
    assert back.count() == 1000 and back.select("id").distinct().count() == 1000
    assert len(back.inputFiles()) > 5
