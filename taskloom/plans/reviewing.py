"""Queries over documents, tasks found in them, corrections, and answers of models."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify, documents, guard, latex
from ..functions.textual import lines
from ..operators import imports, ledger, segment, sheets
from ..schema import TOPICS_BY_CLASS
from ..sources import documents as files
from .registry import query, scratch, table, texts

# ---- pages and broken fractions ---------------------------------------------------------------------------


def _sheets(spark, sf_dir) -> DataFrame:
    """Three pages for each part: broken fractions, an empty page, and a short one."""
    n = F.col("p_size").cast("string")
    broken = F.concat(F.lit("1. Berechne ⋅\na) "), n, F.lit("\n3 x = - 5 2\n1\nb) 4\nabc\ny = 7 "), n, F.lit("\n"), n, F.lit("\nEnde"))
    pages = F.array(*[F.struct(F.lit(i).alias("page_number"), t.alias("text")) for i, t in ((2, F.lit("  ")), (1, broken), (3, F.concat(F.lit("Seite –"), F.col("p_name"))))])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.inline(pages))


_BROKEN = r"'1. Berechne  \cdot ' || chr(10) || 'a) \frac{3}{' || p_size || '} x = - 5 \frac{1}{2}' || chr(10) || 'b) 4' || chr(10) || 'abc' || chr(10) || 'y = 7 \frac{' || p_size || '}{' || p_size || '}' || chr(10) || 'Ende'"


@query(
    f"SELECT p_partkey AS doc, {_BROKEN} || chr(10) || chr(10) || 'Seite -' || p_name AS text, '[[PAGE:1]]' || chr(10) || {_BROKEN} || chr(10) || '[[PAGE:2]]' || chr(10) || chr(10) || '[[PAGE:3]]' || chr(10) || 'Seite -' || p_name AS simplified, 3 AS n_pages FROM part"
)
def page_documents(spark, sf_dir):
    """Texts of a PDF's pages with their fractions put together, joined with and without page marks."""
    return files.pages_document(_sheets(spark, sf_dir)).select("doc", "text", "simplified", F.size("pages").alias("n_pages"))


@query(
    """WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM conversations), d AS (SELECT conv_id, sum(length(t)) AS n, count(*) AS k FROM t GROUP BY 1)
SELECT conv_id, turn, length(t) + 3 >= 120 AS trusted, n + k * 3 >= 120 AND k > 1 AS document_trusted FROM t JOIN d USING (conv_id)"""
)
def page_trust(spark, sf_dir):
    """Turns as pages: long enough with a task number; conversations as documents."""
    from ..functions.textual import text, trim

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("1. "), trim(text("text"))).alias("t"))
    own = Window.partitionBy("conv_id")
    whole = F.repeat(F.lit("x"), F.sum(F.length("t")).over(own).cast("int"))
    n = F.count("*").over(own)
    return rows.select("conv_id", "turn", guard.trusted_page(F.col("t")).alias("trusted"), guard.trusted_document(whole, n - 1, n).alias("document_trusted"))


# ---- tasks in documents -----------------------------------------------------------------------------------


def _papers(spark, sf_dir) -> DataFrame:
    """A marked text for each part: two tasks over two pages, with headers, images and points."""
    n = F.col("p_size").cast("string")
    body = F.concat(
        F.lit("Vorspann\n[[PAGE:1]]\n① (2 P.) Berechne "), n, F.lit(" + 1. Dann weiter (3 BE)\n\n\n\nName: "), F.col("p_name"), F.lit("\n[[IMG:0]]\n[[IMG:1]]\na) Zeichne den Graph\n[[PAGE:2]]\nAufgabe 2: Boxplot\nBestimme im magischen Quadrat.\n(Je 1,5 P.)\na) x\nb) y\n[[PAGE:3]]\nMathematik 7 Seite 3/4\n[[PAGE:4]]")
    )
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), body.alias("text"), F.lit("Klasse 8").alias("name"))
    pictures = F.array(*[F.struct(F.lit(u).alias("data_url"), F.lit(m).alias("name"), F.lit(d).alias("decorative")) for u, m, d in (("data:a", "logo", True), ("data:b", "bild", False))])
    return rows.withColumn("pictures", pictures)


@query(
    """
WITH c AS (
  SELECT p_partkey AS doc, 1 AS segment, 'Berechne ' || p_size || ' + 1. Dann weiter' AS heading, p_size || ' + 1' AS title, '1' AS task_no, '[1]' AS pages, 'bild' AS image_name, '2' AS points_raw,
    'Berechne ' || p_size || ' + 1. Dann weiter' || chr(10) || chr(10) || 'a) Zeichne den Graph' AS question_text, 'Funktionen' AS topic, 'Darstellungen' AS competence, true AS visual FROM part
  UNION ALL SELECT p_partkey, 2, ': Boxplot', 'Magisches Quadrat', '2', '[2, 3]', NULL, '1.5+1.5', 'Bestimme im magischen Quadrat.' || chr(10) || 'a) x' || chr(10) || 'b) y', 'Statistik', 'Mathematik', false FROM part)
SELECT doc, segment, title, pages, image_name, replace(points_raw, '1.5', '1,5') AS points_raw, question_text, topic, competence, '8' AS class_level FROM c
"""
)
def paper_drafts(spark, sf_dir):
    """Tasks of a marked text with their pages, titles, points and images."""
    chunks = segment.task_chunks(_papers(spark, sf_dir), "doc", "text", "name", "pictures")
    rows = segment.drafts(chunks, F.col("name"), images=F.col("pictures"))
    return rows.select("doc", "segment", "title", F.col("source_pages").cast("string").alias("pages"), "image_name", "points_raw", "question_text", "topic", "competence", "class_level")


@query("SELECT p_partkey, CAST(p_size % 30 AS VARCHAR) AS task_no, 'Rechne ' || p_name AS heading, 'Ein Text' AS stripped, '0,' || p_size AS images, 3 AS n_lines, p_name AS cleaned FROM part")
def task_text_parts(spark, sf_dir):
    """Task numbers, headings without marks, image marks, lines, and texts without headers and footers."""
    k = (F.col("p_size") % 30).cast("string")
    head = F.concat(F.lit("Aufgabe "), k, F.lit(": (je 2 P.) Rechne  "), F.col("p_name"), F.lit(" (3+4 BE)"))
    marked = F.concat(F.lit("Ein Text\n[[IMG:0]]\n[[IMG:"), F.col("p_size").cast("string"), F.lit("]]"))
    page = F.concat(F.lit("Mathematik Test Seite 1/2\nName: x\n"), F.col("p_name"), F.lit("\n\n\n\nhttps://www.tutory.de/w/1"))
    rows = table(spark, sf_dir, "part")
    return rows.select(
        "p_partkey", documents.task_number(head).alias("task_no"), documents.clean_heading(head).alias("heading"), documents.without_images(marked).alias("stripped"),
        F.array_join(documents.image_indices(marked).cast("array<string>"), ",").alias("images"), F.size(lines(F.lit("a\r\nb\n"))).alias("n_lines"), documents.clean_chunk(page).alias("cleaned"),
    )


_BY_CLASS = {"7": "CASE WHEN contains(t, 'term') OR contains(t, 'klammer') THEN 'Terme' WHEN contains(t, 'prozent') THEN 'Prozentrechnung' ELSE 'Terme' END", "10": "CASE WHEN contains(t, 'urne') OR contains(t, 'zufall') THEN 'Wahrscheinlichkeitsrechnung' ELSE 'Quadratische Funktionen' END"}


@query(f"WITH x AS (SELECT doc_id, lower(coalesce(text, '')) || CASE doc_id % 4 WHEN 0 THEN 'prozent' WHEN 1 THEN 'zufall' WHEN 2 THEN 'klammer' ELSE '' END AS t FROM documents) SELECT doc_id, {_BY_CLASS['7']} AS topic_7, {_BY_CLASS['10']} AS topic_10, '' AS topic_12, 'Zuordnung' AS given FROM x")
def topic_by_class(spark, sf_dir):
    """The best topic of a class, the first one without a hit, none for a class without topics, and a given one."""
    t = F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, ["prozent", "Zufall", "KLAMMER", ""])), (F.col("doc_id") % 4 + 1).cast("int")))
    guess = lambda level, given=None: classify.guess_topic(t, F.lit(level), given)
    return table(spark, sf_dir, "documents").select("doc_id", guess("7").alias("topic_7"), guess("10").alias("topic_10"), guess("12").alias("topic_12"), guess("7", F.lit("Zuordnung")).alias("given"))


# ---- files ------------------------------------------------------------------------------------------------


@F.pandas_udf(T.BinaryType())
def _docx_file(body: pd.Series) -> pd.Series:
    """A DOCX file with a body of the given XML and one picture."""
    import io
    import zipfile

    spaces = " ".join(f'xmlns:{p}="{u.strip("{}")}"' for p, u in (("w", files._W), ("m", files._M), ("a", files._A), ("r", files._R)))

    def packed(xml: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f"<w:document {spaces}><w:body>{xml}</w:body></w:document>")
            z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="media/a.jpeg"/></Relationships>')
            z.writestr("word/media/a.jpeg", b"bild")
        return out.getvalue()

    return body.map(packed)


def _uploads(spark, sf_dir) -> DataFrame:
    """A DOCX file a part: two tasks, a formula, a picture used once, a table of expectations."""
    p = lambda *x: F.concat(F.lit("<w:p><w:r><w:t>"), *x, F.lit("</w:t></w:r></w:p>"))
    n = F.col("p_size").cast("string")
    formula = F.concat(F.lit("<w:p><w:r><w:t>a) x = </w:t></w:r><m:oMath><m:f><m:num><m:r><m:t>1</m:t></m:r></m:num><m:den><m:r><m:t>"), n, F.lit("</m:t></m:r></m:den></m:f></m:oMath></w:p>"))
    picture = F.lit('<w:p><w:r><w:drawing><a:blip r:embed="r1"/></w:drawing></w:r></w:p>')
    cell = lambda x: F.concat(F.lit("<w:tc>"), p(x), F.lit("</w:tc>"))
    row = lambda *x: F.concat(F.lit("<w:tr>"), *map(cell, x), F.lit("</w:tr>"))
    expected = F.concat(F.lit("<w:tbl>"), row(F.lit("Titel"), F.lit("Erwartung"), F.lit("Punkte")), row(F.lit("Terme ordnen"), F.concat(F.lit("Lösung "), n), F.lit("3")), F.lit("</w:tbl>"))
    body = F.concat(p(F.lit("Klasse 7")), p(F.lit("Aufgabe 1: Terme ordnen")), p(F.lit("Ordne den Term &amp; die Klammer.")), formula, picture, p(F.lit("2. Zeichne "), F.col("p_name"), F.lit(".")), expected)
    rows = texts(spark, sf_dir, "part").select(F.concat(F.lit("blatt-"), F.col("p_partkey").cast("string"), F.lit(".docx")).alias("name"), _docx_file(body).alias("content"))
    return rows.select("name", F.lit("docx").alias("extension"), F.lit("").alias("mime_type"), "content")


@query(
    r"""SELECT 'blatt-' || p_partkey || '.docx' AS name, 'docx' AS method,
  'Klasse 7' || chr(10) || 'Aufgabe 1: Terme ordnen' || chr(10) || 'Ordne den Term & die Klammer.' || chr(10) || 'a) x = \frac{1}{' || p_size || '}' || chr(10) || '2. Zeichne ' || p_name || '.' || chr(10) || 'Titel' || chr(10) || 'Erwartung' || chr(10) || 'Punkte' || chr(10) || 'Terme ordnen' || chr(10) || 'Lösung ' || p_size || chr(10) || '3' AS text,
  'blatt-' || p_partkey || '-bild-1.jpg' AS image, 'data:image/jpeg;base64,YmlsZA==' AS data_url, false AS decorative, 'Lösung ' || p_size AS expectation, 1 AS n_images, NULL AS error FROM part"""
)
def docx_sources(spark, sf_dir):
    """DOCX files with text, formulas, pictures and expectations."""
    rows = files.extract(_uploads(spark, sf_dir))
    return rows.select(
        "name", "method", "text", F.col("images")[0]["name"].alias("image"), F.col("images")[0]["data_url"].alias("data_url"), F.col("images")[0]["decorative"].alias("decorative"),
        F.col("expectation_rows")[0]["expectation"].alias("expectation"), F.size("images").alias("n_images"), "error",
    )


@query(
    """SELECT name, kind, problem FROM (SELECT p_name || '.' || e AS name, e, p_partkey FROM part, (VALUES ('docx'), ('PDF'), ('bin'), ('odd')) v(e)) x,
  LATERAL (SELECT CASE e WHEN 'docx' THEN 'docx' WHEN 'PDF' THEN 'pdf' WHEN 'bin' THEN 'docx' END AS kind, CASE WHEN e = 'odd' THEN 'docx' WHEN e = 'PDF' THEN 'pdf-text' ELSE 'docx' END AS problem) y"""
)
def file_kinds(spark, sf_dir):
    """Files told apart by extension or type, and how their text is extracted."""
    ends = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(m).alias("m")) for e, m in (("docx", ""), ("PDF", files.MIME["pdf"]), ("bin", files.MIME["docx"]), ("odd", None))])
    rows = table(spark, sf_dir, "part").select("p_name", F.inline(ends))
    return rows.select(F.concat_ws(".", "p_name", "e").alias("name"), files.file_kind(F.lower("e"), F.col("m")).alias("kind"), files.method_tag(F.col("m")).alias("problem"))


def _pool(spark, sf_dir) -> DataFrame:
    """A pool of a task for each nation, and one that equals the first task of the files for part size 1."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("task_id"), F.col("n_name").alias("title"), F.lit("ganz anderer Text über Flüsse").alias("question_text"), F.col("n_nationkey").alias("scan_ord"))
    same = rows.where("n_nationkey = 0").select(F.lit("same").alias("task_id"), F.lit("Terme ordnen").alias("title"), F.lit("Ordne den Term & die Klammer.\na) x =").alias("question_text"), F.lit(-1).alias("scan_ord"))
    return rows.unionByName(same).select("task_id", "title", "question_text", F.lit("7").alias("class_level"), F.lit("Terme").alias("topic"), "scan_ord")


@query(
    """
SELECT 'blatt-' || p_partkey || '.docx' AS source_file, 1 AS segment, 'Terme ordnen' AS title, 'Terme' AS topic, (SELECT 'Lösung ' || p_size FROM part ORDER BY 'blatt-' || p_partkey || '.docx' LIMIT 1) AS expectation, 0.95::DOUBLE AS confidence, 'blatt-' || p_partkey || '-bild-1.jpg' AS image_name, 'same' AS duplicate, false AS include FROM part
UNION ALL SELECT 'blatt-' || p_partkey || '.docx', 2, p_name, 'Terme', '', 0.0, NULL, NULL, true FROM part
"""
)
def import_drafts(spark, sf_dir):
    """Files as drafts: tasks, pictures, expectations (the first fitting row of all files), duplicates; a part a file."""
    done = imports.import_documents(_uploads(spark, sf_dir), _pool(spark, sf_dir))
    return done.drafts.select("source_file", "segment", "title", "topic", "expectation", F.col("confidence.expectation").alias("confidence"), "image_name", F.col("duplicate.id").alias("duplicate"), "include")


@query("SELECT 'blatt-' || p_partkey || '.docx' AS name, 1 AS images, 'docx' AS method FROM part")
def import_summary(spark, sf_dir):
    return imports.import_documents(_uploads(spark, sf_dir), _pool(spark, sf_dir)).summary.select("name", "images", "method")


@query(
    """
WITH u AS (SELECT *, 'blatt-' || p_partkey || '.docx' AS name, CASE WHEN p_partkey % 97 = 0 THEN 97 ELSE p_partkey // 7 + 1000 END AS upload FROM part),
g AS (SELECT upload, count(*) AS n, arg_min('Lösung ' || p_size, name) AS expectation FROM u GROUP BY 1),
k AS (SELECT u.*, g.expectation FROM u JOIN g USING (upload) WHERE g.n <= 10)
SELECT upload, name AS source_file, 1 AS segment, 'Terme ordnen' AS title, expectation, 0.95::DOUBLE AS confidence, NULL AS error FROM k
UNION ALL SELECT upload, name, 2, p_name, '', 0.0, NULL FROM k
UNION ALL SELECT upload, NULL, NULL, NULL, NULL, NULL, 'too many files' FROM g WHERE n > 10
"""
)
def import_uploads(spark, sf_dir):
    """Files of many requests in one table: each request has its own limits and expectations."""
    k = F.col("p_partkey")
    upload = F.when(k % 97 == 0, 97).otherwise(F.floor(k / 7) + 1000).cast("long")
    keys = table(spark, sf_dir, "part").select(F.concat(F.lit("blatt-"), k.cast("string"), F.lit(".docx")).alias("name"), upload.alias("upload"))
    done = imports.import_documents(_uploads(spark, sf_dir).join(keys.hint("merge"), "name"), _pool(spark, sf_dir), upload="upload")
    drafts = done.drafts.select("upload", "source_file", "segment", "title", "expectation", F.col("confidence.expectation").alias("confidence"), F.lit(None).cast("string").alias("error"))
    none = {"source_file": "string", "segment": "int", "title": "string", "expectation": "string", "confidence": "double"}
    return drafts.unionByName(done.errors.select("upload", *(F.lit(None).cast(t).alias(c) for c, t in none.items()), "error"))


# ---- corrections ------------------------------------------------------------------------------------------


def _corrections(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A PDF a customer with four pages: repaired, rejected, not proposed, and without an anchor."""
    c = table(spark, sf_dir, "customer")
    words = F.lit(" Der Weg zum Bahnhof führt Anna über viele kleine Brücken, und am Abend kehrt sie langsam wieder heim in ihre alte Stadt am Fluss")
    page = lambda i: F.concat(F.lit(f"{i}. "), F.translate("c_mktsegment", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), words)
    pages = [page(1), page(2), page(3), F.lit("kurz")]
    text = F.array_join(F.array(*pages), "\n\n")
    marked = F.concat(*[x for i, t in enumerate(pages, 1) for x in (F.lit(f"[[PAGE:{i}]]\n"), t, F.lit("\n"))])
    structs = F.array(*[F.struct(F.lit(i).alias("page_number"), t.alias("text")) for i, t in enumerate(pages, 1)])
    none = F.array().cast("array<struct<data_url:string,name:string,decorative:boolean>>")
    sources = c.select(F.col("c_name").alias("name"), F.lit(files.MIME["pdf"]).alias("mime_type"), text.alias("text"), marked.alias("simplified"), none.alias("images"), F.array().cast("array<struct<title:string,expectation:string,points_raw:string>>").alias("expectation_rows"), structs.alias("pages"), F.lit("pdf-text").alias("method"))
    fixed = F.array(*[F.struct(F.lit(i).alias("page_number"), t.alias("text")) for i, t in ((1, F.concat(page(1), F.lit(" \\cdot"))), (2, F.concat(page(2), F.lit(" 7"))), (4, F.lit("kurz")))])
    return sources, c.select(F.col("c_name").alias("name"), F.inline(fixed))


@query(
    """SELECT c_name AS doc, page, outcome, reason FROM customer, (VALUES (1, 'repaired', ''), (2, 'rejected', 'Zahleninhalt wurde verändert; Korrektur aus Sicherheitsgründen verworfen'), (3, 'skipped', ''), (4, 'skipped', '')) v(page, outcome, reason)"""
)
def page_corrections(spark, sf_dir):
    """Corrections proposed for pages, taken or not."""
    return imports.corrected_sources(*_corrections(spark, sf_dir))[1]


@query("SELECT c_name AS source_file, segment, mark AS math_repair, CAST([segment] AS VARCHAR) AS pages FROM customer, (VALUES (1, 'visual'), (2, 'rejected'), (3, 'none')) v(segment, mark)")
def repair_marks(spark, sf_dir):
    """Drafts of corrected documents with the mark of their pages."""
    sources, outcomes = imports.corrected_sources(*_corrections(spark, sf_dir))
    rows = imports.with_repair_marks(imports.source_drafts(sources), outcomes)
    pages = F.filter("source_pages", lambda p: p < 4)  # the page without an anchor goes with the last task
    return rows.select("source_file", "segment", "math_repair", pages.cast("string").alias("pages"))


@query("SELECT c_name AS doc, '[1]' AS repaired, '[2]' AS rejected, '[3, 4]' AS skipped FROM customer")
def page_lists(spark, sf_dir):
    rows = guard.page_outcomes(imports.corrected_sources(*_corrections(spark, sf_dir))[1].where("page is not null"))
    return rows.select("doc", *[F.col(f"{k}_pages").cast("string").alias(k) for k in ("repaired", "rejected", "skipped")])


_GUARDED = "1. Die Katze läuft schnell\na) durch den Garten 5"
# what replaces what, and the reason
_EDITS = [
    (_GUARDED, "", ""),
    ("", "", "leerer Text"),
    (_GUARDED.replace("1. ", "2. "), "", "Aufgabennummern wurden verändert (1 → 2)"),
    (_GUARDED.replace("a) ", "b) "), "", "Teilaufgaben wurden verändert (a → b)"),
    (_GUARDED.replace("5", "6"), "", "Zahleninhalt wurde verändert; Korrektur aus Sicherheitsgründen verworfen"),
    (_GUARDED.replace("Katze", "Maus").replace("läuft", "rennt"), "", "zu große Textabweichung (43 % Prosa-Übereinstimmung)"),
    (_GUARDED + " " * 3 + "= " * 40, "", "size"),
    ("Aufgabe 1\nAufgabe 5\nAufgabe 7\n", "Aufgabe 1\n5 7 = = = = = = =", "zusätzliche Aufgabenüberschriften erkannt"),
]
_LONG = len((_GUARDED + " " * 3 + "= " * 40).strip())


@query(
    "SELECT o_orderkey, [" + ", ".join("'" + (r if r != "size" else f"Textlänge unplausibel verändert ({int(_LONG / len(_GUARDED) * 100 + 0.5)} %)") + "'" for _, _, r in _EDITS) + "][o_orderkey % 8 + 1] AS reason, o_orderkey % 8 = 0 AS ok FROM orders"
)
def guard_reasons(spark, sf_dir):
    """Every rule that a correction can break, in order."""
    case = F.element_at(F.array(*[F.struct(F.lit(b or _GUARDED).alias("a"), F.lit(a).alias("b")) for a, b, _ in _EDITS]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", case.alias("c"))
    return rows.select("o_orderkey", guard.check_correction(F.col("c.a"), F.col("c.b")).alias("r")).select("o_orderkey", "r.reason", "r.ok")


_GUARD_WORDS = r"list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\\[a-z]+', ' ', 'g'), '[0-9]+(?:[.,][0-9]+)?', ' ', 'g'), '[=+*/:^_<>−–—-]', ' ', 'g'), '[^a-zäöüßA-ZÄÖÜ]+', ' ', 'g'), ' '), lambda w: length(w) >= 3 AND NOT list_contains([{}], w))"


@query(f"SELECT conv_id, turn, md5(array_to_string({_GUARD_WORDS.format(', '.join(repr(w) for w in guard.STOP))}, ' ')) AS words, 'c,a,b' AS labels FROM conversations")
def guard_words(spark, sf_dir):
    """The words and the labels of sub-tasks that a correction has to keep."""
    labels = guard.part_labels(F.concat(F.lit("c) x\n*A) "), F.coalesce(F.regexp_replace("text", r"(?im)^\s*\*?[a-z]\)", ""), F.lit("")), F.lit("\nb) z")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.array_join(guard.prose_words(F.col("text")), " ")).alias("words"), F.array_join(labels, ",").alias("labels"))


# ---- models -----------------------------------------------------------------------------------------------


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'x ' || event_type || ' y' END AS said, CASE event_id % 4 WHEN 0 THEN 3.0 WHEN 1 THEN 12.5 WHEN 2 THEN 1.0 ELSE 8.0 END::DOUBLE AS wait,
  'Klasse 7: ' || event_type || ' / ' || substr(event_type || '0123456789', 1, 10) AS prompt FROM events"""
)
def model_texts(spark, sf_dir):
    """Texts of correction answers, seconds to wait, and prompts with their bodies cut."""
    k, kind = F.col("event_id"), F.col("event_type")
    good = F.to_json(F.struct(F.concat(F.lit("\t x "), kind, F.lit(" y\n")).alias("correctedText")))
    answer = F.element_at(F.array(good, F.lit('{"correctedText": 7}'), F.lit('{"correctedText": " "}'), F.lit("kein JSON"), F.lit("{}"), F.lit(None).cast("string")), (k % 6 + 1).cast("int"))
    after = F.when(k % 4 == 0, "3").otherwise("-1")
    reset = F.element_at(F.array(F.lit("9s"), F.lit("1m12.5s"), F.lit("250ms"), F.lit("")), (k % 4 + 1).cast("int"))
    prompt = guard.prompt("Klasse {level}: {kind} / {body}", 10, F.concat(kind, F.lit("0123456789")), level=F.lit("7"), kind=kind)
    return table(spark, sf_dir, "events").select("event_id", guard.corrected_text(answer).alias("said"), guard.retry_seconds(after, reset).alias("wait"), prompt.alias("prompt"))


def _ask(prompt: str) -> str | None:
    """A stand-in for a model: it fails, is silent, or answers with a JSON object, by the prompt's number."""
    n = int(prompt)
    if n % 4 == 3:
        raise RuntimeError("busy")
    return [f'{{"title": "Titel {n}", "topic": "Gleichungen", "competence": "Modellieren", "afbRaw": " AFB 3 ", "pointsRaw": "2 + 3,5", "estimatedTime": 9, "expectation": "gut", "confidenceTopic": 1.5, "confidenceAfb": 0.25}}', None, "[1]"][n % 4]


@query(
    """SELECT event_id, event_id % 4 = 0 AND event_id IS NOT NULL AS llm, CASE event_id % 4 WHEN 0 THEN 'Titel ' || event_id ELSE 't' END AS title, CASE event_id % 4 WHEN 0 THEN 'Gleichungen' ELSE 'Flächen' END AS topic,
  CASE event_id % 4 WHEN 0 THEN 'Modellieren' ELSE 'Mathematik' END AS competence, CASE event_id % 4 WHEN 0 THEN 'AFB 3' ELSE 'AFB 1' END AS afb_raw, CASE WHEN event_id % 4 <> 0 OR event_id % 8 = 0 THEN '4' ELSE '2+3.5' END AS points_raw,
  CASE WHEN event_id % 4 <> 0 OR event_id % 8 = 0 THEN 4.0 ELSE 5.5 END::DOUBLE AS max_points, CASE WHEN event_id % 8 = 0 THEN 'document' WHEN event_id % 4 = 0 THEN 'llm' ELSE 'heuristic' END AS points_source,
  CASE event_id % 4 WHEN 0 THEN 9.0 ELSE 3.0 END::DOUBLE AS estimated_time, CASE event_id % 4 WHEN 0 THEN 'gut' ELSE '' END AS expectation, CASE event_id % 4 WHEN 0 THEN 1.0 ELSE 0.45 END::DOUBLE AS c_topic, CASE event_id % 4 WHEN 0 THEN 0.0 ELSE 0.4 END::DOUBLE AS c_competence,
  CASE event_id % 4 WHEN 0 THEN 0.25 ELSE 0.35 END::DOUBLE AS c_afb, CASE event_id % 4 WHEN 3 THEN 'busy' END AS failure FROM events"""
)
def model_answers(spark, sf_dir):
    """Drafts with the answers of an injected callable, all fields; without a usable answer a draft stays as it is."""
    k = F.col("event_id")
    own = {"title": "t", "class_level": "7", "topic": "Flächen", "competence": "Mathematik", "afb_raw": "AFB 1", "points_raw": "4", "max_points": 4.0, "estimated_time": 3.0, "expectation": "", "analysis_mode": "heuristic"}
    confidence = F.struct(*[F.lit(v).alias(n) for n, v in segment.CONFIDENCES.items()])
    drafts = table(spark, sf_dir, "events").select("event_id", *[F.lit(v).alias(n) for n, v in own.items()], F.when(k % 8 == 0, "document").otherwise("heuristic").alias("points_source"), confidence.alias("confidence"), k.cast("string").alias("prompt"))
    rows = guard.refine(guard.answers(drafts, "prompt", _ask), "answer", TOPICS_BY_CLASS)
    return rows.select(
        "event_id", (F.col("analysis_mode") == "llm").alias("llm"), "title", "topic", "competence", "afb_raw", "points_raw", "max_points", "points_source", "estimated_time", "expectation",
        F.col("confidence.topic").alias("c_topic"), F.col("confidence.competence").alias("c_competence"), F.col("confidence.afb").alias("c_afb"), F.col("answer_error").alias("failure"),
    )


def _strictly(prompt: str, strict: bool) -> str:
    """A service by the prompt's last digit: some answers do not fit the strict form, some requests fail."""
    last = prompt[prompt.index(":") + 1] if ":" in prompt else prompt[-1]
    if strict and last in "37":
        raise ledger.Unparsed("not strict")
    if last == "9":
        raise RuntimeError(f"no answer to {prompt}")
    return json.dumps({"title": f"{prompt}!", "strict": strict})


@query(
    """WITH p AS (SELECT conv_id, turn, CAST(length(coalesce(text, '')) AS VARCHAR) AS p FROM conversations), k AS (SELECT *, right(p, 1) AS d FROM p)
SELECT conv_id, turn, CASE WHEN d = '9' THEN NULL WHEN d IN ('3', '7') THEN p || ':' || d || '!' ELSE p || '!' END AS title, CASE WHEN d = '9' THEN NULL ELSE d NOT IN ('3', '7') END AS strict, CASE WHEN d = '9' THEN 'no answer to ' || p END AS failure FROM k"""
)
def answers_once(spark, sf_dir):
    """Answers from a ledger to prompts that many rows share; the second reading asks only what failed."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("string").alias("prompt"))
    path = scratch(spark)

    def ask(prompt: str, strict: bool) -> str:
        return _strictly(prompt, strict)

    def asked() -> DataFrame:
        return ledger.called(rows, "prompt", lambda p: _retried(ask, p), path)

    asked()
    said = F.from_json("answer", "title string, strict boolean")
    return asked().select("conv_id", "turn", said["title"].alias("title"), said["strict"].alias("strict"), F.col("answer_error").alias("failure"))


def _retried(ask, prompt: str) -> str:
    try:
        return ask(prompt, True)
    except ledger.Unparsed:
        return ask(f"{prompt}:{prompt[-1]}", False)


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) < 400")
def sparse_documents(spark, sf_dir):
    """Documents as sources of three kinds; of those that are PDF the ones with hardly any text."""
    kinds = F.array(*[F.lit(files.MIME[k]) for k in ("pdf", "docx", "txt")])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.element_at(kinds, (F.col("doc_id") % 3 + 1).cast("int")).alias("mime_type"), F.coalesce("text", F.lit("")).alias("text"))
    return files.sparse(rows).select("doc_id")


# ---- formulas ---------------------------------------------------------------------------------------------


@query(
    r"""SELECT p_partkey, i, kind, value, display FROM part, LATERAL (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS i, unnest(['text', 'math', 'text', 'math', 'text', 'math', 'text', 'math']) AS kind,
  unnest([p_name || ' ', 'x_' || p_size, ' und ', '\frac{1}{' || p_size || '}', ' oder ', 'y' || chr(10) || 'z', ', ', p_size || 'a^2']) AS value, unnest([false, false, false, false, false, true, false, false]) AS display) x"""
)
def latex_pieces(spark, sf_dir):
    """A text's formulas and what stands between them."""
    n = F.col("p_size").cast("string")
    t = F.concat("p_name", F.lit(" $x_"), n, F.lit("$ und \\frac{1}{"), n, F.lit("} oder $$y\nz$$, "), n, F.lit("a^2"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(latex.pieces(t)).alias("i", "p")).select("p_partkey", "i", "p.*")


@query(r"""SELECT p_partkey, p_size || ' · 2 ≤q ≤ft( x ) ⇒ ' || p_name AS symbols, '[{"run":"' || p_size || '"},{"frac":[[{"run":"1"}],[{"sup":["x",[{"run":"2"}]]}]]},{"run":" "},{"root":[{"run":"a"},{"sub":["b",[{"run":"1"}]]}]},{"run":"sin"},{"run":" y"}]' AS tree FROM part""")
def latex_formulas(spark, sf_dir):
    """Commands as signs, and formulas as trees."""
    n = F.col("p_size").cast("string")
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", latex.symbols(F.concat(n, F.lit(r" \cdot 2 \leq \left( x \right) \Rightarrow "), "p_name")).alias("symbols"), latex.tree(F.concat(n, F.lit(r"\frac{1}{x^2} \sqrt{ab_{1}}\sin y"))).alias("tree"))


@query(
    r"""
WITH l AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS n, p_name FROM part)
SELECT k AS p_partkey, piece, kind, value, shown FROM l, LATERAL (SELECT * FROM (VALUES
  (0, 0, 'text', p_name || ' ', NULL), (0, 1, 'math', 'x^2', 'sup::,run:base:x,run:script:2'), (0, 2, 'text', ' und ', NULL), (0, 3, 'math', '\frac{1}{' || n || '}', 'frac::,run:above:1,run:below:' || n),
  (1, 0, 'text', 'ohne ' || n, NULL),
  (2, 0, 'text', 'aus ', NULL), (2, 1, 'math', '\sqrt{' || n || '}', 'root::,run:under:' || n), (2, 2, 'text', ' wird ', NULL), (2, 3, 'math', n || 'a^{2}', CASE WHEN length(n) > 0 THEN 'run::' || n || ',sup::,run:base:a,run:script:2' END)) v(c, piece, kind, value, shown)) x
WHERE x.c = k % 3
"""
)
def sheet_formulas(spark, sf_dir):
    """Lines of a sheet with formulas in marks, without any, and told by their form; formulas as nodes."""
    n = F.col("p_size").cast("string")
    lines_ = F.array(F.concat("p_name", F.lit(r" $x^2$ und \(\frac{1}{"), n, F.lit(r"}\)")), F.concat(F.lit("ohne "), n), F.concat(F.lit(r"aus \sqrt{"), n, F.lit("} wird "), n, F.lit("a^{2}")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.element_at(lines_, (F.col("p_partkey") % 3 + 1).cast("int")).alias("text"))
    node = lambda x: F.concat_ws(":", x["kind"], x["part"], F.coalesce(x["value"], F.lit("")))
    return sheets.with_formulas(rows).select("p_partkey", "piece", "kind", "value", F.array_join(F.transform("nodes", node), ",").alias("shown"))
