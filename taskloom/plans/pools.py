"""Queries over pools, sinks and sheets. Customers are records, their nations topics, their segments competences."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import documents, points
from ..functions.textual import js_number
from ..operators import imports, sheets, sink
from ..schema import TOPICS_BY_CLASS
from ..sources import paged, pool
from .catalogue import exam_rows
from .registry import query, scratch, table

# ---- sources ----------------------------------------------------------------------------------------------


def _nations(spark, sf_dir) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"])


def _source(prefix: str, *ends) -> F.Column:
    return F.concat_ws("-", F.lit(prefix), F.col("n_nationkey").cast("string"), F.col("c_mktsegment"), *ends)


def _ids(spark, sf_dir) -> DataFrame:
    """The catalogue: a database for each nation and segment."""
    kinds = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    both = _nations(spark, sf_dir).join(kinds)  # a row a nation and segment
    return both.select(F.col("r_name").alias("class_level"), F.col("n_name").alias("topic"), F.col("c_mktsegment").alias("competence"), _source("db").alias("source_id"), "n_nationkey", "c_mktsegment")


def _sources(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalogue, children (two each, but none for every fifth nation), and known data sources."""
    ids = _ids(spark, sf_dir)
    kids = ids.where("n_nationkey % 5 <> 0").select(F.col("source_id").alias("database_id"), F.posexplode(F.array(_source("src", F.lit("0")), _source("src", F.lit("1")))).alias("source_ord", "child_id"))
    known = ids.where("n_nationkey % 5 = 0").select("source_id", F.lit("Quelle").alias("title"))
    known = known.unionByName(kids.select(F.col("child_id").alias("source_id"), F.lit("").alias("title")))
    return ids.drop("n_nationkey", "c_mktsegment"), kids, known


def _records(spark, sf_dir) -> DataFrame:
    """A page a customer with properties of all kinds, and a list a nation, which is no page."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    run = lambda x: F.struct(x.alias("plain_text"))
    typed = {
        "Titel": F.struct(F.array(run(F.substring("c_name", 1, 9))).alias("title")),
        "aufgabe": F.struct(F.array(run(F.lit("a) x\n")), run(F.lit("*b) y"))).alias("rich_text")),
        "AFB": F.struct(F.struct(F.lit("AFB 2").alias("name")).alias("select")),
        "Punkte": F.struct(F.col("n_nationkey").cast("double").alias("number")),
        "Kompetenz": F.struct(F.array(F.struct(F.lit("Argumentieren und mehr").alias("name"))).alias("multi_select")),
        "Dauer": F.struct(F.struct(F.lit("12 min").alias("name")).alias("status")),
        "Bild": F.struct(F.concat(F.lit(" http://x/"), F.col("c_custkey").cast("string")).alias("url")),
        "Erwartung": F.struct(F.struct(F.array(F.struct(F.struct(F.col("c_mktsegment").alias("name")).alias("select")), F.struct(F.struct(F.lit("b").alias("name")).alias("select"))).alias("array")).alias("rollup")),
    }
    props = F.from_json(F.to_json(F.struct(*[v.alias(k) for k, v in typed.items()])), f"map<string,{pool.PROPERTY}>")
    source = F.when(F.col("n_nationkey") % 5 == 0, _source("db")).otherwise(_source("src", (F.col("c_custkey") % 2).cast("string")))
    pages = c.select(source.alias("data_source_id"), F.lit("page").alias("object"), F.col("c_custkey").cast("string").alias("id"), props.alias("properties"))
    lists = table(spark, sf_dir, "nation").select(F.lit("db-0-BUILDING").alias("data_source_id"), F.lit("list").alias("object"), F.lit("no").alias("id"), F.lit(None).cast(f"map<string,{pool.PROPERTY}>").alias("properties"))
    return pages.unionByName(lists)


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS id, substr(c_name, 1, 9) AS title, c_mktsegment AS competence, n_name AS topic, r_name AS class_level, CAST(n_nationkey AS DOUBLE) AS max_points, 12.0::DOUBLE AS estimated_time,
  'http://x/' || c_custkey AS image_url, c_mktsegment || ', b' AS expectation, 2 AS n_parts, CAST(n_nationkey AS DOUBLE) AS afb2, '(' || n_nationkey || ' P.)' AS shown
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def pool_union(spark, sf_dir):
    """Records of all sources of all databases as tasks of their class, topic and competence."""
    rows = pool.scan_sources(_records(spark, sf_dir), pool.resolve_sources(*_sources(spark, sf_dir)))
    shown = F.concat(F.lit("("), points.points_heading(F.col("points_raw"), F.col("max_points")), F.lit(" P.)"))
    return rows.select("id", "title", "competence", "topic", "class_level", "max_points", "estimated_time", "image_url", "expectation", F.size("sub_tasks").alias("n_parts"), F.try_element_at("points_by_afb", F.lit("AFB2")).alias("afb2"), shown.alias("shown"))


@query(
    """WITH k AS (SELECT DISTINCT c_mktsegment AS s FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS id, r_name AS class_level, n_name AS topic, c_mktsegment AS competence, NULL AS error FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'
UNION ALL SELECT NULL, r_name, n_name, s, CASE WHEN n_name <> 'ohne' THEN 'no source for MACHINERY' ELSE 'no sources for class ' || r_name || ', topic ' || n_name END
  FROM (SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' UNION ALL SELECT r_name, 'ohne' FROM region), k WHERE n_name = 'ohne' OR s = 'MACHINERY'"""
)
def load_requested(spark, sf_dir):
    """Tasks of a request a nation and of one without sources a region; in one region a segment lacks, so its requests fail."""
    cat, kids, known = _sources(spark, sf_dir)
    named = _nations(spark, sf_dir).select(F.col("r_name").alias("class_level"), F.col("n_name").alias("topic"))
    asked = named.unionByName(named.select("class_level", F.lit("ohne").alias("topic")))
    kinds = sorted(r.c_mktsegment for r in table(spark, sf_dir, "customer").select("c_mktsegment").distinct().collect())  # a fixed dimension
    whole = cat.where(~((F.col("class_level") == "ASIA") & (F.col("competence") == "MACHINERY")))
    tasks, errors = pool.load_requested(_records(spark, sf_dir), whole, kids, known, asked, kinds)
    none = F.lit(None).cast("string")
    return tasks.select("id", "class_level", "topic", "competence", none.alias("error")).unionByName(errors.select(none.alias("id"), "class_level", "topic", "competence", "error"))


@query("SELECT 's' || c_nationkey AS data_source_id, CAST(c_custkey AS VARCHAR) AS id, c_name AS title, 'Zeile ' || chr(10) || c_mktsegment AS question_text, CAST(c_nationkey AS DOUBLE) AS max_points FROM customer")
def paged_records(spark, sf_dir):
    """A source a nation, of pages that name their successors, with a list on each page that is no record."""
    c = table(spark, sf_dir, "customer")
    run = lambda x: F.array(F.struct(x.alias("plain_text")))
    props = F.struct(F.struct(run(F.col("c_name")).alias("title")).alias("Titel"), F.struct(run(F.concat(F.lit("Zeile \n"), F.col("c_mktsegment"))).alias("rich_text")).alias("Aufgabe"), F.struct(F.col("c_nationkey").cast("double").alias("number")).alias("Punkte"))
    record = F.to_json(F.struct(F.lit("page").alias("object"), F.col("c_custkey").cast("string").alias("id"), props.alias("properties")))
    source, page = F.concat(F.lit("s"), F.col("c_nationkey").cast("string")), F.floor(F.col("c_custkey") / 2000)
    pages = c.groupBy(source.alias("source"), page.alias("n")).agg(F.array_join(F.collect_list(record), ", ").alias("own"))  # up to 2000 records
    order = Window.partitionBy("source").orderBy("n")  # a source's pages
    cursor = F.when(F.row_number().over(order) == 1, paged.START).otherwise(F.concat(F.lit("c"), F.col("n").cast("string")))
    after = F.concat(F.lit("c"), F.lead("n").over(order).cast("string"))
    path = scratch(spark)
    paged.write_pages(pages.select("source", cursor.alias("page"), after.alias("next"), F.concat(F.lit('[{"object": "list"}, '), "own", F.lit("]")).alias("results")), path)
    tasks = pool.read_tasks(paged.read_paged(spark, path), keep=["data_source_id"])
    return tasks.select("data_source_id", "id", "title", "question_text", "max_points")


@query(
    """WITH k AS (SELECT DISTINCT c_mktsegment AS s FROM customer)
SELECT r_name AS class_level, n_name AS topic, s AS competence, CASE WHEN n_nationkey % 5 = 0 THEN 'db' || n_nationkey || s ELSE 'src' || n_nationkey || s || '0' END AS data_source_id
FROM nation JOIN region ON n_regionkey = r_regionkey, k"""
)
def write_targets(spark, sf_dir):
    """Where new tasks go: the first source of each database."""
    return pool.write_target(pool.resolve_sources(*_sources(spark, sf_dir)), "class_level", "topic", "competence")


@query("SELECT 'Quelle' AS title, 1::BIGINT AS data_sources")
def pool_probe(spark, sf_dir):
    ids, kids, known = _sources(spark, sf_dir)
    order = ids.withColumn("ord", F.struct(F.col("topic") != "NATION_0", "topic", "competence"))
    return pool.probe(order, kids, known)


@query(
    """SELECT r_name AS class_level, n_name AS topic, 'Mathematik' AS competence, 'id' || n_nationkey AS source_id, row_number() OVER (ORDER BY r_regionkey, n_nationkey) - 1 AS ord,
  CASE WHEN row_number() OVER (ORDER BY r_regionkey, n_nationkey) = 1 THEN true ELSE false END AS is_first
FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def catalogue_rows(spark, sf_dir):
    """A JSON catalogue of all nations (a fixed dimension) with a blank id for every second competence."""
    tree: dict[str, dict] = {}
    for r in _nations(spark, sf_dir).orderBy("r_regionkey", "n_nationkey").collect():
        tree.setdefault(r.r_name, {})[r.n_name] = {"Modellieren": " ", "Mathematik": f"id-{r.n_nationkey}"}
    cat = pool.catalogue(spark, json.dumps(tree))
    asked = _nations(spark, sf_dir).select(F.col("r_name").alias("class_level"), F.col("n_name").alias("topic"))
    rows = pool.sources_of(cat, asked, ["Mathematik"]).where("error is null")
    first = pool.first_source(cat).select(F.col("ord").alias("o"))
    return rows.join(F.broadcast(first), F.col("ord") == F.col("o"), "left").select("class_level", "topic", "competence", "source_id", "ord", F.col("o").isNotNull().alias("is_first"))


@query(
    """WITH c AS (SELECT DISTINCT CASE n_nationkey % 3 WHEN 0 THEN CAST(n_nationkey AS VARCHAR) WHEN 1 THEN 'Ä' || lower(n_name) ELSE n_name END AS class_level FROM nation)
SELECT class_level, row_number() OVER (ORDER BY try_cast(class_level AS INTEGER) NULLS LAST, replace(lower(class_level), 'ä', 'a')) AS rank FROM c"""
)
def class_order(spark, sf_dir):
    """Classes with numbers, letters and umlauts in the order in which they are shown."""
    k = F.col("n_nationkey")
    level = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("Ä"), F.lower("n_name"))).otherwise(F.col("n_name"))
    rows = table(spark, sf_dir, "nation").select(level.alias("class_level")).distinct()
    return rows.select("class_level", F.row_number().over(Window.orderBy(*pool.class_order(F.col("class_level")))).cast("long").alias("rank"))  # a row a class


# ---- sheets -----------------------------------------------------------------------------------------------


def _exam(spark, sf_dir) -> DataFrame:
    rows = exam_rows(spark, sf_dir)
    k = F.col("id")
    return rows.select(
        "o_custkey", "number", "grid_row", "grid_col", "max_points", F.when(k % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"), F.concat(F.lit("Zeile "), k.cast("string"), F.lit("\r\n\nx")).alias("question_text"),
        F.when(k % 2 == 0, " 1+2 ").otherwise("").alias("points_raw"), F.when(k % 4 == 0, "http://x/y").alias("image_url"), (F.col("o_orderstatus") == "F").alias("on_extra_sheet"), F.when(k % 3 == 0, "a\nb").alias("expectation"),
    )


_EXAM = """
WITH s AS (SELECT o_custkey, o_orderkey AS k, CAST(o_orderkey % 7 AS VARCHAR) AS p, CASE WHEN o_orderkey % 5 = 0 THEN 'Aufgabe' ELSE o_orderpriority END AS title, o_orderstatus = 'F' AS extra,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders)
"""


@query(
    _EXAM
    + """
, c AS (SELECT o_custkey, sum(k % 7) + 3.5 AS total FROM s GROUP BY 1)
SELECT o_custkey, 0 AS section, 0 AS part, 0 AS line, 'Hilfsmittel: /' AS text, '' AS points, NULL AS extra FROM c
UNION ALL SELECT o_custkey, 1, CAST(n AS INTEGER), 0, 'Aufgabe ' || n, p, NULL FROM s
UNION ALL SELECT o_custkey, 2, i, 0, t, b, NULL FROM c, (VALUES (0, 'Sprache', '1'), (1, 'Schriftbild', '1'), (2, 'Mathematische Form', '1.5')) f(i, t, b)
UNION ALL SELECT o_custkey, 3, 0, 0, 'Punktzahl', CAST(total::DOUBLE AS VARCHAR), NULL FROM c
UNION ALL SELECT o_custkey, 4, CAST(i AS INTEGER), 0, CAST(i + 1 AS VARCHAR), '', NULL FROM c, range(6) r(i)
UNION ALL SELECT o_custkey, 5, i, 0, t, '', i = 0 FROM c, (VALUES (0, 'Aufgaben mit diesem Symbol müssen auf einem Extrablatt erledigt werden.'), (1, 'Aufgaben mit diesem Symbol sollen auf dem Aufgabenblatt erledigt werden.')) h(i, t)
UNION ALL SELECT o_custkey, 6, CAST(n AS INTEGER), 0, 'Aufgabe ' || n || ': ' || title || ' (' || CASE WHEN k % 2 = 0 THEN '1+2' ELSE p END || ' P.)', '', extra FROM s
UNION ALL SELECT o_custkey, 6, CAST(n AS INTEGER), i, t, '', NULL FROM s, LATERAL (SELECT unnest([1, 2, 3, 4]) AS i, unnest(['Zeile ' || k, '', 'x', CASE WHEN k % 4 = 0 THEN '[[IMG:http://x/y]]' END]) AS t) l WHERE t IS NOT NULL
"""
)
def exam_sheet(spark, sf_dir):
    """Each customer's exam, row by row."""
    return sheets.exam_sheet(_exam(spark, sf_dir), F.lit(3.5), F.lit("  "), "o_custkey")


@query(_EXAM + "SELECT o_custkey, CAST(n AS INTEGER) AS number, title, CASE WHEN k % 3 = 0 THEN 'a' || chr(10) || 'b' ELSE '–' END AS expectation, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS n_lines, CASE WHEN k % 2 = 0 THEN ' 1+2 ' ELSE p END AS points FROM s")
def expectation_sheet(spark, sf_dir):
    return sheets.expectation_sheet(_exam(spark, sf_dir), "o_custkey").select("o_custkey", "number", "title", "expectation", F.size("lines").alias("n_lines"), "points")


@query("SELECT p_partkey, p_type || '- ' || p_name || '-.docx' AS test, p_type || '- ' || p_name || '-_Erwartung.docx' AS expectation, p_type || '- ' || p_name || '-.zip' AS archive FROM part")
def sheet_names(spark, sf_dir):
    title = F.concat("p_type", F.lit("/:\\ "), "p_name", F.lit("<?>"))
    title = F.regexp_replace(title, r"/:\\\\ ", "/: ")
    return table(spark, sf_dir, "part").select("p_partkey", sheets.file_names(title).alias("f")).select("p_partkey", "f.*")


@query(
    """WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS a FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(a[2:], ',') AS removed, array_to_string(list_append(a, -1), ',') AS appended, CASE WHEN len(a) > 1 THEN array_to_string(list_concat([a[2], a[1]], a[3:]), ',') ELSE array_to_string(a, ',') END AS moved, array_to_string(a, ',') AS kept FROM l"""
)
def selection_edits(spark, sf_dir):
    """Lists of one customer's orders with one taken out, one added, two exchanged, and a move beyond the end."""
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("a"))
    shown = lambda c: F.array_join(c.cast("array<string>"), ",")
    a, one = F.col("a"), F.lit(1)
    return own.select(
        "o_custkey", shown(sheets.toggled(a, a[0])).alias("removed"), shown(sheets.toggled(a, F.lit(-1).cast("long"))).alias("appended"), shown(sheets.moved(a, F.lit(0), one)).alias("moved"), shown(sheets.moved(a, F.size(a) - 1, one)).alias("kept")
    )


# ---- sinks ------------------------------------------------------------------------------------------------


def _drafts(spark, sf_dir) -> DataFrame:
    """Orders as drafts; every fifth has no title, and one in three an image."""
    k = F.col("o_orderkey")
    url = F.concat(F.lit("data:image/png;base64,"), F.base64(F.concat(F.lit("bild"), k.cast("string")).cast("binary")))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("T/"), F.col("o_orderpriority"))).alias("title"), F.repeat(F.lit("nenne "), (k % 700).cast("int")).alias("question_text"), F.lit("AFB 1").alias("afb_raw"),
        F.when(k % 2 == 0, "2+3").otherwise("").alias("points_raw"), (k % 2 * (k % 4)).cast("double").alias("max_points"), F.lit(7.5).alias("estimated_time"), F.lit("7").alias("class_level"), F.lit("Terme").alias("topic"),
        F.when(k % 7 == 0, "Unbekannt").otherwise("Mathematik").alias("competence"), F.lit("a, b,").alias("expectation"), F.when(k % 3 == 0, url).when(k % 11 == 0, "kaputt").alias("image_data_url"), F.lit("").alias("image_name"), (F.col("o_orderstatus") != "P").alias("include"),
    )


TARGET = {"name": "title", "Aufgabentext": "rich_text", "Punkte": "number", "Minuten": "number", "Klasse": "number", "Thema": "select", "Erwartung": "multi_select", "Bild": "files", "AFB": "odd"}


@query(
    """
WITH k AS (SELECT o_orderkey AS id, o_orderkey % 700 * 6 AS n, o_orderpriority AS p FROM orders)
SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END AS n_title, CAST((n + 1899) // 1900 AS INTEGER) AS n_chunks, CASE WHEN id % 2 = 0 THEN 0 ELSE id % 4 END::DOUBLE AS points, 7.5::DOUBLE AS minutes, 7.0::DOUBLE AS class_level, 'Terme' AS topic, 'a|b' AS expectation,
  CASE WHEN id % 3 = 0 THEN CASE WHEN id % 5 = 0 THEN 'aufgabe.png' ELSE 'T-' || replace(p, ' ', '-') || '.png' END END AS image_name, CASE WHEN id % 3 = 0 THEN 'bild' || id END AS image, 8 AS n_columns FROM k
"""
)
def target_rows(spark, sf_dir):
    """Drafts adapted to a target's columns; a column of a type that is not known is left out."""
    rows = _drafts(spark, sf_dir).withColumn("image_data_url", F.when(F.col("id") % 3 == 0, F.col("image_data_url")))
    out = sink.adapt(rows.withColumn("key", F.col("id")), TARGET | {"key": "url"}, sink.ALIASES | {"key": ["key"]})
    return out.select(
        F.col("key").cast("long").alias("id"), F.size("name").alias("n_title"), F.size("Aufgabentext").alias("n_chunks"), F.col("Punkte").alias("points"), F.col("Minuten").alias("minutes"), F.col("Klasse").alias("class_level"),
        F.col("Thema").alias("topic"), F.array_join("Erwartung", "|").alias("expectation"), F.col("Bild.name").alias("image_name"), F.decode(F.col("Bild.bytes"), "UTF-8").alias("image"), F.lit(len(out.columns) - 1).alias("n_columns"),
    )


_OUTCOMES = """
WITH k AS (SELECT o_orderkey AS id, o_orderpriority AS p FROM orders WHERE o_orderstatus <> 'P'),
o AS (SELECT id, CASE WHEN id % 5 = 0 THEN '' ELSE 'T/' || p END AS title, CASE WHEN id % 5 = 0 THEN 'title is empty' WHEN id % 700 = 0 THEN 'text is empty' WHEN id % 7 = 0 THEN 'partition is unknown' WHEN id % 3 <> 0 AND id % 11 = 0 THEN 'image is malformed' END AS error FROM k)
"""


def _known(spark) -> DataFrame:
    return spark.createDataFrame([("7", "Terme", "Mathematik")], "class_level string, topic string, competence string")


@query(_OUTCOMES + "SELECT id, error, error IS NULL AS ok FROM o")
def commit_outcomes(spark, sf_dir):
    """Included drafts written to a pool, or the reason why not."""
    path = scratch(spark)
    return sink.commit(_drafts(spark, sf_dir), _known(spark), f"{path}/pool", f"{path}/outcomes").select("id", "error", "ok")


@query(_OUTCOMES + ", f AS (SELECT DISTINCT title FROM o WHERE error IS NOT NULL) SELECT o_orderkey AS id FROM orders WHERE CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'T/' || o_orderpriority END IN (SELECT title FROM f)")
def still_open(spark, sf_dir):
    """Drafts whose title failed."""
    drafts = _drafts(spark, sf_dir)
    return sink.still_open(drafts, sink.outcomes(drafts, _known(spark)).where("not ok")).select("id")


@query(
    _OUTCOMES
    + """
, l AS (SELECT strftime(o_orderdate, '%Y-%m-%d') || '#' || o_orderkey AS "at", 1::BIGINT AS imported, 0::BIGINT AS failed, 1 AS n_titles FROM orders
  UNION ALL SELECT '9999', count(*) FILTER (error IS NULL), count(*) FILTER (error IS NOT NULL), CAST(count(*) FILTER (error IS NULL) AS INTEGER) FROM o)
SELECT * FROM l ORDER BY "at" DESC LIMIT 30
"""
)
def import_history(spark, sf_dir):
    """The newest thirty entries with that of a commit."""
    orders = table(spark, sf_dir, "orders")
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("#"), F.col("o_orderkey").cast("string"))
    log = orders.select(at.alias("at"), F.array(F.lit("f")).alias("files"), F.lit(1).cast("long").alias("imported"), F.lit(0).cast("long").alias("failed"), F.array("o_orderpriority").alias("titles"))
    done = sink.outcomes(_drafts(spark, sf_dir), _known(spark))
    return sink.with_entry(log, done, F.lit("9999"), ["a.docx"]).select("at", "imported", "failed", F.size("titles").alias("n_titles"))


@query("SELECT p_partkey, 'image/gif' AS mime, md5(p_name) AS bytes, 'data:image/gif;base64,' || base64(encode(p_name)) AS attached, NULL AS problem, 'not an image' AS other FROM part")
def image_parts(spark, sf_dir):
    """Data URLs taken apart and made from a picture chosen by hand."""
    name = F.col("p_name").cast("binary")
    d = documents.data_url(F.concat(F.lit("data:image/gif;base64,"), F.base64(name)))
    a, b = (sink.attach_image(F.col("p_name"), F.lit(m), name) for m in ("image/gif", "text/plain"))
    rows = table(spark, sf_dir, "part").select("p_partkey", d.alias("d"), a.alias("a"), b.alias("b"))
    return rows.select("p_partkey", "d.mime", F.md5("d.bytes").alias("bytes"), F.col("a.image_data_url").alias("attached"), "a.problem", F.col("b.problem").alias("other"))


@query(
    """SELECT p_partkey, k AS kind, w::BIGINT AS width, h::BIGINT AS height FROM part, LATERAL (SELECT unnest(['png', 'jpg', 'png', NULL]) AS k, unnest([p_size + 256, p_size, 640, NULL]) AS w, unnest([p_size, 512 + p_size, 360, NULL]) AS h) x"""
)
def image_sizes(spark, sf_dir):
    """Kind and size of PNG and JPEG heads, of a PNG by type alone, and of other bytes."""
    size = lambda v, n: F.lpad(F.hex(v.cast("long")), 2 * n, "0")
    w = F.col("p_size")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), size(w + 256, 4), size(w, 4))
    jpg = F.concat(F.lit("FFD8FFE000040000FFC0001108"), size(w + 512, 2), size(w, 2), F.lit("0000000000"))
    cases = F.array(*[F.struct(F.unhex(h).alias("b"), F.lit(t).alias("t")) for h, t in ((png, ""), (jpg, ""), (F.lit("00"), "image/png"), (F.lit("0011"), ""))])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(cases).alias("c"))
    return rows.select("p_partkey", documents.image_size(F.col("c.b"), F.col("c.t")).alias("i")).select("p_partkey", "i.*")


@query("SELECT o_orderkey AS id, '8' AS class_level, CASE WHEN o_orderkey % 2 = 0 THEN 'Körper' ELSE 'Terme & Gleichungen' END AS topic, true AS cleared FROM orders")
def draft_class_change(spark, sf_dir):
    drafts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("7").alias("class_level"), F.when(F.col("o_orderkey") % 2 == 0, "Körper").otherwise("Terme").alias("topic"), F.struct(F.lit(1).alias("id"), F.lit(0.9).alias("score")).alias("duplicate"))
    return imports.changed_class(drafts, F.lit("8"), TOPICS_BY_CLASS).select("id", "class_level", "topic", F.col("duplicate").isNull().alias("cleared"))


@query("SELECT c_custkey, replace(c_name, '#', '') AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Argumentieren' WHEN c_mktsegment = 'FURNITURE' THEN 'Modellieren' ELSE 'Mathematik' END AS competence, CAST(c_nationkey AS VARCHAR) AS points FROM customer")
def stated_values(spark, sf_dir):
    """Ids without dashes, competences by their stated beginnings, points as they are shown."""
    from ..functions.classify import parse_competence

    said = F.when(F.col("c_mktsegment") == "BUILDING", "Problem, ARGUMENT").when(F.col("c_mktsegment") == "FURNITURE", "Ein Modell").otherwise(F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", pool.normalize_id(F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit("-")))).alias("id"), parse_competence(said).alias("competence"), js_number(F.col("c_nationkey").cast("double")).alias("points"))
