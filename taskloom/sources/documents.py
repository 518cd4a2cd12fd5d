"""Documents: DOCX text with formulas, pages, limits of an upload."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.documents import expectation_rows, page_text, repair_math, simplify_html, strip_html
from ..functions.textual import or_else, text, trim

MOST_FILES, MOST_BYTES, SPARSE = 10, 4 * 1024 * 1024, 400
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


# Types of files by extension, and how their text is extracted.
MIME = {"docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pdf": "application/pdf", "html": "text/html", "htm": "text/html", "txt": "text/plain"}
METHOD_PDF, METHOD_DOCX, METHOD_REPAIRED = "pdf-text", "docx", "visual"
#: Characters of a page image's data URL up to which it is kept.
MOST_PAGE_IMAGE = 350_000


# Nodes of text, of blanks, and of formulas with their LaTeX form and its parts.
_TEXTS, _BLANKS = {_W + "t", _M + "t"}, {_W + "tab": "\t", _W + "br": "\n"}
_FORMULAS = {_M + "f": ("\\frac{%s}{%s}", ("num", "den")), _M + "sSup": ("%s^{%s}", ("e", "sup")), _M + "sSub": ("%s_{%s}", ("e", "sub")), _M + "rad": ("\\sqrt{%s}", ("e",))}
# Nodes that HTML has a form for.
_HTML = {_W + "tbl": "table", _W + "tr": "tr", _W + "tc": "td"}
_P, _BLIP, _STYLE, _ITEM, _VALUE, _EMBED = _W + "p", _A + "blip", f"{_W}pPr/{_W}pStyle", f"{_W}pPr/{_W}numPr", _W + "val", _R + "embed"


def _document(data: bytes):
    """The tree of a DOCX file's text and its archive; None if it can't be read."""
    import io
    import zipfile
    from xml.etree import ElementTree

    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        return ElementTree.fromstring(archive.read("word/document.xml")), archive
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None


def _math(node) -> str:
    """A node's text with formulas in LaTeX form."""

    def part(tag: str) -> str:
        found = node.find(_M + tag)
        return "" if found is None else "".join(map(_math, found))

    tag = node.tag
    if tag in _TEXTS:
        return node.text or ""
    if tag in _BLANKS:
        return _BLANKS[tag]
    if tag in _FORMULAS:
        form, parts = _FORMULAS[tag]
        return form % tuple(map(part, parts))
    return "".join(map(_math, node))


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file with its formulas in LaTeX form; '' if it can't be read."""
    found = _document(data)
    return "" if found is None else _formula_text(found[0])


def _formula_text(root) -> str:
    paragraphs = (re.sub("[ \t]+", " ", "".join(map(_math, p))).strip() for p in root.iter(_P))
    return "\n".join(p for p in paragraphs if p)


def docx_parts(data: bytes, name: str) -> dict:
    """html, raw, math and images (data_url, name) of a DOCX file; html and raw are null if it can't be read.

    The HTML has paragraphs, headings, list items, tables, line breaks, and images by number.
    """
    import base64
    import mimetypes
    from html import escape
    from xml.etree import ElementTree

    found = _document(data)
    if found is None:
        return {"html": None, "raw": None, "math": "", "images": []}
    root, archive = found
    stem = re.sub(r"(?i)\.docx$", "", name)
    there = set(archive.namelist())
    targets = {}
    if "word/_rels/document.xml.rels" in there:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("word/_rels/document.xml.rels"))}
    images: list[dict] = []

    def image(node) -> str:
        target = targets.get(node.get(_EMBED))
        path = f"word/{target}" if target and not target.startswith("/") else (target or "").lstrip("/")
        if path not in there:
            return ""
        mime = mimetypes.guess_type(path)[0] or "image/png"
        ending = "jpg" if "jpeg" in mime else mime.split("/")[1] or "png"
        images.append({"data_url": f"data:{mime};base64,{base64.b64encode(archive.read(path)).decode()}", "name": f"{stem}-bild-{len(images) + 1}.{ending}"})
        return f'<img data-import-image="{len(images) - 1}">'

    def paragraph(p) -> str:
        style = p.find(_STYLE)
        heading = style is not None and re.fullmatch(r"(?i)heading([1-6])|berschrift([1-6])", (style.get(_VALUE) or "").lstrip("Üü"))
        tag = f"h{heading[1] or heading[2]}" if heading else "li" if p.find(_ITEM) is not None else "p"
        return f"<{tag}>{''.join(map(html, p))}</{tag}>"

    def html(node) -> str:
        tag = node.tag
        if tag == _W + "t":
            return escape(node.text or "", quote=False)
        if tag == _P:
            return paragraph(node)
        if tag in _BLANKS:
            return "<br />" if tag == _W + "br" else _BLANKS[tag]
        if tag == _BLIP:
            return image(node)
        if tag == _M + "t":
            return ""
        inner = "".join(map(html, node))
        return f"<{_HTML[tag]}>{inner}</{_HTML[tag]}>" if tag in _HTML else inner

    def raw(p) -> str:
        return "".join((x.text or "") if x.tag == _W + "t" else _BLANKS.get(x.tag, "") for x in p.iter())

    body = html(root)
    return {"html": body, "raw": "".join(f"{raw(p)}\n\n" for p in root.iter(_P)), "math": _formula_text(root), "images": images}


_PARTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("html", "raw", "math")]
    + [T.StructField("images", T.ArrayType(T.StructType([T.StructField("data_url", T.StringType()), T.StructField("name", T.StringType())])))]
)


@F.pandas_udf(_PARTS)
def _docx(content: pd.Series, name: pd.Series) -> pd.DataFrame:
    none = {"html": None, "raw": None, "math": None, "images": None}
    return pd.DataFrame([none if b is None else docx_parts(bytes(b), n or "") for b, n in zip(content, name)], columns=["html", "raw", "math", "images"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, extension, mime_type, content, bytes) of files."""
    df = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return df.select(name.alias("name"), extension.alias("extension"), F.try_element_at(known, extension).alias("mime_type"), "content", F.length("content").alias("bytes"))


def file_kind(extension: Column, mime: Column) -> Column:
    """docx, pdf, html or txt by extension or type; null for others."""
    mime = text(mime)
    return (
        F.when((extension == "docx") | mime.contains("wordprocessingml"), "docx")
        .when((extension == "pdf") | (mime == MIME["pdf"]), "pdf")
        .when(extension.isin("html", "htm") | (mime == MIME["html"]), "html")
        .when((extension == "txt") | (mime == MIME["txt"]), "txt")
    )


def method_tag(mime: Column, repaired: Column | None = None) -> Column:
    """How a source's text was extracted: by type, unless its pages were repaired."""
    by_type = F.when(mime == MIME["pdf"], METHOD_PDF).otherwise(METHOD_DOCX)
    return by_type if repaired is None else F.when(repaired, METHOD_REPAIRED).otherwise(by_type)


SOURCE = "name string, mime_type string, text string, simplified string, images array<struct<data_url:string,name:string,decorative:boolean>>, expectation_rows array<struct<title:string,expectation:string,points_raw:string>>, pages array<struct<page_number:int,text:string>>, method string, error string"


def marked_images(images: Column) -> Column:
    """Images with ``decorative``: the same picture stands in the document more than once."""
    return F.transform(images, lambda m: F.struct(m["data_url"].alias("data_url"), m["name"].alias("name"), (F.size(F.filter(images, lambda n: n["data_url"] == m["data_url"])) > 1).alias("decorative")))


def extract(files: DataFrame, pages: DataFrame | None = None, page_images: DataFrame | None = None) -> DataFrame:
    """Files (name, extension, mime_type, content) as sources with the columns of ``SOURCE``.

    DOCX files are read; a PDF's texts are brought by the caller as ``pages`` (name, page_number, text), its
    pictures as ``page_images`` (name, page_number, data_url), since reading PDF takes a library of its own.
    HTML and plain texts are sources too. Other types, and PDF files without pages, have an error.
    """
    mime = F.col("mime_type") if "mime_type" in files.columns else F.lit(None).cast("string")
    rows = files.select("name", file_kind(F.col("extension"), mime).alias("kind"), "extension", "content")
    kind = F.col("kind")
    rows = rows.withColumn("d", _docx(F.when(kind == "docx", F.col("content")), F.col("name"))).withColumn("plain", F.when(kind.isin("html", "txt"), F.decode("content", "UTF-8"))).drop("content")
    rows = rows.withColumn("html", F.when(kind == "docx", F.col("d.html")).when(kind == "html", F.col("plain")))
    rows = rows.withColumn("lines", simplify_html(F.col("html"))).withColumn("rows", expectation_rows(F.col("html"))).withColumn("stripped", strip_html(F.when(kind == "html", F.col("html"))))
    body = F.when(kind == "docx", better_text(F.col("d.math"), text("d.raw"))).when(kind == "html", F.col("stripped")).when(kind == "txt", F.col("plain"))
    simple = F.when(kind == "txt", F.col("plain")).otherwise(or_else(F.col("lines"), text("d.raw")))
    none = F.array().cast("array<struct<data_url:string,name:string,decorative:boolean>>")
    out = rows.select("name", "kind", "extension", body.alias("text"), simple.alias("simplified"), F.coalesce(marked_images(F.col("d.images")), none).alias("images"), F.when(kind != "pdf", F.col("rows")).alias("expectation_rows"))
    if pages is not None:
        read = pages_document(pages.withColumnRenamed("name", "doc"))
        out = out.join(read.select(F.col("doc").alias("name"), F.col("text").alias("page_text"), F.col("simplified").alias("page_lines"), "pages"), "name", "left")
        out = out.withColumn("text", F.when(kind == "pdf", F.col("page_text")).otherwise(F.col("text"))).withColumn("simplified", F.when(kind == "pdf", F.col("page_lines")).otherwise(F.col("simplified")))
    else:
        out = out.withColumn("pages", F.lit(None))
    if page_images is not None:
        small = page_images.where((text("data_url") != "") & (F.length("data_url") <= MOST_PAGE_IMAGE))
        listed = small.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("page_number", "image_number", "data_url"))).alias("p"))  # the pictures of one file
        label = lambda p: F.concat(F.regexp_replace("name", r"(?i)\.pdf$", ""), F.format_string("-seite-%d-bild-%d.png", p["page_number"], p["image_number"]))
        listed = listed.select("name", F.transform("p", lambda p: F.struct(p["data_url"].alias("data_url"), label(p).alias("name"), F.lit(False).alias("decorative"))).alias("found"))
        out = out.join(listed, "name", "left").withColumn("images", F.when(kind == "pdf", F.coalesce("found", none)).otherwise(F.col("images")))
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    error = F.when(kind.isNull(), F.concat(F.lit("unsupported type: "), F.col("extension"))).when(F.col("text").isNull(), "no text")
    mime_type = F.try_element_at(known, kind)
    rows = F.coalesce("expectation_rows", F.array().cast("array<struct<title:string,expectation:string,points_raw:string>>"))
    return out.select(
        "name", mime_type.alias("mime_type"), text("text").alias("text"), text("simplified").alias("simplified"), "images", rows.alias("expectation_rows"),
        F.col("pages").cast("array<struct<page_number:int,text:string>>").alias("pages"), method_tag(mime_type).alias("method"), error.alias("error"),
    )


def summary(sources: DataFrame) -> DataFrame:
    """(name, characters, images, method) of sources."""
    return sources.select("name", F.length("text").alias("characters"), F.size("images").alias("images"), "method")


def sparse(sources: DataFrame) -> DataFrame:
    """PDF sources with hardly any text."""
    return sources.where((F.col("mime_type") == MIME["pdf"]) & (F.length(trim(F.col("text"))) < SPARSE))


def upload_problem(files: DataFrame, *by: str) -> DataFrame:
    """Number of files, bytes, and the limit that they break, if any: one row, or one for each upload."""
    totals = files.groupBy(*by).agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    problem = F.when(F.col("files") < 1, "no file").when(F.col("files") > MOST_FILES, "too many files").when(F.col("bytes") > MOST_BYTES, "too large")
    return totals.withColumn("problem", problem)


def pages_document(pages: DataFrame, repair: bool = True) -> DataFrame:
    """(doc, text, simplified, pages) of page texts (doc, page_number, text), in page order."""
    rows = pages.withColumn("text", trim(repair_math(text("text")))) if repair else pages
    listed = rows.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(F.col("page_number").cast("int").alias("page_number"), "text"))).alias("pages"))  # of one document
    return listed.select("doc", page_text(F.col("pages")).alias("text"), page_text(F.col("pages"), True).alias("simplified"), "pages")


def better_text(math: Column, raw: Column) -> Column:
    """The text with formulas if it has 80 % of the raw text's length."""
    return F.when(F.length(math) >= 0.8 * F.length(raw), math).otherwise(raw)
