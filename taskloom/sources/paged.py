"""A data source of paged results: files of JSON pages that name the next page.

A source is a folder of pages ``{"results": [...], "has_more": bool, "next_cursor": text}``; the first page is
``start.json``, and the page at a cursor ``<cursor>.json``. Each source is one partition, read page by page.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

START = "start"


class SourcePartition(InputPartition):
    def __init__(self, source: str):
        super().__init__(source)
        self.source = source


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.sources = json.loads(options.get("sources", "null"))

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def partitions(self) -> list[SourcePartition]:
        from pyarrow import fs

        files, base = self._files()
        named = self.sources
        if named is None:
            named = sorted(f.base_name for f in files.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.Directory)
        return [SourcePartition(s) for s in named]

    def read(self, partition: SourcePartition) -> Iterator[tuple]:
        files, base = self._files()
        cursor, seen = START, set()
        while cursor:
            if cursor in seen or not re.fullmatch(r"[\w.-]+", cursor):
                raise ValueError(f"{partition.source}: bad cursor {cursor}")
            seen.add(cursor)
            with files.open_input_stream(f"{base}/{partition.source}/{cursor}.json") as f:
                page = json.loads(f.read())
            for r in page.get("results") or []:
                if r.get("object") == "page":
                    yield partition.source, r["object"], r.get("id"), json.dumps(r.get("properties") or {}, ensure_ascii=False)
            cursor = page.get("next_cursor") if page.get("has_more") else None


class PagedSource(DataSource):
    """``spark.read.format("paged").load(path)``: (data_source_id, object, id, properties JSON) of all pages."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "data_source_id string, object string, id string, properties string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def write_pages(pages, path: str) -> None:
    """Pages (source, page, next, results: JSON of a list) as files that :func:`read_paged` reads.

    ``page`` and ``next`` are cursors, ``next`` null on the last page. Files are written by the tasks that hold the pages; a
    task that is repeated writes the same files anew.
    """
    from pyspark.sql import functions as F

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        for b in batches:
            for r in b.to_pylist():
                files.create_dir(f"{base}/{r['source']}", recursive=True)
                with files.open_output_stream(f"{base}/{r['source']}/{r['page']}.json") as f:
                    body = {"has_more": r["next"] is not None, "next_cursor": r["next"]}
                    f.write(f'{json.dumps(body)[:-1]}, "results": {r["results"]}}}'.encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    pages.select("source", "page", "next", "results").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_paged(spark, path: str, sources: list[str] | None = None):
    """Records of paged sources with typed properties; all folders of ``path`` unless ``sources`` names some."""
    from pyspark.sql import functions as F

    from .pool import PROPERTY

    spark.dataSource.register(PagedSource)
    options = {} if sources is None else {"sources": json.dumps(sources)}
    rows = spark.read.format("paged").options(**options).load(path)
    return rows.withColumn("properties", F.from_json("properties", f"map<string,{PROPERTY}>"))
