"""Sources over saved responses: live network calls are out of scope, what they returned isn't.

``saved_search`` is a Python data source: one partition a file of JSON
responses (one document a file), each projected to result rows; files are found and opened through the file
system that their address names, the same on the driver and the executors. ``search_results`` and
``result_pages`` do the same through Spark's own readers, for stores that only Spark can open.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievework.functions import text as T
from sievework.operators import extract

RESULT_SCHEMA = "query string, rid int, title string, url string, snippet string, published_date string, score double"


@dataclass(frozen=True)
class Layout:
    """Where a provider keeps its results, and their fields by ours; fields that aren't there are ''."""

    path: tuple[str, ...]
    fields: dict[str, str]
    most: int | None = None  # results a response has at most


# The providers' responses.
LAYOUTS = {
    "searx": Layout(("results",), {"title": "title", "url": "url", "snippet": "content", "published_date": "publishedDate", "score": "score"}),
    "brave": Layout(("web", "results"), {"title": "title", "url": "url", "snippet": "description", "published_date": "page_age"}, 20),
    "wiki": Layout(("results",), {"title": "title", "url": "path", "snippet": "snippet", "score": "score"}),
}
# What else an encyclopedia's server answers, as fields of ours.
WIKI_RESPONSES = {
    "search": {"title": "title", "url": "path", "content": "snippet", "score": "score", "zim": "zim"},
    "suggest": {"title": "title", "url": "path"},
    "catalog": {"name": "name", "title": "title", "description": "description", "language": "language", "file": "file", "entries": "entries"},
    "content": {"content": "content"},
    "random": {"title": "title", "path": "path"},
}
BRAVE_MOST = 20
FRESHNESS = {"day": "PD", "week": "PW", "month": "PM", "year": "PY"}


def brave_params(query: str, count: int = 20, time_range: str | None = None) -> dict[str, str | int]:
    """The parameters of a request; a range of time without a short form is passed on in lower case."""
    fresh = {"freshness": FRESHNESS.get(time_range.lower(), time_range.lower())} if time_range else {}
    return {"q": query, "count": min(count, BRAVE_MOST), **fresh}


def _parsed(body: str | None):
    try:
        return json.loads(body or "")
    except ValueError:
        return None


def result_rows(body: str | None, layout: str) -> Iterator[tuple]:
    """Result rows of one response; a broken or empty response has none."""
    data, spec = _parsed(body), LAYOUTS[layout]
    query = data.get("query") if isinstance(data, dict) else None
    for step in spec.path:
        data = data.get(step) or {} if isinstance(data, dict) else {}
    for k, r in enumerate((data if isinstance(data, list) else [])[: spec.most]):
        have = {ours: r.get(theirs) for ours, theirs in spec.fields.items()} if isinstance(r, dict) else {}
        score = have.get("score")
        yield query if isinstance(query, str) else None, k, have.get("title") or "", have.get("url") or "", have.get("snippet") or "", have.get("published_date"), float(score) if score is not None else None


def wiki_rows(body: str | None, kind: str, book: str = "") -> list[dict]:
    """An encyclopedia's response of any kind as rows; suggestions stand under the book's name. What isn't as expected has none."""
    data, fields = _parsed(body), WIKI_RESPONSES[kind]
    if kind in ("content", "random"):
        rows = [data] if isinstance(data, dict) and data else []
    elif kind == "catalog":
        rows = data if isinstance(data, list) else []
    else:
        rows = data.get("results" if kind == "search" else book) or [] if isinstance(data, dict) else []
    blank = {"score": 0, "entries": 0}
    return [{ours: r.get(theirs, blank.get(ours, "")) for ours, theirs in fields.items()} for r in (rows if isinstance(rows, list) else []) if isinstance(r, dict)]


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class SavedSearch(DataSource):
    """Options: ``path`` (a file, a folder, or a pattern for the names in one; on a file system that all executors see), ``layout``."""

    @classmethod
    def name(cls) -> str:
        return "saved_search"

    def schema(self) -> str:
        return RESULT_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        fs, path = _opened(self.options["path"])
        folder, _, pattern = path.rpartition("/")
        if not any(c in pattern for c in "*?["):
            if fs.get_file_info(path).type == pafs.FileType.File:
                return [InputPartition(path)]
            folder, pattern = path, "*"
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and fnmatch(f.base_name, pattern)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # no file was found
            return
        fs, _ = _opened(self.options["path"])
        with fs.open_input_stream(partition.value) as f:
            yield from result_rows(f.read().decode("utf-8", "replace"), self.options.get("layout", "searx"))


def search_results(spark: SparkSession, path: str, layout: str = "searx") -> DataFrame:
    """As ``saved_search``, through Spark's own readers; snippets without tags."""
    names = [f.split()[0] for f in RESULT_SCHEMA.split(", ")]
    rows = extract.extract_rows(_bodies(spark, path), "url", "body", lambda x: [{"row": json.dumps(dict(zip(names, r, strict=True)))} for r in result_rows(x, layout)], ["row"])
    return rows.select(F.from_json("row", RESULT_SCHEMA).alias("r")).select("r.*").withColumn("snippet", T.strip_tags(F.col("snippet")))


def result_pages(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """``page, rid, url, title, snippet`` of saved result pages (one a file), by their layout, else by their links; a page that refuses has none."""
    found = extract.extract_rows(_bodies(spark, path).withColumnRenamed("url", "page"), "page", "body", lambda x: extract.search_page(x, layout), ["url", "title", "snippet"])
    return found.withColumnRenamed("pos", "rid")


def _bodies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("body"))


def binary_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched bytes (``url, content``) for extractors, e.g. of PDF pages."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), "content")


# ---- documents of pages (PDF and the like): how they are read is a parameter, no library for it is here

#: Larger files are not read.
MOST_BYTES = 100 << 20


def form_feeds(content: bytes) -> list[str]:
    """Stand-in for a reader of documents: plain text whose pages end with a form feed."""
    return content.decode("utf-8", "replace").split("\f")


def document_pages(files: DataFrame, reader: Callable[[bytes], list[str]] = form_feeds) -> DataFrame:
    """``url, page, text`` of files (``url, content``): pages from 1, without control characters; empty ones are left out, unreadable files and those beyond MOST_BYTES have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, numbers, texts = [], [], []
            for url, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    pages = reader(content.as_py() or b"")
                except Exception:  # noqa: BLE001 - any failure of a reader
                    pages = []
                urls += [url.as_py()] * len(pages)
                numbers += range(1, len(pages) + 1)
                texts += pages
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["url", "page", "text"])

    pages = files.where(F.length("content") <= MOST_BYTES).select("url", "content").mapInArrow(run, "url string, page int, text string")
    clean = F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return pages.select("url", "page", clean.alias("text")).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


def document_texts(files: DataFrame, reader: Callable[[bytes], list[str]] = form_feeds) -> DataFrame:
    """``url, text``: a file's pages joined by empty lines. A file is one row before and after, so its pages meet without growing a task."""
    pages = document_pages(files, reader).groupBy("url").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return pages.select("url", F.array_join(F.col("p.text"), "\n\n").alias("text"))
