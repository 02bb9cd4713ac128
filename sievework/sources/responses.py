"""Saved responses as one table that reads only the files a filter asks for.

Files lie as ``<provider>/<day>/<kind>/<query>.json`` (names percent-encoded). Equalities and lists of values of these four
columns are taken over by the source: what they leave out is neither listed (whole folders) nor opened. A
response's body is one column; in Spark it becomes a variant, whose shape depends on the kind.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from sievework.sources.event_files import opened
from sievework.sources.saved import WIKI_RESPONSES

LEVELS = ("provider", "day", "kind", "query")
SCHEMA = "provider string, day string, kind string, query string, body string"
#: Files of one task.
FILES = 64


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, ...]]


class Responses(DataSource):
    """Option ``path``: a folder on a file system that the driver and all executors see."""

    @classmethod
    def name(cls) -> str:
        return "saved_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


@dataclass
class _Reader(DataSourceReader):
    path: str
    wanted: dict[str, set] = field(default_factory=dict)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in LEVELS:
                yield f
                continue
            name = f.attribute[0]
            self.wanted[name] = self.wanted[name] & values if name in self.wanted else values

    def partitions(self) -> list[InputPartition]:
        fs, root = opened(self.path)
        found: list[tuple[str, ...]] = [()]
        for level in LEVELS:
            ends = ".json" if level == "query" else ""
            deeper = []
            for at in found:
                folder = "/".join((root, *at))
                if level in self.wanted:  # looked up by name: nothing is listed
                    names = [quote(v, safe="") + ends for v in sorted(x for x in self.wanted[level] if x is not None)]
                    deeper += [(*at, n) for n in names if fs.get_file_info(f"{folder}/{n}").type != pafs.FileType.NotFound]
                else:
                    infos = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
                    deeper += sorted((*at, i.base_name) for i in infos if not i.base_name.startswith(("_", ".")) and i.base_name.endswith(ends))
            found = deeper
        return [Files(found[k : k + FILES]) for k in range(0, len(found), FILES)]

    def read(self, partition: Files | None) -> Iterator[tuple]:
        fs, root = opened(self.path)
        for at in partition.paths if partition else []:
            with fs.open_input_stream("/".join((root, *at))) as f:
                yield *(unquote(n.removesuffix(".json") if k == 3 else n) for k, n in enumerate(at)), f.read().decode("utf-8", "replace")


def responses(spark: SparkSession, path: str) -> DataFrame:
    """``provider, day, kind, query, body``; filters on the first four reach the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Responses)
    return spark.read.format("saved_responses").option("path", path).load()


# ---- an encyclopedia's five kinds of response as one table of variants

#: Fields that aren't there are empty, or 0 where they are numbers; where each kind keeps its rows.
NUMBERS = {"score": "double", "entries": "bigint"}


def wiki_table(bodies: DataFrame, kind: str = "kind", book: str = "book", body: str = "body") -> DataFrame:
    """The rows of responses of any kind: the columns of ``bodies`` but the body, with ``pos`` and ``row``, a variant (one entry of the response).

    A search keeps its entries under ``results``, suggestions stand under the book's name, a catalog is a list, the others are one entry. What isn't as expected has no rows.
    """
    names = [c for c in bodies.columns if c != body]
    v = bodies.withColumn("__v", F.try_parse_json(body))
    # arrays of variants; a response of another shape gives null, and so no rows
    search = F.try_variant_get("__v", "$.results", "array<variant>")
    suggest = F.map_values(F.map_filter(F.try_variant_get("__v", "$", "map<string,variant>"), lambda k, _: k == F.col(book)))
    listed = F.try_variant_get(F.get(suggest, F.lit(0)), "$", "array<variant>")
    one = F.filter(F.array(F.col("__v")), lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT<")) & (F.schema_of_variant(x) != "OBJECT<>"))
    rows = F.when(F.col(kind) == "search", search).when(F.col(kind) == "suggest", listed).when(F.col(kind) == "catalog", F.try_variant_get("__v", "$", "array<variant>")).when(F.col(kind).isin("content", "random"), one)
    entries = v.select(*names, F.posexplode_outer(F.filter(rows, lambda r: F.startswith(F.schema_of_variant(r), F.lit("OBJECT<")))).alias("pos", "row"))
    return entries.where(F.col("row").isNotNull())


def wiki_fields(rows: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind with their fields as columns."""
    fields = WIKI_RESPONSES[kind]
    columns = [F.coalesce(F.try_variant_get("row", f"$.{theirs}", NUMBERS.get(ours, "string")), F.lit(0 if ours in NUMBERS else "")).alias(ours) for ours, theirs in fields.items()]
    return rows.where(F.col("kind") == kind).select(*[c for c in rows.columns if c not in ("row", "kind", *fields)], *columns)
