"""A writer whose batches are seen whole or not at all, and once: rows of a store or of the memory.

A task writes its rows as Parquet files of its own and reports their names; the commit enters them in a manifest, one
file a batch, which is put in its place by a rename. Readers read what manifests name. So what an aborted or lost task has
written is never seen, and a batch that is written again (a stream's replay, a retried job) finds its manifest and leaves everything as it is.

``path`` must be on a file system that the driver and all executors see.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sievework.sources.event_files import opened


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class BatchRows(DataSource):
    """Options: ``path``, ``batch`` (the name under which a batch is written once)."""

    @classmethod
    def name(cls) -> str:
        return "batch_rows"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options["batch"], schema)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str, schema: StructType) -> None:
        self.path, self.batch, self.schema = path.rstrip("/"), batch, schema

    def _manifest(self, root: str) -> str:
        return f"{root}/batches/{self.batch}.json"

    def _known(self) -> bool:
        fs, root = opened(self.path)
        return fs.get_file_info(self._manifest(root)).type == pafs.FileType.File

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        if self._known():
            for _ in iterator:
                pass
            return Written(None, 0)
        fs, root = opened(self.path)
        fs.create_dir(f"{root}/rows", recursive=True)
        name, rows, schema = f"rows/{self.batch}-{uuid.uuid4().hex}.parquet", 0, to_arrow_schema(self.schema)
        out = None
        for batch in iterator:
            if out is None:
                out = pq.ParquetWriter(f"{root}/{name}", schema, filesystem=fs)
            out.write_batch(batch.cast(schema))
            rows += batch.num_rows
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        if self._known():
            self.abort(messages)  # another attempt has entered the batch
            return
        fs, root = opened(self.path)
        fs.create_dir(f"{root}/batches", recursive=True)
        files = [{"file": m.file, "rows": m.rows} for m in messages if m is not None and m.file]
        draft = f"{root}/batches/_{self.batch}-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps({"batch": self.batch, "files": files}).encode())
        fs.move(draft, self._manifest(root))

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        for m in messages:
            if m is not None and m.file and fs.get_file_info(f"{root}/{m.file}").type == pafs.FileType.File:
                fs.delete_file(f"{root}/{m.file}")


def write_batch(rows: DataFrame, path: str, batch: str) -> None:
    """Writes the rows as the batch of that name, once."""
    rows.sparkSession.dataSource.register(BatchRows)
    rows.write.format("batch_rows").option("path", path).option("batch", batch).mode("append").save()


def batches(spark: SparkSession, path: str) -> DataFrame:
    """``batch, file, rows`` of what has been committed."""
    fs, root = opened(path)
    if fs.get_file_info(f"{root}/batches").type != pafs.FileType.Directory:
        return spark.createDataFrame([], "batch string, file string, rows bigint")
    kind = "batch string, files array<struct<file:string,rows:bigint>>"
    return spark.read.schema(kind).json(f"{path.rstrip('/')}/batches").select("batch", F.explode("files").alias("f")).select("batch", "f.*")


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that have been committed."""
    files = [f"{path.rstrip('/')}/{r['file']}" for r in batches(spark, path).select("file").collect()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


MEMORY_SCHEMA = "id string, memory string, source_url string, source_title string, confidence double, category string, type string, created_at double"


def memory_rows(facts: DataFrame, now: float) -> DataFrame:
    """Facts (``text, source_url, source_title, confidence, category``) as the memory keeps them; the id follows from the text, so a retried write has the same."""
    text = F.concat(F.col("text"), F.lit(" [Source: "), F.coalesce("source_url", F.lit("")), F.lit("]"))
    return facts.where("text is not null").select(
        F.substring(F.sha2(text, 256), 1, 16).alias("id"), text.alias("memory"), "source_url", "source_title", F.col("confidence").cast("double").alias("confidence"),
        "category", F.lit("knowledge_fact").alias("type"), F.lit(float(now)).alias("created_at"),
    )


def store_facts(facts: DataFrame, path: str, batch: str, now: float) -> int:
    """Writes facts to the memory, once a batch; how many that batch holds."""
    write_batch(memory_rows(facts, now), path, batch)
    return batches(facts.sparkSession, path).where(F.col("batch") == batch).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]


def memories(spark: SparkSession, path: str) -> DataFrame:
    """The memory: of each id what was written first."""
    rows = read_batches(spark, path, MEMORY_SCHEMA)
    return rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "id"]), "created_at").alias("x")).select("id", "x.*")
