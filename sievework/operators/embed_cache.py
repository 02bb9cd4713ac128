"""Embedding through a stored cache: each distinct text that the cache doesn't know is computed once.

The cache is a folder with one folder a batch, of rows ``h, embedding``; ``h`` are the first 16 digits of the text's SHA-256. A
run joins its texts with the cache by ``h``, computes what is missing, in batches of texts, and writes it as its own batch, which readers
see when its writer has finished. A batch that has been written isn't computed again (its name stands for its texts), half a batch
is replaced, and what two batches hold twice is read once. So a run can be repeated from any point.

A text that the model fails on (after its batch has failed it is tried alone) is not stored; its vector is zero in the
result, and the next run tries it again. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.joins import joined_by_key
from sievework.plans.providers import embed

Model = Callable[[list[str]], list[list[float]]]
SCHEMA = "h string, embedding array<double>"


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


class EmbeddingCache:
    def __init__(self, spark: SparkSession, path: str, model: Model, dims: int, batch_size: int = 50) -> None:
        self.spark, self.path, self.model, self.dims, self.batch_size = spark, path.rstrip("/"), model, dims, batch_size

    def _batches(self) -> list[str]:
        """Folders of batches whose writer has finished."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(f"{self.path}/{n}" for n in names if n.startswith("batch=") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def known(self) -> DataFrame:
        """``h, embedding``, each text once."""
        found = self._batches()
        if not found:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*found)
        return rows if len(found) == 1 else rows.groupBy("h").agg(F.min("embedding").alias("embedding"))

    def misses(self, texts: DataFrame, text: str) -> DataFrame:
        """``h, text`` of the distinct texts that aren't stored."""
        hashed = texts.select(text_hash(F.col(text)).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        # one row a hash before texts move: the least text stands for the hash
        return hashed.join(self.known().select("h"), "h", "left_anti").groupBy("h").agg(F.first("text").alias("text"))

    def fill(self, texts: DataFrame, text: str, batch: str) -> int:
        """Computes and stores what is missing, as the batch of that name; the number of vectors stored."""
        where = f"{self.path}/batch={batch}"
        if where in self._batches():  # written before: what it holds is known
            return 0
        made = embed(self.misses(texts, text), "h", "text", self.model, self.batch_size).where("embedding is not null")
        made.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(SCHEMA).parquet(where).count()

    def embed(self, texts: DataFrame, text: str, batch: str) -> DataFrame:
        """``texts`` with ``hit`` (stored before this run) and ``embedding``; what is missing is computed first."""
        before = [b for b in self._batches() if not b.endswith(f"/batch={batch}")]
        self.fill(texts, text, batch)
        old = self.spark.read.schema(SCHEMA).parquet(*before).select("h").distinct() if before else self.spark.createDataFrame([], "h string")
        stored = self.known().join(old.withColumn("hit", F.lit(True)), "h", "left")
        met = joined_by_key(texts.withColumn("h", text_hash(F.col(text))), stored, "h")
        zeros = F.array_repeat(F.lit(0.0), self.dims)
        return met.withColumns({"hit": F.coalesce("hit", F.lit(False)), "embedding": F.coalesce("embedding", zeros)}).drop("h")
