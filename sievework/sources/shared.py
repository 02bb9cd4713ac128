"""The folder that all executors share, and tables written below it."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode without one, a temporary folder of the session."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark, "_sievework_shared", None)
    if made is None:
        made = spark._sievework_shared = "file://" + tempfile.mkdtemp(prefix="sievework-")
    return made


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table: its lineage is cut, and lost executors start from the files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> str:
    """Names a file table's state: its files with their sizes and times of change. No column is read."""
    files = df.select(*(F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time"))).distinct()
    row = files.select(F.xxhash64("*").alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(str(tuple(row)).encode()).hexdigest()[:16]
