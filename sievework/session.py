"""Session helpers shared by the bench, the tests and the entry module."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sievework", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the queries expect (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SIEVEWORK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


#: Tables whose rows are texts: work on a row costs far more than moving it.
TEXT_TABLES = ("documents", "pages")
#: Bytes of a file below which the scan alone can't occupy a core.
SPLIT_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``.

    A small table of texts may be one row group, and so one task: it is spread over the cores. A table
    with a few megabytes for each core is read as it lies.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name not in TEXT_TABLES:
        return df
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if SPLIT_BYTES // 16 < size < SPLIT_BYTES * cores else df
