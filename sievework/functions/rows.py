"""Rows of array elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, keep: list[str | Column], array: Column | str, value: str, pos: str | None = None) -> DataFrame:
    """The columns ``keep`` with a row per element of ``array`` that isn't null: ``value``, and its place ``pos`` (bigint) if asked for.

    Outer, then filtered: of an inner generator the optimizer derives a filter on the array's size below it,
    which evaluates an expensive array once more.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias("__pos", value)).where(F.col("__pos").isNotNull() & F.col(value).isNotNull())
    if pos is None:
        return rows.drop("__pos")
    at = rows.columns.index("__pos")
    names = [c for c in rows.columns if c != "__pos"]
    names.insert(at, "__pos")
    return rows.select(*(F.col("__pos").cast("bigint").alias(pos) if c == "__pos" else c for c in names))
