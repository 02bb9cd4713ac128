"""Equi-joins whose hot keys never meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the other side that are broadcast (some hundred bytes each).
BROADCAST_ROWS = 100_000
#: Beyond that, a key counts as hot from this share of all rows on: so there are at most as many hot keys.
HOT_KEYS = 10_000


def joined_by_key(rows: DataFrame, other: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` with the one row of ``other`` that has their ``key``, or with nulls.

    ``other`` (its keys are distinct) is broadcast if it has few rows. Else the rows of hot keys, which are at most ``HOT_KEYS`` by their
    definition, are broadcast alone, and all others are joined by a shuffle, in which no key has more
    than one row in ``HOT_KEYS``.
    """
    if other.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(other), key, how)
    counts = rows.groupBy(key).agg(F.count("*").alias("__n"))
    least = max(2, -(-rows.count() // HOT_KEYS))
    hot = other.join(F.broadcast(counts.where(F.col("__n") >= least).select(key)), key, "left_semi")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(other, key, how))
