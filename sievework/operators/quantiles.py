"""Exact quantiles without a group's values in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, group: str, value: Column, at: dict[str, float]) -> DataFrame:
    """``group`` and a column for each share in ``at``: quantiles with linear interpolation, nulls left out.

    Equal values meet as counts first; what a group then has to order are its distinct
    values, by a sort that spills, while an aggregate would hold them all.
    """
    counts = df.select(group, value.cast("double").alias("__v")).where("__v is not null").groupBy(group, "__v").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(group)
    ranked = counts.withColumns({"__upto": F.sum("__n").over(w.orderBy("__v")), "__all": F.sum("__n").over(w)})
    sides = []
    for name, share in at.items():
        place = F.lit(share) * (F.col("__all") - 1)
        sides += [F.min(F.when(F.col("__upto") > side(place), F.col("__v"))).alias(f"__{name}_{k}") for k, side in enumerate((F.floor, F.ceil))]
    found = ranked.groupBy(group).agg(F.first("__all").alias("__all"), *sides)

    def between(name: str, share: float) -> Column:
        place = F.lit(share) * (F.col("__all") - 1)
        low, high = F.col(f"__{name}_0"), F.col(f"__{name}_1")
        return (low + (high - low) * (place - F.floor(place))).alias(name)

    return found.select(group, *(between(name, share) for name, share in at.items()))
