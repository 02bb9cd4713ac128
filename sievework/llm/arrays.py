"""Array expressions shared by the native operators (no Python on executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def running_sum(values: Column) -> Column:
    """Inclusive prefix sums of an array<bigint>, in log2(size) whole-array passes.

    A fold that appends one element a step copies its result each time, which is
    quadratic; this doubles the covered distance with each pass instead.
    """
    passes = F.when(F.size(values) < 2, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int"))
    )

    def one_pass(acc: Column, j: Column) -> Column:
        return F.transform(
            acc,
            lambda x, i: x + F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), j)), F.lit(0).cast("bigint")),
        )

    return F.aggregate(passes, values, one_pass)
