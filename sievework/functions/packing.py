"""Packing of array elements into consecutive parts, without a fold that copies what it has so far.

A part ends where a running total passes a bound, so where each place's part would end is found by binary search in the prefix
sums. The parts that really occur are those reached from the first place: that is found by pointer jumping, in
which each pass doubles the distance covered. All is n log n in the number of elements, and holds a few arrays of numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once: it is a lambda's argument there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _passes(n: Column) -> Column:
    """0 .. ceil(log2(n)) for n > 0."""
    return F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"))


def prefix_sums(values: Column) -> Column:
    """``[0, v0, v0 + v1, ...]``: one more than there are values."""
    start = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(values, lambda v: v.cast("bigint")))

    def doubled(acc: Column, j: Column) -> Column:
        return F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), j)), F.lit(0).cast("bigint")))

    return F.aggregate(_passes(F.size(values) + 1), start, doubled)


def halvings(n: Column) -> Column:
    """Powers of two from the largest that may be needed for ``n`` places down to 1."""
    top = F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")
    return F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda j: F.call_function("shiftleft", F.lit(1), j))


def first_above(ascending: Column, x: Column, steps: Column | None = None) -> Column:
    """The first place of an ascending array that holds more than ``x``; the array's size if there is none. ``steps``: its ``halvings``, if known."""
    steps = halvings(F.size(ascending)) if steps is None else steps

    def search(x: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda lo, step: lo + F.when(F.get(ascending, lo + step - 1) <= x, step).otherwise(0))

    return bound(x, search)


def reached(following: Column, n: Column) -> Column:
    """The places reached from 0 by ``following`` (place -> later place, ``n`` at the end), ascending, ``n`` among them."""
    start = F.struct(F.array(F.lit(0)).alias("at"), F.concat(following, F.array(n)).alias("jump"))

    def further(s: Column, _: Column) -> Column:
        more = F.filter(F.transform(s["at"], lambda i: F.get(s["jump"], i)), lambda i: i < n)
        return F.struct(F.concat(s["at"], more).alias("at"), F.transform(s["jump"], lambda i: F.get(s["jump"], i)).alias("jump"))

    return F.aggregate(_passes(n), start, further, lambda s: F.concat(s["at"], F.array(n)))


def packed(values: Column, weight: Callable[[Column], Column], ends: Callable[..., Column], begins: Callable[..., Column], joiner: str) -> Column:
    """The parts of an array of texts, each joined by ``joiner``.

    ``weight``: what an element adds to the running total. ``ends(above, sums, i)``: where the part that opens at place ``i`` ends, if
    it may end right after ``i``. ``begins(above, sums, i)``: where that part begins (before ``i``, if parts overlap). ``above(x)``: the
    first place whose prefix sum is more than ``x``.
    """

    def parts(v: Column) -> Column:
        n = F.size(v)
        places = F.sequence(F.lit(0), n - 1)

        def cut(sums: Column, steps: Column) -> Column:
            above = lambda x: first_above(sums, x, steps)
            following = F.transform(places, lambda i: F.greatest(i + 1, F.least(ends(above, sums, i), n)))
            part = lambda lo, hi: bound(lo, lambda b: F.array_join(F.slice(v, b + 1, hi - b), joiner))
            return bound(reached(following, n), lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda i, k: part(begins(above, sums, i), F.get(at, k + 1))))

        sums = prefix_sums(F.transform(v, weight))
        return F.when(n > 0, bound(sums, lambda sums: bound(halvings(n + 1), lambda steps: cut(sums, steps)))).otherwise(F.array().cast("array<string>"))

    return bound(values, parts)
