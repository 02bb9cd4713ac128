"""Order-dependent state per key, replayed over sorted partitions.

Rows are partitioned by key and sorted; one pass keeps the state of the key at
hand only, so a key may have any number of rows. The state of a key depends on all its rows in
order, so the rows of one key are one task's work by nature: what a row costs is a few
list operations, and only the columns that the step reads leave Arrow.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARROW = {"boolean": pa.bool_(), "bigint": pa.int64()}


def replay(df: DataFrame, key: str, order: list[str], out: str, kind: str, reads: list[str], fresh: Callable[[], Callable]) -> DataFrame:
    """Adds column ``out`` (type ``kind``): what the key's step function (made by ``fresh``) returns for the columns ``reads`` of each row in order."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{out}` {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = object(), None
        for batch in batches:
            got = []
            for k, *values in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in reads), strict=True):
                if k != now:
                    now, step = k, fresh()
                got.append(step(*values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, ARROW[kind])], names=[*batch.schema.names, out])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def rate_limiter(most: int, window: float) -> Callable[[], Callable[[float], bool]]:
    """A request (at ``t`` seconds) is let through if fewer than ``most`` let-through ones lie within the window."""

    def fresh() -> Callable[[float], bool]:
        passed: deque[float] = deque()

        def step(t: float) -> bool:
            while passed and t - passed[0] >= window:
                passed.popleft()
            if len(passed) >= most:
                return False
            passed.append(t)
            return True

        return step

    return fresh


class LruCache:
    """Keys with the time they end, least recently used first. A full cache drops the oldest entry, be others expired or not."""

    def __init__(self, size: int, ttl: float) -> None:
        self.size, self.ttl = size, ttl
        self.held: OrderedDict[str, float] = OrderedDict()

    def get(self, key: str, t: float) -> bool:
        """Whether the key is there and alive; it counts as used then, and goes if it has expired."""
        ends = self.held.get(key)
        if ends is None or t > ends:
            self.held.pop(key, None)
            return False
        self.held.move_to_end(key)
        return True

    def set(self, key: str, t: float) -> None:
        if key not in self.held and len(self.held) >= self.size:
            self.held.popitem(last=False)
        self.held[key] = t + self.ttl
        self.held.move_to_end(key)

    def delete(self, key: str) -> bool:
        """Whether the key was there, alive or not."""
        return self.held.pop(key, None) is not None

    def stats(self) -> dict[str, int]:
        return {"size": len(self.held), "max_size": self.size}


def lru_cache(size: int, ttl: float) -> Callable[[], Callable[[str, str, float], bool | None]]:
    """Steps ``(op, key, t)``: get and delete say whether the key was found, set gives null."""

    def fresh() -> Callable[[str, str, float], bool | None]:
        cache = LruCache(size, ttl)

        def step(op: str, key: str, t: float) -> bool | None:
            if op == "get":
                return cache.get(key, t)
            return cache.delete(key) if op == "delete" else cache.set(key, t)

        return step

    return fresh


def lru_size(size: int, ttl: float) -> Callable[[], Callable[[str, str, float], int]]:
    """Steps as of ``lru_cache`` that say how many entries the cache then holds."""

    def fresh() -> Callable[[str, str, float], int]:
        cache = LruCache(size, ttl)

        def step(op: str, key: str, t: float) -> int:
            {"get": cache.get, "set": cache.set}[op](key, t) if op != "delete" else cache.delete(key)
            return cache.stats()["size"]

        return step

    return fresh


def seconds(ts: str):
    """A timestamp without zone as epoch seconds in UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000
