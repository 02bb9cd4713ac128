"""Timed state on streams: bounded, restartable, late rows."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from sievework.streaming import state

UTC = datetime.UTC


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield state.with_rocksdb(spark)
    spark.conf.set(name, before)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(df, out, checkpoint):
    q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return [json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress]


def at(seconds):
    """Some time after the epoch, where the watermark starts."""
    return datetime.datetime.fromtimestamp(1000 + seconds, UTC).replace(tzinfo=None)


def plain_limiter(rows, most, window):
    out, passed = [], {}
    for key, t, tie in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        held = [p for p in passed.get(key, []) if t - p < window]
        ok = len(held) < most
        passed[key] = held + [t] * ok
        out.append((key, t, tie, ok))
    return sorted(out)


SCHEMA = "k string, ts timestamp, id long"


def test_limiter_restarts_and_forgets(rocks, tmp_path):
    src, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "c"
    first = [("u", 0.0, 1), ("u", 0.0, 2), ("u", 0.0, 3), ("v", 1.0, 4), ("u", 9.0, 5)]
    second = [("u", 10.5, 6), ("u", 11.0, 7), ("u", 11.0, 8), ("w", 12.0, 9)]
    stream = lambda: state.rate_limited(rocks.readStream.schema(SCHEMA).parquet(str(src)), "k", "ts", "id", 2, 10.0, "5 seconds")
    put(rocks, src, [(k, at(t), i) for k, t, i in first], SCHEMA)
    run(stream(), out, checkpoint)
    put(rocks, src, [(k, at(t), i) for k, t, i in second], SCHEMA)
    run(stream(), out, checkpoint)  # a new query, from the checkpoint
    got = sorted((r["key"], r["ts"], r["tie"], r["allowed"]) for r in rocks.read.parquet(str(out)).collect())
    assert [(k, i, ok) for k, _, i, ok in got] == [(k, i, ok) for k, _, i, ok in plain_limiter(first + second, 2, 10.0)]
    # many keys go away: a much later row moves the watermark, and their timers fire
    put(rocks, src, [(f"k{j}", at(20.0), 100 + j) for j in range(50)], SCHEMA)
    run(stream(), out, checkpoint)
    put(rocks, src, [("z", at(100_000.0), 900)], SCHEMA)
    run(stream(), out, checkpoint)
    put(rocks, src, [("late", at(30.0), 901), ("z", at(100_001.0), 902)], SCHEMA)
    progress = run(stream(), out, checkpoint)
    rows = {r["tie"] for r in rocks.read.parquet(str(out)).collect()}
    assert 902 in rows and 901 not in rows  # behind the watermark
    held = [op["numRowsTotal"] for p in progress for op in p["stateOperators"]]
    assert held[-1] <= 6  # of over fifty keys only the last one's numbers and timer are left


def test_entries_expire(rocks, tmp_path, request):
    # by the clock there is always another batch to run: an availableNow query would not end
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    rocks.conf.set(name, "false")
    request.addfinalizer(lambda: rocks.conf.unset(name))
    src, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "c"
    schema = "k string, entry string, op string, id long"
    stream = lambda: state.listed_with_ttl(rocks.readStream.schema(schema).parquet(str(src)), "k", "entry", "op", "id", 15_000)
    put(rocks, src, [("a", "x", "set", 1), ("a", "x", "ask", 2), ("a", "y", "ask", 3), ("b", "x", "ask", 4)], schema)
    run(stream(), out, checkpoint)
    set_at = time.time()
    got = {r["tie"]: (r["listed"], r["asked"]) for r in rocks.read.parquet(str(out)).collect()}
    assert got == {2: (True, 1), 3: (False, 2), 4: (False, 1)}
    time.sleep(max(0.0, 16.0 - (time.time() - set_at)))
    put(rocks, src, [("a", "x", "ask", 5)], schema)
    run(stream(), out, checkpoint)
    got = {r["tie"]: (r["listed"], r["asked"]) for r in rocks.read.parquet(str(out)).where(F.col("tie") == 5).collect()}
    assert got == {5: (False, 3)}
