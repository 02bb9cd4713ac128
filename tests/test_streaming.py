"""Streaming forms over small file streams."""

from pyspark.sql import functions as F

from sievework.streaming import events


def stream_of(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return df.sparkSession.table(name)


def test_first_seen(spark, tmp_path):
    s = stream_of(spark, tmp_path, [("a", 0), ("a", 1), ("b", 2)], "k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r["k"] for r in run(events.first_seen(s, "k", "ts"), "fs").collect()) == ["a", "b"]


def test_tumbling_counts(spark, tmp_path):
    rows = [("x", 0), ("x", 60), ("y", 60), ("x", 4000), ("x", 20000)]
    s = stream_of(spark, tmp_path, rows, "k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r["k"], r["n"]) for r in run(events.tumbling_counts(s, "ts", "k"), "tc", "append").collect()}
    assert got == {("x", 2), ("y", 1), ("x", 1)}
