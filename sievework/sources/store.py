"""The content store and the memory as tables: append, live view, delete, statistics, eviction.

A store is a folder with one folder a generation, ``g=0``, ``g=1``, ... of Parquet files. Rows are
appended to the latest generation. An eviction writes what stays as the next one, then drops
the older ones: a reader sees either, never half of one. There is one writer that evicts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STORE_SCHEMA = "id string, content string, content_type string, created_at double, expires_at double"


def store_rows(df: DataFrame, content: str, content_type: str, now: float, ttl: float) -> DataFrame:
    """Rows as stored; a ttl of 0 never expires. The id depends on the content alone, so that a retried write is the same."""
    ends = F.lit(float("inf")) if ttl == 0 else F.lit(now + ttl)
    c = F.col(content)
    return df.select(F.substring(F.sha2(c, 256), 1, 16).alias("id"), c.alias("content"), F.lit(content_type).alias("content_type"), F.lit(now).alias("created_at"), ends.alias("expires_at"))


def _generations(spark: SparkSession, path: str) -> tuple[object, list[int]]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    # a generation counts once its writer has finished; the first one is appended to from the start
    whole = [int(n[2:]) for n in names if n.startswith("g=") and (n == "g=0" or fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))]
    return fs, sorted(whole)


def _latest(spark: SparkSession, path: str) -> str:
    _, found = _generations(spark, path)
    return f"{path}/g={found[-1] if found else 0}"


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(_latest(rows.sparkSession, path))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each id, expired or not."""
    _, found = _generations(spark, path)
    rows = spark.read.schema(STORE_SCHEMA).parquet(f"{path}/g={found[-1]}") if found else spark.createDataFrame([], STORE_SCHEMA)
    return rows.groupBy("id").agg(F.max_by(F.struct("content", "content_type", "created_at", "expires_at"), "created_at").alias("x")).select("id", "x.*")


def live(spark: SparkSession, path: str, now: float) -> DataFrame:
    """The latest row of each id that hasn't expired."""
    return entries(spark, path).where(F.col("expires_at") >= now)


def lookup(spark: SparkSession, path: str, ids: DataFrame, now: float) -> DataFrame:
    """``id`` and the live content for each id asked for, null where there is none."""
    return ids.select("id").join(live(spark, path, now).select("id", "content", "content_type"), "id", "left")


def without(df: DataFrame, condition: Column) -> DataFrame:
    """What a delete leaves; rows for which the condition is unknown stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def stats(spark: SparkSession, path: str, now: float, max_size: int) -> dict[str, int]:
    """Entries held, those that have expired among them, and how many there may be."""
    got = entries(spark, path).agg(F.count("*").alias("size"), F.count_if(F.col("expires_at") < now).alias("expired")).first()
    return {"size": got["size"], "expired": got["expired"], "max_size": max_size}


def evict(spark: SparkSession, path: str, now: float, max_size: int | None = None) -> int:
    """Drops expired entries and, beyond ``max_size``, the oldest ones; the number of entries dropped."""
    fs, found = _generations(spark, path)
    if not found:
        return 0
    before, kept = entries(spark, path).count(), live(spark, path, now)
    if max_size is not None and (alive := kept.count()) > max_size:
        # the oldest that go are found by their times first; only entries of the last time to go are told apart by id
        times = kept.groupBy("created_at").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.orderBy("created_at"))
        edge = times.withColumn("upto", upto).where(F.col("upto") >= alive - max_size).orderBy("created_at").first()
        at_edge = max_size - (alive - edge["upto"])  # how many entries of the edge's time stay
        ties = kept.where(F.col("created_at") == edge["created_at"]).orderBy(F.desc("id")).limit(max(at_edge, 0))
        kept = kept.where(F.col("created_at") > edge["created_at"]).unionByName(ties)
    target = f"{path}/g={found[-1] + 1}"
    kept.write.mode("overwrite").parquet(target)
    after = spark.read.parquet(target).count()
    jvm = spark.sparkContext._jvm
    for old in found:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/g={old}"), True)
    return before - after


def evict_periodically(spark: SparkSession, path: str, clock: Callable[[], float], max_size: int | None = None, every: str = "300 seconds") -> StreamingQuery:
    """A stream whose only work is an eviction at each trigger; stop it as any other."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.trigger(processingTime=every).foreachBatch(lambda _, __: evict(spark, path, clock(), max_size)).start()
