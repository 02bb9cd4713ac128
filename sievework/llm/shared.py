"""Tables that several jobs of one operator read, in the folder all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Row, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode without one, a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark, "_sievework_dir", None)
    if made is None:
        made = spark._sievework_dir = "file://" + tempfile.mkdtemp(prefix="sievework-")
    return made


#: Bytes of an Arrow batch while tables are written: each task holds one on either side.
BATCH_BYTES = 8 << 20


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def _trim_native_heap(spark: SparkSession) -> None:
    """The JVM's diagnostic command of that name, by the public interface of its management server."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    types, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[k] = jvm.java.lang.Class.forName(name)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    method = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types)
    method.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


class Tables:
    """Writes tables and drops those that are no longer needed.

    A written table cuts the lineage: when an executor is lost, what read it
    starts from the files. The table behind a returned frame stays.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        with _small_batches(self.spark):
            df.write.mode("overwrite").parquet(path)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def collect(self, df: DataFrame) -> list[Row]:
        """The rows of a result that doesn't grow with the input, such as sums, over tables of large rows."""
        with _small_batches(self.spark):
            return df.collect()

    def release(self) -> None:
        """Lets the context cleaner see that the shuffles of finished jobs are unreachable, so that their files go now and not at the driver's next collection.

        What the driver's many short threads leave in the native heap goes back as well, where the JVM has a command for that.
        """
        gc.collect()
        jvm = self.spark.sparkContext._jvm
        jvm.System.gc()
        with suppress(Py4JError):
            _trim_native_heap(self.spark)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
