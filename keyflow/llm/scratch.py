"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only where it is unset and all runs in one process (tests) a local folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keyflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Named Parquet tables of one operator call.

    A table cuts the lineage and survives lost executors, as all executors reach the folder. ``drop`` removes a
    table that no later plan reads; what is left goes when the session ends.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def save(self, name: str, df: DataFrame, compression: str | None = None) -> DataFrame:
        """Small tables become few files: the shuffle's partitions are joined up to the advisory size. ``compression``: of the files, else the session's."""
        path = f"{self.root}/{name}"
        setting = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
        before = self.spark.conf.get(setting, "true")
        self.spark.conf.set(setting, "false")
        try:
            df.write.mode("overwrite").parquet(path, compression=compression)
        finally:
            self.spark.conf.set(setting, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the session has ended already
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, name: str) -> str:
    """A name for a column that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, where the session has Spark's default of 10,000: ten thousand texts can fill a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) == 10_000:
        spark.conf.set(name, str(rows))


#: Of the JVM's heap, the share in percent that may be free after a collection that gives memory back; the least one comes first.
FREE = {"MinHeapFreeRatio": "5", "MaxHeapFreeRatio": "10"}


def release(spark: SparkSession) -> None:
    """Gives back what the driver's Python and JVM hold but don't use, between the steps of a long job.

    A JVM keeps up to 70 % of its heap free after a collection, and what its compiler has freed; the first is lowered for this
    collection alone, the second handed back. Where a JVM can't do either, it only collects.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    jvm = spark.sparkContext._jvm
    beans, find = jvm.java.lang.management.ManagementFactory, jvm.java.lang.Class.forName
    before: dict[str, str] = {}
    try:
        options = beans.getPlatformMXBean(find("com.sun.management.HotSpotDiagnosticMXBean"))
        before = {name: options.getVMOption(name).getValue() for name in FREE}
        for name, share in FREE.items():
            options.setVMOption(name, share)
    except (Py4JError, AttributeError):  # another JVM
        pass
    try:
        jvm.java.lang.System.gc()
    finally:
        for name in reversed(before):
            options.setVMOption(name, before[name])
    try:
        _invoke(spark, "com.sun.management:type=DiagnosticCommand", "systemTrimNativeHeap")
    except Py4JError:  # another JVM, or an older one
        pass


def _invoke(spark: SparkSession, bean: str, operation: str) -> str:
    """Calls an operation without arguments of a bean of the driver's JVM, by the interface, as the server's own class is hidden."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    named, find = jvm.javax.management.ObjectName(bean), jvm.java.lang.Class.forName
    kinds = array(jvm.java.lang.Class, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = find(name)
    values = array(jvm.java.lang.Object, 4)
    for k, value in enumerate((named, operation, array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0))):
        values[k] = value
    return find("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
