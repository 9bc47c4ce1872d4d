"""What the operators share: tables by path, and tables written to the cluster's shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables

#: Arrow batches that go to Python hold at most so many bytes, however long the texts are.
BATCH_BYTES = "4m"
BATCH_ROWS = "2000"
_WRITES = itertools.count(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table; also bounds the Arrow batches of the session's Python stages."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """What operators begin with: small Arrow batches, and JVMs that give back what they do not need."""
    shrink(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shrink(spark: SparkSession) -> None:
    """Has the driver's and the executors' JVMs collect and return free heap, and the driver's its free native memory.

    Plans, task records and sort buffers of many small jobs grow a heap to its limit before it is collected; in an
    executor that leaves no room for the Python workers beside it.
    """
    n = spark.sparkContext.defaultParallelism
    spark._jvm.System.gc()
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()
    trim(spark)


def trim(spark: SparkSession) -> str | None:
    """Has the driver's JVM return the freed memory of its C library; what it says, or None where it can't.

    Compilers, codecs and buffers allocate outside the heap, on hundreds of threads.  What they free stays in the C
    library's arenas, which grow with the plans that are run and which no collection of the heap returns.  Java has
    the command since 17.0.9, on Linux.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    kind = jvm.java.lang.Class.forName
    names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    kinds, given = new(jvm.java.lang.Class, len(names)), new(jvm.java.lang.Object, len(names))
    for i, name in enumerate(names):
        kinds[i] = kind(name)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with contextlib.suppress(Py4JError):  # another JVM or C library
        # by reflection, as the server's own class is not public
        invoke = kind("javax.management.MBeanServer").getMethod("invoke", kinds)
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    return None


def give_back() -> None:
    """Returns freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives freed memory back, as it lives on beside the next stages'."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def written(df: DataFrame, label: str) -> DataFrame:
    """df, computed once and written to the shared folder, which is emptied when the application ends."""
    if next(_WRITES) % 5 == 0:
        shrink(df.sparkSession)
    else:
        trim(df.sparkSession)
    return tables.written(df, label)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of narrow rows, marked for broadcast where a count finds so few rows; else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def parts_of(df: DataFrame) -> int:
    """Partitions of the plan's scan: what later shuffles of the same volume are sized by."""
    return max(1, df.rdd.getNumPartitions())


def batches_of(rows: list[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches."""
    for at in range(0, len(rows), size):
        columns = list(zip(*rows[at : at + size]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
