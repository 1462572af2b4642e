"""Session plumbing shared by the operators: the shared folder, written intermediates, sizes of inputs."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import tempfile
import uuid
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 2000
#: Bytes of an Arrow batch, but for a single larger row.
ARROW_BYTES = 4 << 20
#: Bytes that a writer of an intermediate gathers in the heap.
ROW_GROUP = 16 << 20


def tune(spark: SparkSession) -> None:
    """Arrow batches small enough that a batch of long texts fits beside the JVM heap.

    Workers find this package where the driver found it, if they have no other copy.
    """
    root, env = str(Path(__file__).parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def trim() -> None:
    """Give freed memory back to the system, so that idle Python workers of an executor stay small."""
    pa.default_memory_pool().release_unused()
    if (c := _libc()) is not None and hasattr(c, "malloc_trim"):
        c.malloc_trim(0)


def trimming(make):
    """``make`` of a task's batches, after the last of which the worker, idle from then on, gives its memory back."""

    def run(batches):
        yield from make(batches)
        trim()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset (tests) a folder made here."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="trialspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, frees shuffle files."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets the context cleaner drop the finished job's shuffle files
    return spark.read.schema(schema).parquet(path)


def units(df: DataFrame, unit_bytes: int) -> int:
    """How many groups of about ``unit_bytes`` of stored input ``df`` has, from the plan's statistics.

    Plans without usable statistics (no files, or the default guess) are measured by a count of their rows.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 50:
        size = df.count() * 4096
    return max(8, math.ceil(size / unit_bytes))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names (in any case) an operator is about to add."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])
