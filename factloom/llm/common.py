"""Shared plumbing of the corpus operators: scratch tables, Arrow helpers and skew-safe joins."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import storage

#: A broadcast side is only used when its construction bounds it to so many rows.
BROADCAST_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else one of our own (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return found.rstrip("/") if found else storage.shared_dir(spark)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends, if not before."""
    path = f"{shared_dir(spark)}/factloom-{what}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, through Hadoop or, once the session has stopped, directly."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the gateway may be gone at interpreter exit
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file:").replace("//", "/", 1), ignore_errors=True)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._factloom_path = path
    return out


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path if ":/" in path else "file://" + path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for table in tables:
        remove(table.sparkSession, table._factloom_path)


def release(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of finished jobs now: its cleaner acts when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Give freed memory back to the system: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def longs(values: np.ndarray) -> pa.Array:
    """64-bit words as signed longs, bit for bit."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def attach(left: DataFrame, right: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """Left join to a table with unique keys in which column ``rows`` counts the left rows of each key.

    Keys that hold more than 1/1000 of all rows are at most 1000, so they are broadcast; their rows
    take part in no shuffle.  All others go through an ordinary join.  ``left`` and ``right`` must be
    cheap to scan twice (tables).  Rows with a null key keep null columns.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot_rows = F.col(rows) > max(total // BROADCAST_ROWS, 10_000)
    extra = [c for c in right.columns if c not in keys]
    if right.filter(hot_rows).limit(1).count() == 0:
        return left.join(right, keys, "left")
    hot = right.filter(hot_rows)
    marks = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    split = left.join(marks, keys, "left")
    cold = split.filter("_hot is null").drop("_hot").join(right.filter(~hot_rows), keys, "left")
    warm = left.join(F.broadcast(hot), keys, "inner")
    names = [*[c for c in left.columns], *extra]
    return cold.select(*names).unionByName(warm.select(*names))
