"""Tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else (tests, local mode) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.conf.get("factloom.local.scratch", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("factloom.local.scratch", own)
    return own


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in folders by the values of ``by``; it goes when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/factloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, df.sparkSession, path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a table; a stopped session leaves nothing to delete with."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the gateway may be gone at interpreter exit
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file:").replace("//", "/", 1), ignore_errors=True)
