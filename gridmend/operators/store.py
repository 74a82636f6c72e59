"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small table that may be broadcast; a row holds some hundred bytes.
BROADCAST_ROWS = 100_000
_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, the
    warehouse on a cluster, and a temporary folder only when everything is one local JVM."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        if not _local_dir:
            _local_dir.append(tempfile.mkdtemp(prefix="gridmend-"))
            atexit.register(shutil.rmtree, _local_dir[0], ignore_errors=True)
        return f"file://{_local_dir[0]}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stash"


def stash(df: DataFrame) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back. Unlike a cached or locally
    checkpointed frame this survives lost executors, and later reads prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridmend/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def drop_stash(df: DataFrame) -> None:
    """Delete a stashed table that no live plan reads any more."""
    spark, path = df.sparkSession, getattr(df, "_stash_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has no more than ``rows`` rows, which is counted; a larger one is left to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
