"""Session-wide helpers: reading tables, cutting lineage, checking sizes before a broadcast."""

from __future__ import annotations

import io
import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Estimated bytes up to which a side may be broadcast.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or the one set on the context; a temporary one only for a local master
    without either (tests). A cluster without a shared folder raises: its executors have no disk in common."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "quillon-checkpoints")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared checkpoint folder and read again: its lineage is cut, and it survives the loss
    of executors. Unlike checkpoint() it is computed once, and later joins plan with its true size (a checkpoint keeps
    the estimate of its plan, which multiplies with every round of an iteration). Removed by drop, or when the
    application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/quillon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, target = _path(spark, path)
    fs.deleteOnExit(target)  # registers only what is there already
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Removes tables that cut wrote, once nothing that is still to run reads them; other frames are left alone."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path:
            fs, target = _path(df.sparkSession, path)
            fs.delete(target, True)


def ship(spark: SparkSession) -> str:
    """Sends this package to the workers of a cluster on which it isn't installed, by way of the shared folder."""
    root = pathlib.Path(__file__).resolve().parents[1]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    path = f"{checkpoint_dir(spark)}/quillon-{uuid.uuid4().hex}.zip"
    fs, target = _path(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    fs.deleteOnExit(target)
    spark.sparkContext.addPyFile(path)
    return path


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the size estimate is proven under limit; else leave the join to shuffle."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows for the driver, refusing more than limit rather than dropping any."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; raise the documented bound")
    return rows
