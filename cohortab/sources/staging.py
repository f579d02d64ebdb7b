"""Tables written once and read again.

A report computes its aggregated counts once, writes them to the folder that
driver and executors share, and takes ranks, arms, denominators and cells from
the written table. The facts are read once however many parts of the report need
the counts, and executors lost later cost no second pass. Only aggregated tables
are written (rows per label and arm, not per event).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); a local one only where unset (tests).

    Without a shared folder only a local master will do: executors on other
    machines would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cohortab-stage-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def staged(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the written table.

    A table that is one already comes back as it is. The files go when the
    application ends, or earlier by ``discard``.
    """
    if getattr(df, "_staged_at", None):
        return df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    at, fs = _files(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(table: DataFrame) -> None:
    """Remove the files of a staged table that nothing will read again."""
    at, fs = _files(table.sparkSession, table._staged_at)
    fs.delete(at, True)


def stored_bytes(table: DataFrame) -> int:
    """Size of a staged table's files."""
    at, fs = _files(table.sparkSession, table._staged_at)
    return fs.getContentSummary(at).getLength()
