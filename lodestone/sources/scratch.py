"""Intermediate tables that several parts of a plan read, in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def folder(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder; deleted when the process ends."""
    path = f"{shared_dir(spark)}/lodestone-{label}-{uuid.uuid4().hex[:12]}"
    atexit.register(_drop, spark, path)
    return path


def keep(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, written once and read by whatever follows; deleted when the process ends."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
