"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names; a folder of the test machine where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table; one that is gone already is no error."""
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _forget(spark: SparkSession, name: str) -> None:
    """Take a table's name out of the catalog."""
    with contextlib.suppress(Exception):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once an application."""
    if (app := spark.sparkContext.applicationId) in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="lodestone-code-")) / "lodestone_code.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


class Scratch:
    """Tables of one operator call. ``keep`` writes a DataFrame and returns it as a scan of what was written.

    The written table cuts the lineage: a lost executor costs its running tasks, not earlier stages.
    Shuffle files of the writing job are removed when it ends. ``drop`` deletes tables that later steps
    no longer read; the rest go when the Python process ends, as the result that is returned may read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}
        ship(spark)

    def keep(self, df: DataFrame, label: str, parts: int | None = None) -> DataFrame:
        """``df`` as a table, in at most so many files where ``parts`` is given: a small table in many files costs more than its rows."""
        spark = self.spark
        df = df.coalesce(parts) if parts else df
        path = f"{shared_dir(spark)}/lodestone-{self.name}-{label}-{uuid.uuid4().hex[:12]}"
        before = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(CLEANUP, before)
        atexit.register(drop, spark, path)
        out = spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def keep_by(self, df: DataFrame, column: str, parts: int, label: str) -> DataFrame:
        """``df`` written by the hash of a column, so that later groups by it read their rows without a shuffle.

        At least as many parts as the session's shuffles have, else a plan would deal the rows anew.
        """
        spark = self.spark
        parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
        name = f"lodestone_{self.name}_{label}_{uuid.uuid4().hex[:12]}"
        path = f"{shared_dir(spark)}/{name}"
        before = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            df.repartition(parts, column).write.bucketBy(parts, column).option("path", path).option("compression", "zstd").saveAsTable(name)
        finally:
            spark.conf.set(CLEANUP, before)
        atexit.register(drop, spark, path)
        atexit.register(_forget, spark, name)
        return spark.table(name)

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if found := self.paths.pop(id(df), None):
                drop(self.spark, found[1])
