"""Watching files as a stream: settling, change capture by digest, and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.ordered import Ranges, ordinary

# Seconds without a change before a file is read, writes a second, poll seconds, and the seconds without a change after which each next one holds.
SETTLE_S, WRITES_PER_S, POLL_S, QUIET_S, COST_FACTOR = 1.0, 5, (2, 10, 60), (120, 1800), 50


def settled(changes: DataFrame, gap_s: float = SETTLE_S) -> DataFrame:
    """(path, ts, n): the last of every run of changes whose gaps are shorter than gap_s, and the run's length."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    far = F.col("before").isNull() | ~F.col("before.path").eqNullSafe(F.col("path")) | (us("ts") - us("before.ts") >= int(gap_s * 1e6))
    rows = changes.select("path", "ts", "seq")
    if ordinary(rows, "path"):
        order = Window.partitionBy("path").orderBy("ts", "seq")
        marked = rows.withColumn("before", F.lag(F.struct("path", "ts")).over(order)).withColumn("far", far.cast("long"))
        runs = marked.withColumn("run", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        ranges = Ranges(rows, ["path", "ts", "seq"]).previous(["path", "ts"], "before")
        runs = ranges.running(far.cast("long"), "sum", "run").table()
    return runs.groupBy("path", "run").agg(F.max("ts").alias("ts"), F.count("*").alias("n")).select("path", "ts", "n")


def write_slots(writes: DataFrame, per_second: int = WRITES_PER_S) -> DataFrame:
    """Writes (bucket, seq) with the second, from the bucket's start, at which the limit lets each go; none is dropped."""
    if ordinary(writes, "bucket"):
        place = F.row_number().over(Window.partitionBy("bucket").orderBy("seq"))
        return writes.withColumn("delay_s", F.floor((place - 1) / per_second).cast("long"))
    ranges = Ranges(writes, ["bucket", "seq"]).previous(["bucket"], "before").running(F.lit(1), "sum", "row")
    first = F.col("before").isNull() | ~F.col("before.bucket").eqNullSafe(F.col("bucket"))
    out = ranges.running(F.when(first, F.col("row")), "max", "start").table()
    return out.withColumn("delay_s", F.floor((F.col("row") - F.col("start")) / per_second).cast("long")).drop("before", "row", "start")


def poll_interval(cost_s: float, quiet_s: float) -> float:
    """Seconds to the next poll: longer the longer nothing has changed, and never above 1 / COST_FACTOR of a core."""
    base = POLL_S[sum(quiet_s >= s for s in QUIET_S)]
    return float(min(POLL_S[-1], max(base, cost_s * COST_FACTOR)))


def _track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")  # what one trigger brings of one path
    before = rows.digest.shift(1)
    if state.exists:
        before.iloc[0] = state.get[0]
    same = (rows.digest == before) | (rows.digest.isna() & before.isna())
    status = np.where(same, "unchanged", "changed")
    if not state.exists:
        status[0] = "added"
    last = rows.digest.iloc[-1]
    state.update((None if pd.isna(last) else last,))
    yield pd.DataFrame({"path": key[0], "seq": rows.seq, "digest": rows.digest, "status": status})


def in_order(spark: SparkSession, folder: str) -> None:
    """Give the files of a folder times in the order of their names, the order in which a stream takes them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath().getName(), f.getPath(), f.getModificationTime()) for f in fs.listStatus(p) if f.getPath().getName().startswith("part-"))
    for n, (_, path, _) in enumerate(files):
        fs.setTimes(path, min(f[2] for f in files) - 1000 * (len(files) - n), -1)


def capture(stream: DataFrame) -> DataFrame:
    """(path, seq, digest, status) of a stream of observations; the state of a path is its last digest.

    Rows of a trigger are taken in the order of seq. What came in earlier triggers counts as earlier.
    """
    return stream.groupBy("path").applyInPandasWithState(_track, "path string, seq long, digest string, status string", "digest string", "append", GroupStateTimeout.NoTimeout)


def capture_all(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, files_per_trigger: int = WRITES_PER_S) -> DataFrame:
    """Run the capture over the files that are there and return what it wrote; a restart goes on from the checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    query = capture(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def _quiet(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, gap_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        last, n = state.get
        state.remove()
        yield pd.DataFrame({"path": [key[0]], "ts": [pd.Timestamp(last, unit="us")], "n": [n]})
        return
    last, n = state.get if state.exists else (None, 0)
    out = []
    for us in sorted(int(t.value // 1000) for b in batches for t in b.ts):
        if last is not None and us - last >= gap_ms * 1000:
            out.append((key[0], pd.Timestamp(last, unit="us"), n))
            n = 0
        last, n = max(us, last or us), n + 1
    state.update((last, n))
    state.setTimeoutTimestamp(max(last // 1000 + gap_ms, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["path", "ts", "n"])


def settle_stream(changes: DataFrame, gap_s: float = SETTLE_S, late: str = "0 seconds") -> DataFrame:
    """(path, ts, n) as ``settled`` gives it, of a stream of changes (path, ts): a run goes out when the watermark has
    passed its last change by the gap. The state of a path is the last change and the run's length."""
    def run(key, batches, state):
        return _quiet(key, batches, state, int(gap_s * 1000))

    marked = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy("path").applyInPandasWithState(run, "path string, ts timestamp, n long", "last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
