"""Minimax contiguous sharding: the smallest capacity that lets ordered atomic groups fill the shards.

Groups stand in the order of a 64-bit key. Whether a capacity is feasible is checked greedily: fill a shard until
the next group would exceed the capacity, cut there, go on. The smallest feasible capacity is found by binary
search. The driver holds no group list: it sees sizes of key ranges, searches once as if ranges could not be cut
(an upper bound) and once as if they could be cut anywhere (a lower bound), and asks for finer ranges only where
a cut may fall, until both bounds meet on ranges of single groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch

#: Key bits of the first ranges and of each refinement.
FIRST_BITS, MORE_BITS = 12, 6
SIGN = -(2**63)
#: Rows that are numbered together within a shard.
SLOT_ROWS = 100_000


class _Ranges:
    """Key ranges in order: (shift, prefix) names the keys with ``key >> shift == prefix``."""

    def __init__(self, rows):
        rows = sorted(rows, key=lambda r: r[1] << r[0])
        self.rows = rows
        self.size = np.array([r[2] for r in rows], dtype=np.int64)
        self.single = np.array([r[3] == 1 for r in rows], dtype=bool)
        self.end = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.total = int(self.end[-1])

    def cuts(self, capacity: int, shards: int, fluid: bool) -> list[int]:
        """End positions of the shards, greedily filled; fluid: ranges of several groups may be cut anywhere."""
        pos, out = 0, []
        for _ in range(shards):
            i = int(np.searchsorted(self.end, pos + capacity, "right")) - 1
            reach = int(self.end[i])
            if fluid and i < len(self.rows) and not self.single[i]:
                reach = pos + capacity
            pos = max(pos, min(reach, self.total))
            out.append(pos)
        return out

    def least(self, shards: int, fluid: bool) -> int:
        lo, hi = max(1, -(-self.total // shards)), max(1, self.total)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.cuts(mid, shards, fluid)[-1] >= self.total:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def doubtful(self, low: int, high: int, shards: int) -> list[int]:
        """Ranges of several groups in which a cut of a capacity from low to high may fall."""
        found: set[int] = set()
        for a, b in zip(self.cuts(low, shards, False), self.cuts(high, shards, True), strict=True):
            i, j = int(np.searchsorted(self.end, min(a, b), "right")) - 1, int(np.searchsorted(self.end, max(a, b), "left"))
            found.update(k for k in range(max(0, i), min(j, len(self.rows))) if not self.single[k])
        return sorted(found)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First keys of the shards after the first one, and the smallest feasible capacity.

    groups: (key long, size long), a row a group; keys are ordered as signed numbers.
    """
    wide = groups.select(F.col("key").bitwiseXOR(F.lit(SIGN)).alias("u"), "size")

    def sums(df: DataFrame, shift: int) -> list[tuple]:
        prefix = F.shiftrightunsigned("u", shift) if shift else F.col("u")
        return [(shift, r.p % (1 << 64), r.s, r.n) for r in df.groupBy(prefix.alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()]

    ranges = _Ranges(sums(wide, 64 - FIRST_BITS))
    while True:
        low, high = ranges.least(shards, True), ranges.least(shards, False)
        split = ranges.doubtful(low, high, shards) if low < high else []
        if not split:
            break
        rows = [r for i, r in enumerate(ranges.rows) if i not in set(split)]
        by_shift: dict[int, list[int]] = {}
        for i in split:
            by_shift.setdefault(ranges.rows[i][0], []).append(ranges.rows[i][1])
        for shift, prefixes in by_shift.items():  # as many rows as ranges are in doubt, times 2 ** MORE_BITS
            wanted = [p - (1 << 64) if p >> 63 else p for p in prefixes]
            part = wide.where(F.shiftrightunsigned("u", shift).isin(wanted) if shift else F.col("u").isin(wanted))
            rows += sums(part, max(0, shift - MORE_BITS))
        ranges = _Ranges(rows)
    ends = ranges.cuts(high, shards, False)[:-1]
    starts = []
    for e in ends:
        i = int(np.searchsorted(ranges.end, e, "left"))
        starts.append(((ranges.rows[i][1] << ranges.rows[i][0]) - (1 << 63)) if i < len(ranges.rows) else None)
    return [s for s in starts if s is not None], high


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, group_key, shard, slot) for every row of ``docs`` (doc_id, text).

    Groups are equal texts (null as empty), ordered by a 64-bit digest of the text; texts of one digest stay
    together. Sizes are UTF-8 bytes plus ``overhead``. No contiguous assignment in this order has a smaller
    largest shard. slot numbers a shard's rows from 0 without gaps. Shards may be empty when there are fewer groups;
    an empty table gives no rows. Repeated rows keep their number; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group_key"))
    rows = scratch.keep(rows, "rows")
    groups = scratch.keep(rows.groupBy(F.col("group_key").alias("key")).agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    starts, _ = minimax_cuts(groups.select("key", "size"), shards)
    number = F.lit(0)
    if starts:
        number = F.size(F.filter(F.array(*[F.lit(s).cast("long") for s in starts]), lambda s: s <= F.col("group_key")))
    total = groups.agg(F.sum("n").alias("n")).first().n or 0
    buckets = max(1, -(-total // SLOT_ROWS))
    rows = rows.withColumn("shard", number.cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "group_key"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "bucket").orderBy("group_key", "doc_id", "size")
    rows = rows.join(base, ["shard", "bucket"]).withColumn("slot", (F.col("base") + F.row_number().over(order) - 1).cast("long"))
    return rows.select("doc_id", "size", "text_crc32", "group_key", "shard", "slot")


def op2_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes; equal texts share a shard."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
