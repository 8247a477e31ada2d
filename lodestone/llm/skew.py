"""Joins and numbers that stay even where one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch

#: A key with more than this part of all rows is hot; fewer than HOT keys can be.
HOT = 256
#: monotonically_increasing_id has the partition above this bit and the row in it below.
_ROW_BITS = 33


def lookup(rows: DataFrame, table: DataFrame, on: list[str], total: int, count: str = "n") -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row for each key of ``on`` and, in ``count``, the rows of that key.

    Rows of hot keys meet their fewer than HOT table rows by broadcast and are not shuffled; the others are joined by key, of
    which none holds more than a HOTth of ``total``, the number of rows. Both read twice, so they should be tables.
    """
    most = total // HOT
    hot = table.where(F.col(count) > most)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(table.where(F.col(count) <= most), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def dense(rows: DataFrame, on: list[str], scratch: Scratch, label: str) -> tuple[DataFrame, int, int]:
    """(*on, n, name): a number from 0, without gaps, for each distinct key and its rows; the keys and rows there are.

    The order of the written table decides, so numbers hold for all readers. The driver adds up a row a partition.
    """
    found = scratch.keep(rows.groupBy(*on).agg(F.count("*").alias("n")).withColumn("at", F.monotonically_increasing_id()), label)
    part = F.shiftright("at", _ROW_BITS).cast("int")
    sizes = found.groupBy(part.alias("part")).agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).collect()
    offsets, at = [], 0
    for r in sorted(sizes):
        offsets.append((r.part, at))
        at += r.keys
    offsets = F.broadcast(found.sparkSession.createDataFrame(offsets, "part int, before long"))
    named = found.withColumn("part", part).join(offsets, "part").withColumn("name", F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("before"))
    return named.select(*on, "n", "name"), at, sum(r.rows for r in sizes)
