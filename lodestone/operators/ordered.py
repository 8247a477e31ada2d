"""Previous rows and running values over keys of any size: a key with very many rows spreads over ranges of its order.

A table is cut into ranges of (key, order) and written. Windows run within a range; what a range needs from the ones
before it is a row a range, which the driver carries over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources import scratch


#: Rows of a key up to which one task takes them all.
ORDINARY = 1 << 20


def ordinary(df: DataFrame, key: str) -> bool:
    """Whether every value of ``key`` has few enough rows for a window of its own; counts are combined before the shuffle."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > ORDINARY).isEmpty()


class Ranges:
    """The rows of a DataFrame in the order of ``by``, dealt into ranges of near size whatever their keys."""

    def __init__(self, df: DataFrame, by: list[str]):
        self.spark, self.by = df.sparkSession, by
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.rows = scratch.keep(df.repartitionByRange(parts, *by).withColumn("__range", F.spark_partition_id()), "ranges")
        self.columns = df.columns

    def _window(self):
        return Window.partitionBy("__range").orderBy(*self.by)

    def _carried(self, per_range: list[tuple], kind: str) -> DataFrame:
        """(__range, __before) as a broadcast table: at most a row a range."""
        return F.broadcast(self.spark.createDataFrame(per_range, f"__range int, __before {kind}"))

    def previous(self, columns: list[str], name: str) -> Ranges:
        """Adds a struct of the columns of the row before, null for the first of all."""
        own = F.struct(*columns)
        kind = self.rows.select(own.alias("x")).schema["x"].dataType.simpleString()
        last = {r["__range"]: r.x for r in self.rows.groupBy("__range").agg(F.max_by(own, F.struct(*self.by)).alias("x")).collect()}
        carried, at = [], None
        for n in sorted(last):
            carried.append((n, at))
            at = tuple(last[n])
        out = self.rows.withColumn("__own", F.lag(own).over(self._window())).withColumn("__first", F.row_number().over(self._window()) == 1)
        out = out.join(self._carried(carried, kind), "__range").withColumn(name, F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__own")))
        return self._with(out, name)

    def running(self, value: Column, how: str, name: str) -> Ranges:
        """Adds the running sum or max (``how``) of a long value up to the row, over all rows before it."""
        combine, over = {"sum": (lambda a, b: a + b, F.sum), "max": (max, F.max)}[how]
        rows = self.rows.withColumn("__value", value.cast("long"))
        sums = {r["__range"]: r.x for r in rows.groupBy("__range").agg(over("__value").alias("x")).collect()}
        carried, at = [], None
        for n in sorted(sums):
            carried.append((n, at))
            if sums[n] is not None:
                at = sums[n] if at is None else combine(at, sums[n])
        own = over("__value").over(self._window().rowsBetween(Window.unboundedPreceding, 0))
        out = rows.withColumn("__own", own).join(self._carried(carried, "long"), "__range")
        both = F.coalesce("__own", F.lit(0)) + F.coalesce("__before", F.lit(0)) if how == "sum" else F.greatest("__own", "__before")
        return self._with(out.withColumn(name, both), name)

    def _with(self, out: DataFrame, name: str) -> Ranges:
        new = object.__new__(Ranges)
        new.spark, new.by, new.columns = self.spark, self.by, [*self.columns, name]
        new.rows = out.select(*new.columns, "__range")
        return new

    def table(self) -> DataFrame:
        return self.rows.select(*self.columns)
