"""Running totals over a whole table, without one task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.store import stash


def running_total(df: DataFrame, value: str, order: Sequence[str], *, name: str = "before", ranges: int | None = None) -> DataFrame:
    """df with the sum of `value` over all rows before each one in the order (0 for the first).

    Rows are dealt into ranges of the order, as many as there are shuffle partitions unless given, and each range is summed where it
    lies; what is before a range follows from the sums of the ranges alone. The order should tell rows apart: rows that
    tie come in any order, in one range.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stash(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = rows.groupBy("_range").agg(F.sum(value).alias("_sum"))
    ahead = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = sums.select("_range", ahead.alias("_ahead"))  # one row a range
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(name, within).join(F.broadcast(told), "_range").withColumn(name, F.col(name) + F.col("_ahead")).drop("_range", "_ahead")
