"""Places of rows in one order over a whole table, without a window over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalmap.session import cut


def numbered(df: DataFrame, order: list[Column], out: str = "row") -> DataFrame:
    """Add the place (from 0) of each row in `order`; the written table is returned.

    Rows are range-partitioned and sorted, so ranges hold no more than their share even of equal keys as
    long as the order tells rows apart. A row's place is its place in its range plus the rows of the
    ranges before. Only the table of ranges, with one row per task, meets in one task.
    """
    swept = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # Ranges are drawn anew whenever they are computed, so they are fixed by writing them.
    swept = cut(swept, "numbered").withColumn("_range", F.shiftrightunsigned("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = swept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return swept.join(F.broadcast(ranges), "_range").withColumn(out, place).drop("_at", "_range", "_before")
