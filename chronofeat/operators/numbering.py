"""Global row numbers without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofeat.session import stored

#: Bits of Spark's row ids that count within a partition.
WITHIN = 33


def global_row_number(rows: DataFrame, order: list[str], name: str, block: int | None = None) -> DataFrame:
    """Numbers 1.. by `order`, whose columns should name a row; nulls come first. Ranges of all columns of the order, not of the first alone, are put in order and written
    with each row's place in its range; the rows of the ranges before are added from a table of a row a range. block: rows to a range, about."""
    ranged = rows.repartitionByRange(max(1, -(-rows.count() // block)), *order) if block else rows.repartitionByRange(*order)
    placed = stored(ranged.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_id", WITHIN))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << WITHIN) - 1)) + 1
    return placed.join(F.broadcast(before), "_range").withColumn(name, number).drop("_range", "_before", "_id")
