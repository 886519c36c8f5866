"""Statistics of tables that the planner's rules need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_stats(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, rows, nulls, nunique) of all columns in one job."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in cols])).alias("f")).select("f.feature", "f.v")
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("v").isNull(), 1)).alias("nulls"), F.count_distinct("v").alias("nunique"))


def median_group_size(rows: DataFrame, key: str) -> DataFrame:
    """One row: the median number of rows of a key. 1 says that a declared to-many relation is to one in substance."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.median("n").alias("median_rows"))


def constant_per_key(rows: DataFrame, key: str, cols: list[str], keys: int = 10) -> DataFrame:
    """(feature, constant): whether the column has at most one value within each of the most frequent keys."""
    top = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), key).limit(keys)
    per = rows.join(F.broadcast(top), key).groupBy(key).agg(*[F.count_distinct(c).alias(c) for c in cols])
    most = per.agg(*[F.max(c).alias(c) for c in cols])
    return most.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) <= 1).alias("constant")) for c in cols])).alias("f")).select("f.feature", "f.constant")


def self_relations(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, related): whether a category repeats enough, and not too much, to relate a table to itself: sqrt(n) < distinct < n / 2."""
    s = column_stats(rows, cols)
    return s.select("feature", ((F.col("nunique") > F.sqrt("rows")) & (F.col("nunique") < F.col("rows") / 2)).alias("related"))


def class_limits(rows: DataFrame, y: str) -> DataFrame:
    """One row: rows of the rarer class, and the most values a category may have, the lesser root of both class sizes."""
    c = rows.agg(F.count(F.when(F.col(y) > 0, 1)).alias("p"), F.count(F.when(F.col(y) <= 0, 1)).alias("n"))
    return c.select(F.least("p", "n").alias("minority"), F.sqrt(F.least("p", "n")).alias("max_categories"))
