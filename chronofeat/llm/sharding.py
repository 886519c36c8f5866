"""Sharding: a Feistel permutation over global row numbers.

Rows are numbered 0..n-1 by (id, size, checksum) without gathering them in one
task: they are range-partitioned and numbered within each range, and a count per
range gives its first number. A Feistel network on the mixed-radix square
a x b >= n permutes the numbers; a value that falls outside 0..n-1 walks on along
its cycle until it is inside. The permuted number p gives shard p mod k and slot
p div k, so the counts of any two shards differ by one at most (law `rows`), and
the place of any row follows from its number, n, k and the seed alone.

Groups of equal texts are not kept together: each row has its own place.

Defined cases: null ids come first; a null text has no bytes; very long texts count
by their bytes like any other and are never shuffled; rows alike in all
of id, size and checksum take neighbouring numbers in any order; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofeat.llm.common import cut, read

ROUNDS = 6


def square(n: int) -> tuple[int, int]:
    """a x b >= n with less than a to spare."""
    a = max(1, math.isqrt(max(n, 1)))
    return a, -(-max(n, 1) // a)


def feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """The network's image of x in 0..a*b-1. One expression whose size doesn't grow with the rounds."""

    def step(state: Column, i: Column) -> Column:
        left, right, even = state["l"], state["r"], i % 2 == 0
        key = F.xxhash64(F.when(even, right).otherwise(left), F.lit(seed), i)
        return F.struct(F.when(even, F.pmod(left + F.pmod(key, F.lit(a)), F.lit(a))).otherwise(left).alias("l"), F.when(even, right).otherwise(F.pmod(right + F.pmod(key, F.lit(b)), F.lit(b))).alias("r"))

    x = x.cast("long")
    start = F.struct(F.call_function("div", x, F.lit(b).cast("long")).alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def walk_length(spark: SparkSession, n: int, a: int, b: int, seed: int) -> int:
    """Most steps that a cycle walk from inside needs. Values outside, fewer than a, that no other one outside leads to are followed until all are inside; cycles that stay outside are never entered."""
    onward = lambda df: df.select(feistel(F.col("id"), a, b, seed).alias("id")).filter(F.col("id") >= n)
    outside, steps = spark.range(n, a * b), 1
    outside = outside.join(onward(outside), "id", "left_anti")
    while outside.limit(1).count():
        outside, steps = onward(outside), steps + 1
    return steps


def permuted(x: Column, n: int, seed: int, spark: SparkSession) -> Column:
    """The image of x under the seed's permutation of 0..n-1."""
    a, b = square(n)
    walk = F.sequence(F.lit(1), F.lit(walk_length(spark, n, a, b, seed)))
    return F.aggregate(walk, x.cast("long"), lambda y, i: F.when((i == 1) | (y >= n), feistel(y, a, b, seed)).otherwise(y))


def row_numbers(df: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """df, cut, with the global row number `row_no` in the order of `by`; and the number of rows."""
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = cut(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "rows")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, whatever the table's size.
    firsts = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_first"))
    n = ranged.count()
    return ranged.join(F.broadcast(firsts), "_part").withColumn("row_no", F.col("_first") + F.col("_at")).drop("_part", "_at", "_first"), n


def shard_rows(docs: DataFrame, shards: int, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    numbered, n = row_numbers(light, ["doc_id", "size", "text_crc32"])
    return numbered.withColumn("_p", permuted(F.col("row_no"), n, seed, docs.sparkSession)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no"
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read(spark, sf_dir, "documents"), 24)
