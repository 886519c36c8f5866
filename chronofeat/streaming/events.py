"""Running features of an event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofeat.session import shared_folder


def read_stream(spark: SparkSession, folder: str, like: DataFrame, pattern: str = "*.parquet", files: int | None = None) -> DataFrame:
    """files: how many are read to a batch, the oldest first."""
    reader = spark.readStream.schema(like.schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def windowed(events: DataFrame, key: str, ts: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, sum, mean and last value per key and window; rows later than the watermark are dropped, and state with them."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(key, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max_by(value, ts).alias("last")).select(key, F.col("w.start").alias("start"), "n", "total", "mean", "last")


def run_to_end(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """The latest rows of each key once the input that is there now is read.

    Every batch adds the rows that it changed to a Parquet table in the shared folder, under its number, so that a repeated batch
    replaces its own; state goes with the watermark, and nothing passes through the driver.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def add(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(add).trigger(availableNow=True).start().awaitTermination()
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return spark.read.parquet(f"{folder}/rows").withColumn("_r", latest).filter("_r = 1").drop("_r", "batch")
