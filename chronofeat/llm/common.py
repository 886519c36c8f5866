"""What the corpus operators share: reading tables, cutting lineage, checked broadcasts."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.session import shared_folder

# Workers that lack the package on their path get its functions with the task.
cloudpickle.register_pickle_by_value(sys.modules["chronofeat"])

#: Rows up to which a narrow frame (a few longs or short strings a row) may be broadcast.
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost only re-reads."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows stay within the bound; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
