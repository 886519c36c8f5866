"""Reading relational data sets and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.model import Catalog, Relation, RelationType, Table

PREFIXES = {"n": "n", "c": "c", "t": "t", "m": "m"}


def roles_by_prefix(columns: list[str]) -> dict[str, str]:
    """Roles from names such as n_price, c_brand, t_seen, m_tags."""
    return {c: PREFIXES[c.split("_")[0]] for c in columns if c.split("_")[0] in PREFIXES and "_" in c}


def train_and_test(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    """Both in one frame, with `is_test`; test rows have a null target."""
    return train.withColumn("is_test", F.lit(0)).unionByName(test.withColumn("is_test", F.lit(1)).withColumn(y, F.lit(None).cast(dict(train.dtypes)[y])))


def read_catalog(spark: SparkSession, folder: str, main: str, tables: dict[str, dict], relations: list[dict]) -> Catalog:
    """tables: {name: {row, time, roles}}; relations: {src, src_id, dst, dst_id, type}, or {a, b, key, type} for keys of one name on both sides."""
    made = {}
    for name, spec in tables.items():
        frame = spark.read.parquet(f"{folder}/{name}.parquet")
        made[name] = Table(frame, spec["row"], spec.get("time"), spec.get("roles") or roles_by_prefix(frame.columns))
    rel = []
    for r in relations:
        kind = RelationType[r["type"].upper()]
        if "key" in r:
            rel += [Relation(r["a"], k, r["b"], k, kind) for k in ([r["key"]] if isinstance(r["key"], str) else r["key"])]
        else:
            rel.append(Relation(r["src"], r["src_id"], r["dst"], r["dst_id"], kind))
    return Catalog(main, made, rel)


def model_matrix(rows: DataFrame, row: str, numbers: list[str], categories: list[str], most_categories: float) -> DataFrame:
    """Row key, numbers, and those categories that have at most so many values; times and bags stay out."""
    sizes = rows.agg(*[F.count_distinct(c).alias(c) for c in categories]).first() if categories else {}
    return rows.select(row, *numbers, *[c for c in categories if sizes[c] <= most_categories])


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)
