"""Functional dependencies of keys: which to-many relations are to one in substance.

A key that relations enter a table by may have many rows there that agree in a column: the customer's region on each of their orders. Along such a relation there is
nothing to aggregate in that column, and one lookup says all. The planner drops aggregates of such columns and offers the lookup.

All keys and columns of a table are tested over all rows in one pass: the smallest and largest hash of a column by key, folded map side, so a frequent key is
one row a task; then counts of keys where they differ. `known` first looks at all rows of one key in SOME: a column that differs there is no dependency, and only
what is left goes through all rows. Nulls say nothing, neither as keys nor as values; a key without rows agrees. Hashes are of 64 bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofeat.model import Catalog, Path

#: One key in so many is looked at first.
SOME = 64
#: Table, key, column.
Dependency = tuple[str, str, str]


def tested(catalog: Catalog) -> dict[str, tuple[list[str], list[str]]]:
    """By table the keys that to-many hops enter it by, and the columns that may depend on them: those with roles but bags, and those that hops leave by."""
    ways = [*catalog.relations, *(r.inverse for r in catalog.relations)]
    out = {}
    for name, table in catalog.tables.items():
        keys = list(dict.fromkeys(r.dst_id for r in ways if r.dst == name and not r.type.to_one))
        columns = [c for c, role in table.roles.items() if role in "nct"] + [r.src_id for r in ways if r.src == name]
        if keys and columns:
            out[name] = (keys, list(dict.fromkeys(columns)))
    return out


def dependencies(frame: DataFrame, keys: list[str], columns: list[str], some: int = 1) -> DataFrame:
    """(key, column, keys, varying): the number of the key's values, and of those whose rows differ in the column. some: of one value in so many."""
    own = [f"_h{i}" for i in range(len(columns))]
    cells = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("v")) for k in keys])
    rows = frame.select(F.explode(cells).alias("_k"), *[F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(h) for c, h in zip(columns, own, strict=True)]).filter("_k.v IS NOT NULL")
    rows = rows.filter(F.pmod(F.xxhash64("_k.v"), F.lit(some)) == 0) if some > 1 else rows
    by_key = rows.groupBy("_k").agg(*[(F.min(h) < F.max(h)).alias(h) for h in own])
    counts = by_key.groupBy(F.col("_k.key").alias("key")).agg(F.count(F.lit(1)).alias("keys"), *[F.count_if(h).alias(h) for h in own])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(h).alias("varying")) for c, h in zip(columns, own, strict=True)])
    return counts.select("key", "keys", F.explode(each).alias("_c")).select("key", "_c.column", "keys", "_c.varying").filter("key <> column")


def of_catalog(catalog: Catalog) -> DataFrame:
    """dependencies() of all tables, with `table`."""
    found = [dependencies(catalog.tables[n].frame, *what).withColumn("table", F.lit(n)) for n, what in tested(catalog).items()]
    if not found:
        return next(iter(catalog.tables.values())).frame.sparkSession.createDataFrame([], "key string, column string, keys long, varying long, table string")
    return reduce(DataFrame.unionByName, found)


def known(catalog: Catalog, most: float = 0.0) -> set[Dependency]:
    """Dependencies that at most this share of keys breaks. One row for each table, key and column comes to the driver."""
    out = set()
    for name, (keys, columns) in tested(catalog).items():
        frame, left = catalog.tables[name].frame, {k: [c for c in columns if c != k] for k in keys}
        if not most:  # one key that breaks it is enough
            broken = {(r["key"], r["column"]) for r in dependencies(frame, keys, columns, SOME).filter("varying > 0").collect()}
            left = {k: [c for c in cs if (k, c) not in broken] for k, cs in left.items()}
        parts = [dependencies(frame, [k], cs) for k, cs in left.items() if cs]
        if parts:
            out |= {(name, r["key"], r["column"]) for r in reduce(DataFrame.unionByName, parts).filter(F.col("varying") <= most * F.col("keys")).collect()}
    return out


def legs(path: Path, column: str, depends: set[Dependency]) -> list[bool]:
    """By hop, whether it leads to one row in what goes on from it: the key that the next hop leaves by, or the column at the end."""
    leaves = [*(r.src_id for r in path.relations[1:]), column]
    return [r.type.to_one or r.dst_id == leaves[i] or (r.dst, r.dst_id, leaves[i]) in depends for i, r in enumerate(path.relations)]


def one_in_substance(path: Path, column: str, depends: set[Dependency]) -> bool:
    """Whether all rows that the path reaches from one of main's agree in the column."""
    return all(legs(path, column, depends))


def to_many(path: Path, column: str, depends: set[Dependency]) -> int:
    """Hops to many rows that stay so in substance."""
    return legs(path, column, depends).count(False)
