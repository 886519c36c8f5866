"""Targets and row counts carried from main to the other tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofeat.model import Catalog, Relation
from chronofeat.operators.blocks import quantiles
from chronofeat.operators.selection import auc_table
from chronofeat.operators.temporal import lookup
from chronofeat.session import stored

WEIGHT = 1000.0


def pseudo_target(src: DataFrame, dst: DataFrame, key: tuple[str, str], y: str, name: str, one_source: bool = False) -> DataFrame:
    """dst with the mean target of the source rows that refer to it, smoothed by WEIGHT rows of the overall mean; with one_source, a copy of the one row's target."""
    if one_source:
        return lookup(dst, src, (key[1], key[0]), [(name, y)], large=True)
    mean = src.agg(F.avg(y).alias("_m"))
    sums = src.filter(F.col(key[0]).isNotNull()).groupBy(F.col(key[0]).alias("_k")).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    out = dst.join(sums.hint("merge"), dst[key[1]] == sums["_k"], "left").crossJoin(F.broadcast(mean))
    value = (F.coalesce("_s", F.lit(0.0)) + WEIGHT * F.col("_m")) / (F.coalesce("_n", F.lit(0)) + WEIGHT)
    return out.withColumn(name, value).drop("_k", "_s", "_n", "_m")


def halves(rows: DataFrame, numbers: list[str], categories: list[str]) -> dict[str, Column]:
    """Each column made 0/1: a number is above its median, a category its mode, ties to the smaller value. Null stays null."""
    middle = quantiles(rows, numbers, 0.5) if numbers else {}
    flags = {c: (F.col(c) > F.lit(middle[c])).cast("int") for c in numbers}
    for c in categories:
        top = rows.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
        flags[c] = (F.col(c) == F.lit(top[0] if top else None)).cast("int")
    return flags


def ranked(rows: DataFrame, flags: dict[str, Column], y: str) -> DataFrame:
    mean = rows.agg(F.avg(y)).first()[0]
    told = rows.select((F.col(y) > F.lit(mean)).cast("int").alias("_y"), *[f.alias(c) for c, f in flags.items()])
    # Rounded, so that columns which tell as much tie whatever the order of sums.
    return auc_table(told, list(flags), "_y").withColumn("distance", F.abs(F.col("auc") - 0.5)).orderBy(F.desc(F.round("distance", 9)), "feature")


def surrogate(rows: DataFrame, numbers: list[str], categories: list[str], y: str) -> DataFrame:
    """(feature, auc, distance): each column of halves() against the known pseudo target above its mean, most telling first."""
    return ranked(rows, halves(rows, numbers, categories), y)


def with_surrogate(rows: DataFrame, numbers: list[str], categories: list[str], y: str, name: str) -> DataFrame:
    """rows with the most telling column of surrogate() as 0/1, ties to the smaller name; the pseudo target itself where no column tells anything."""
    # What carried the target here runs once, not for each statistic; only columns that statistics need are written.
    kept = stored(rows.select(*dict.fromkeys([y, *numbers, *categories])), "told") if numbers or categories else rows
    flags = halves(kept, numbers, categories)
    best = ranked(kept, flags, y).filter("distance > 0").first() if flags else None
    return rows.withColumn(name, (flags[best["feature"]] if best else F.col(y)).cast("double"))


def train_counts(src: DataFrame, dst: DataFrame, key: tuple[str, str], is_train: str) -> DataFrame:
    """dst with the number of training rows and of all rows that refer to it."""
    sums = src.filter(F.col(key[0]).isNotNull()).groupBy(F.col(key[0]).alias("_k")).agg(F.sum(F.col(is_train).cast("long")).alias("n_train"), F.count(F.lit(1)).alias("n_all"))
    out = dst.join(sums, dst[key[1]] == sums["_k"], "left").drop("_k")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_train", "n_all")})


def walk(catalog: Catalog) -> Iterator[tuple[str, list[Relation]]]:
    """Tables by their distance from main, each with the relations that lead to it from tables one step nearer."""
    steps = [r for r in catalog.relations if r.src != r.dst]
    steps += [r.inverse for r in steps]
    reached, edge = {catalog.main}, {catalog.main}
    while edge:
        found: dict[str, list[Relation]] = {}
        for r in steps:
            if r.src in edge and r.dst not in reached:
                found.setdefault(r.dst, []).append(r)
        yield from found.items()
        edge = set(found)
        reached |= edge


def targets_of(catalog: Catalog, name: str = "_target", surrogates: bool = False) -> Catalog:
    """The catalog with a column for a target in each table that a relation leads to: the mean of what its parents carry to it, of those that are not null. main's is its own.

    surrogates: tables other than main then get, in its place, the most telling of their own columns as 0/1 (with_surrogate()); the walk itself goes by carried targets.
    """
    main = catalog.tables[catalog.main]
    carried = {catalog.main: main.frame.withColumn(name, F.col(catalog.target).cast("double"))}
    for dst, ways in walk(catalog):
        rows, parts = catalog.tables[dst].frame, []
        for i, r in enumerate(ways):
            rows = pseudo_target(carried[r.src], rows, (r.src_id, r.dst_id), name, f"_part{i}", one_source=r.type.value[0])
            parts.append(f"_part{i}")
        some = F.filter(F.array(*parts), lambda x: x.isNotNull())
        mean = F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(some), F.lit(0))
        carried[dst] = rows.withColumn(name, mean).drop(*parts)
    if surrogates:
        keys = {(r.src, r.src_id) for r in catalog.relations} | {(r.dst, r.dst_id) for r in catalog.relations}
        for t in [t for t in carried if t != catalog.main]:
            of = lambda role, t=t: [c for c, r in catalog.tables[t].roles.items() if r == role and (t, c) not in keys]
            carried[t] = with_surrogate(carried[t], of("n"), of("c"), name, name)
    return catalog.replaced(**carried)


def counts_of(catalog: Catalog, is_train: str) -> Catalog:
    """The catalog with `n_train` and `n_all` in each table that a relation leads to: main's rows behind a row, in training and in all.

    Rows that refer to a table are summed; a row that others are parts of hands its counts on to each. Of several parents the one whose training
    shares differ most, by their standard deviation, is kept.
    """
    main = catalog.tables[catalog.main]
    both = ["n_train", "n_all"]
    held = {catalog.main: main.frame.withColumns({"n_train": F.col(is_train).cast("long"), "n_all": F.lit(1).cast("long")})}
    for dst, ways in walk(catalog):
        rows = catalog.tables[dst].frame
        for i, r in enumerate(ways):
            src = held[r.src].filter(F.col(r.src_id).isNotNull())
            if r.type.value[0]:
                rows = lookup(rows, src, (r.dst_id, r.src_id), [(f"_{c}{i}", c) for c in both])
            else:
                sums = src.groupBy(F.col(r.src_id).alias("_k")).agg(*[F.sum(c).alias(f"_{c}{i}") for c in both])
                rows = rows.join(sums, rows[r.dst_id] == sums["_k"], "left").drop("_k")
            rows = rows.withColumns({f"_{c}{i}": F.coalesce(f"_{c}{i}", F.lit(0)).cast("long") for c in both})
        best = 0
        if len(ways) > 1:
            spread = rows.agg(*[F.stddev_pop(F.try_divide(F.col(f"_n_train{i}"), F.col(f"_n_all{i}"))).alias(f"s{i}") for i in range(len(ways))]).first()
            best = max(range(len(ways)), key=lambda i: (spread[f"s{i}"] if spread[f"s{i}"] is not None else -1.0, -i))
        held[dst] = rows.withColumns({c: F.col(f"_{c}{best}") for c in both}).drop(*[f"_{c}{i}" for c in both for i in range(len(ways))])
    return catalog.replaced(**held)
