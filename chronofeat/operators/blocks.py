"""Stretches of ordered groups: a group with more rows than a task should hold is cut into blocks of about BLOCK rows by edges
taken from a sample, so that a window over it becomes windows over its blocks, and what earlier blocks add to a row is carried
over by a small table with a row per block.

Only groups of over two blocks are cut; where there are none, everything is one block, and no sample is taken. There are at most about BLOCKS
blocks in all, so their edges and totals are broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofeat.session import stored

#: Share of rows to either side of an approximate quantile that should hold the exact one; three times what the approximation allows.
NEAR = 3e-4
#: Rows to a block, blocks at most, sampled rows to a block.
BLOCK, BLOCKS, PER = 1 << 16, 1 << 12, 16


def same(pairs: list[tuple[Column, Column]]) -> Column:
    """Columns are equal in pairs, nulls too."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & a.eqNullSafe(b)
    return out


@dataclass
class Blocks:
    """by: columns of a group; order: columns that put its rows in order, nulls first, and should name a row; edges: (_g0.., _edges) of the groups that are cut."""

    by: list[str]
    order: list[str]
    edges: DataFrame | None = None
    steps: int = 0

    @property
    def split(self) -> bool:
        return self.edges is not None

    @property
    def group(self) -> list[str]:
        """What windows are to be partitioned by on rows that on() has marked."""
        return [*self.by, "_block"] if self.split else self.by

    def on(self, rows: DataFrame) -> DataFrame:
        """rows with `_block`, 0.. in the order of rows, and `_cut`: whether the group is cut."""
        if not self.split:
            return rows
        place, edges = F.struct(*self.order), F.col("_edges")
        at = lambda n, s: F.try_element_at(edges, n + s)
        halving = F.array(*[F.lit(1 << i) for i in range(self.steps - 1, -1, -1)])
        block = F.aggregate(halving, F.lit(0), lambda n, s: n + F.when(at(n, s) < place, s).otherwise(0))
        marked = rows.join(F.broadcast(self.edges), same([(rows[c], self.edges[f"_g{i}"]) for i, c in enumerate(self.by)]), "left") if self.by else rows.crossJoin(F.broadcast(self.edges))
        return marked.select(*[rows[c] for c in rows.columns], F.when(edges.isNull(), 0).otherwise(block).alias("_block"), edges.isNotNull().alias("_cut"))

    def totals(self, marked: DataFrame, *aggregates: Column) -> DataFrame:
        """One row per block of the groups that are cut."""
        return marked.filter("_cut").groupBy(*self.by, "_block").agg(*aggregates)

    def before(self) -> object:
        """Window of the blocks before, over totals()."""
        return Window.partitionBy(*self.by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def carried(self, marked: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
        """marked with columns of a table by block; null where its group is not cut."""
        side = table.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate([*self.by, "_block"])], *columns)
        keys = [(marked[c], side[f"_t{i}"]) for i, c in enumerate([*self.by, "_block"])]
        return marked.join(F.broadcast(side), same(keys), "left").drop(*[f"_t{i}" for i in range(len(keys))])


def cut(rows: DataFrame, by: list[str], order: list[str], block: int | None = None, keys: DataFrame | None = None) -> Blocks:
    """The blocks of rows. keys: a frame with the columns of `by` and as many rows a group, if that is cheaper to count."""
    block = block or BLOCK
    sizes = (rows if keys is None else keys).groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    big = sizes.filter(F.col("_rows") > 2 * block)
    found = big.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")).first()["n"]
    if not found:
        return Blocks(by, order)
    block = max(block, found // BLOCKS)
    big = big.filter(F.col("_rows") > 2 * block).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)])
    side = rows.select(*dict.fromkeys([*by, *order]))
    taken = side.filter(F.pmod(F.xxhash64(*order), F.lit(max(1, block // PER))) == 0)
    if by:
        taken = taken.join(F.broadcast(big), same([(taken[c], big[f"_g{i}"]) for i, c in enumerate(by)]))
        taken = taken.groupBy(*[f"_g{i}" for i in range(len(by))])
    else:
        taken = taken.groupBy()
    # Of a group PER sampled rows a block; every PERth, or as many as a small block has, is an edge.
    every = max(1, min(block, PER))
    edges = taken.agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_s")).select(*[f"_g{i}" for i in range(len(by))], F.filter("_s", lambda x, i: i % every == every - 1).alias("_edges")).filter(F.size("_edges") > 0)
    known = edges.collect()  # BLOCKS edges or so in all
    if not known:
        return Blocks(by, order)
    fixed = rows.sparkSession.createDataFrame(known, edges.schema).withColumn("_edges", F.sort_array("_edges"))
    return Blocks(by, order, fixed, max(len(r["_edges"]) for r in known).bit_length())


def running_sums(rows: DataFrame, by: list[str], order: list[str], values: dict[str, Column], blocks: Blocks | None = None) -> DataFrame:
    """rows with the sum of each value, by its name, over the group's rows up to this one."""
    blocks = blocks or cut(rows, by, order)
    marked = blocks.on(rows.withColumns({f"_value_{n}": v for n, v in values.items()}))
    along = Window.partitionBy(*blocks.group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own, given = {n: F.sum(f"_value_{n}").over(along) for n in values}, [f"_value_{n}" for n in values]
    if not blocks.split:
        return marked.withColumns(own).drop(*given)
    carry = blocks.totals(marked, *[F.sum(f"_value_{n}").alias(f"_all_{n}") for n in values]).withColumns({f"_carry_{n}": F.sum(f"_all_{n}").over(blocks.before()) for n in values})
    out = blocks.carried(marked.withColumns({f"_own_{n}": v for n, v in own.items()}), carry, [f"_carry_{n}" for n in values])
    out = out.withColumns({n: F.coalesce(F.col(f"_own_{n}") + F.col(f"_carry_{n}"), f"_own_{n}", f"_carry_{n}") for n in values})
    return out.drop(*given, *[f"_own_{n}" for n in values], *[f"_carry_{n}" for n in values], "_block", "_cut")


def running_sum(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, blocks: Blocks | None = None) -> DataFrame:
    """rows with the sum of value over the group's rows up to this one."""
    return running_sums(rows, by, order, {name: value}, blocks)


def quantiles(rows: DataFrame, columns: list[str], share: float, block: int | None = None) -> dict[str, float | None]:
    """The exact quantile of each column, between its two neighbouring values as the share falls.

    An approximate one gives a range of a few values in ten thousand that should hold it; what lies below is counted, and only what lies within is put in order. A column
    whose counts show that the range misses it is put in order whole.
    """
    x = {c: F.col(c).cast("double") for c in columns}
    ends = [max(0.0, share - NEAR), min(1.0, share + NEAR)]
    guess = rows.agg(*[F.percentile_approx(x[c], ends, 10_000).alias(f"_e{i}") for i, c in enumerate(columns)]).first()
    range_of = {c: guess[f"_e{i}"] for i, c in enumerate(columns) if guess[f"_e{i}"]}
    if not range_of:
        return dict.fromkeys(columns)
    within = {c: (x[c] >= F.lit(a)) & (x[c] <= F.lit(b)) for c, (a, b) in range_of.items()}
    counted = rows.agg(*[f.alias(f"{n}{i}") for i, (c, (a, _)) in enumerate(range_of.items()) for n, f in (("t", F.count(x[c])), ("b", F.count_if(x[c] < F.lit(a))), ("w", F.count_if(within[c])))]).first()
    below, total = {}, {}
    for i, c in enumerate(range_of):
        at, b = share * (counted[f"t{i}"] - 1), counted[f"b{i}"]
        total[c] = counted[f"t{i}"]
        if b <= math.floor(at) and math.ceil(at) < b + counted[f"w{i}"]:
            below[c] = b
    near = {c: F.when(within[c], x[c]) for c in below}
    out = _quantiles(rows.select(*[v.alias(f"_q{i}") for i, v in enumerate(near.values())]), [f"_q{i}" for i in range(len(near))], {f"_q{i}": (share * (total[c] - 1) - below[c]) for i, c in enumerate(near)}, block) if near else {}
    got = {c: out[f"_q{i}"] for i, c in enumerate(near)}
    missed = [c for c in range_of if c not in below]
    if missed:
        got |= _quantiles(rows, missed, {c: share * (total[c] - 1) for c in missed}, block)
    return {c: got.get(c) for c in columns}


def _quantiles(rows: DataFrame, columns: list[str], places: dict[str, float], block: int | None) -> dict[str, float | None]:
    """The value at a place, from 0, of each column in order, between its two neighbours as the place falls."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")).select("f.*").filter("x IS NOT NULL")
    counts = stored(long.groupBy("column", "x").agg(F.count(F.lit(1)).alias("n")), "values")
    upto = running_sum(counts, ["column"], ["x"], F.col("n"), "upto", cut(counts, ["column"], ["x"], block))
    at = F.create_map(*[F.lit(v) for c in columns for v in (c, float(places[c]))])[F.col("column")]
    near = upto.withColumn("_at", at).filter((F.col("upto") > F.floor("_at")) & (F.col("upto") - F.col("n") <= F.ceil("_at")))
    ends = near.groupBy("column").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.first(F.col("_at") - F.floor("_at")).alias("part"))
    got = {r["column"]: r["low"] + (r["high"] - r["low"]) * r["part"] for r in ends.collect()}  # a row per column
    return {c: got.get(c) for c in columns}
