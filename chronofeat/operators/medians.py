"""Running medians: order statistics of growing sets, by a wavelet tree over a block's ranks."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofeat.operators import blocks as bl

# Workers that lack the package on their path get its functions with the task.
cloudpickle.register_pickle_by_value(sys.modules["chronofeat"])

#: Rows that a task takes up at a time, beyond those of the group it is in.
TAKEN = 1 << 17


def kth(ranks: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest (from 0) of ranks[low:high], for many ranges at once; ranks are a permutation. One pass over ranks for each of their bits."""
    now, out = ranks.copy(), np.zeros(len(k), dtype=np.int64)
    low, high, k = low.copy(), high.copy(), k.copy()
    for bit in range(max(len(ranks) - 1, 0).bit_length() - 1, -1, -1):
        one = (now >> bit & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~one)))
        a, b = zeros[low], zeros[high]
        left = k < b - a
        out |= np.where(left, 0, 1 << bit)
        k = np.where(left, k, k - (b - a))
        low, high = np.where(left, a, zeros[-1] + low - a), np.where(left, b, zeros[-1] + high - b)
        now = np.concatenate((now[~one], now[one]))
    return out


def medians_of(group: np.ndarray, weight: np.ndarray, x: np.ndarray, below: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The median at each row of its group's values so far. Rows come group by group; a row with a weight stands for as many values of the past
    of which `below` more, smaller ones and `many` in all were known before; rows without are those that ask."""
    out = np.full(len(x), np.nan)
    times = np.where(np.isnan(x), 0, np.where(weight > 0, weight, 1))
    value, owner = np.repeat(x, times), np.repeat(group, times)
    if not len(value):
        return out
    order = np.lexsort((value, owner))
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.arange(len(order))
    stop = np.cumsum(times)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    start = np.repeat((stop - times)[first], np.diff(np.append(first, len(group))))
    past = np.cumsum(np.where(weight > 0, times, 0))
    past -= np.repeat((past - np.where(weight > 0, times, 0))[first], np.diff(np.append(first, len(group))))
    n = many + stop - start - past  # all values so far, those that are left out too
    ask = np.flatnonzero((weight == 0) & (n > 0))
    n, less = n[ask], below[ask]
    pick = lambda k: value[order[kth(ranks, start[ask], stop[ask], k - less)]]
    low, high = pick((n - 1) // 2), pick(n // 2)
    out[ask] = low + (high - low) / 2
    return out


def running_medians(rows: DataFrame, group: list[str], order: list[str], wanted: dict[str, str], past: dict[str, DataFrame] | None = None) -> DataFrame:
    """rows with the median of each column (name: column) over the group's rows up to this one.

    past: for a column, rows (group, _weight, _x) of values known before each group, and on rows `_below_` and `_many_` with the name.
    """
    kinds, based, known_past = dict(rows.dtypes), set(past or ()), past or {}
    both = rows.withColumn("_weight", F.lit(0).cast("long")).withColumn("_of", F.lit(None).cast("string"))
    for name, known in known_past.items():
        both = both.unionByName(known.select(*group, F.col("_weight").cast("long").alias("_weight"), F.lit(name).alias("_of"), F.col("_x").alias(f"_x_{name}")), allowMissingColumns=True)
    both = both.withColumns({f"_x_{n}": F.coalesce(F.col(f"_x_{n}"), F.col(c).cast("double")) if n in based else F.col(c).cast("double") for n, c in wanted.items()})
    both = both.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_of").isNull(), *order)))
    columns = [*rows.columns, *wanted]

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            group_no = np.cumsum(table["_at"].to_numpy() == 1)
            weight = table["_weight"].to_numpy()
            asks = table["_of"].to_pandas()
            real = weight == 0
            made = {}
            for name in wanted:
                mine = np.flatnonzero(real | (asks == name).to_numpy())
                x = table[f"_x_{name}"].to_pandas().to_numpy(dtype=float)[mine]
                extra = [np.nan_to_num(table[f"_{k}_{name}"].to_pandas().to_numpy(dtype=float)).astype(np.int64)[mine] if name in based else np.zeros(len(mine), dtype=np.int64) for k in ("below", "many")]
                full = np.full(len(real), np.nan)
                full[mine] = medians_of(group_no[mine], weight[mine], x, *extra)
                made[name] = pa.array(full[real], from_pandas=True)
            kept = table.filter(pa.array(real)).select(rows_columns)
            for name, column in made.items():
                kept = kept.append_column(name, column)
            yield from kept.to_batches()

        size = 0
        for batch in given:
            held.append(pa.Table.from_batches([batch]))
            size += len(batch)
            if size < TAKEN:
                continue
            table = pa.concat_tables(held)
            starts = np.flatnonzero(table["_at"].to_numpy() == 1)
            last = int(starts[-1]) if len(starts) else 0  # the last group may go on
            if last:
                yield from out(table.slice(0, last))
            held, size = [table.slice(last)], len(table) - last
        if held:
            yield from out(pa.concat_tables(held))

    rows_columns = list(rows.columns)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in rows_columns], *[f"`{n}` double" for n in wanted]])
    return both.mapInArrow(run, schema).select(*columns)


def past_values(marked: DataFrame, blocks: bl.Blocks, column: str, counts: DataFrame, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What running medians of a cut group's block need of the blocks before: rows (group, _weight, _x), and (group, below, many).

    Of m earlier values and s in the block, the median is always among the earlier ones of ranks m/2 - s to m/2 + s, or in the block. Values are
    cut into ranges; counts by block and range, summed along blocks and ranges, say which ranges hold those ranks; only their values are met.
    counts: (by, _block, _x, _c), how often each value occurs in each block.
    """
    by = blocks.by
    size = counts.groupBy(*by, "_block").agg(F.sum("_c").alias("_s"))
    every = marked.filter("_cut").select(*by, "_block").distinct().join(size, [*by, "_block"], "left").fillna(0, ["_s"])
    m = F.coalesce(F.sum("_s").over(blocks.before()), F.lit(0))
    every = every.withColumn("_m", m)
    low, high = F.greatest(F.lit(0), F.floor((F.col("_m") - 1) / 2) - F.col("_s")), F.least(F.col("_m"), F.floor((F.col("_m") + F.col("_s")) / 2) + 1)
    need = every.withColumns({"_low": low, "_high": high}).filter("_m > 0")
    values = counts.select(*by, "_x").distinct()
    ranges = bl.cut(values, by, ["_x"], block)
    ranged = ranges.on(counts.withColumnRenamed("_block", "_b"))
    ranged = ranged.withColumnRenamed("_block", "_range").drop("_cut") if ranges.split else ranged.withColumn("_range", F.lit(0))
    cells = ranged.groupBy(*by, "_b", "_range").agg(F.sum("_c").alias("_c"))
    # A cell for each block and range of a cut group: at most BLOCKS times BLOCKS, however many rows there are.
    grid = need.join(cells.select(*by, "_range").distinct(), by).join(cells.withColumnRenamed("_b", "_block"), [*by, "_block", "_range"], "left").fillna(0, ["_c"])
    # The first block with values has no past, so it is not in the grid.
    first = cells.join(need.select(*by, F.col("_block").alias("_b")), [*by, "_b"], "left_anti").select(*by, "_range", F.col("_c").alias("_c0"))
    grid = grid.join(first, [*by, "_range"], "left").fillna(0, ["_c0"])
    earlier = F.coalesce(F.sum("_c").over(Window.partitionBy(*by, "_range").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_c0")
    grid = grid.withColumn("_n", earlier)
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_block").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = grid.withColumn("_under", below).filter((F.col("_under") < F.col("_high")) & (F.col("_under") + F.col("_n") > F.col("_low")))
    met = grid.select(*by, "_block", "_range", "_under", "_low", "_high").join(ranged, [*by, "_range"]).filter("_b < _block")
    met = met.groupBy(*by, "_block", "_range", "_under", "_low", "_high", "_x").agg(F.sum("_c").alias("_c"))
    upto = F.col("_under") + F.sum("_c").over(Window.partitionBy(*by, "_block", "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("_upto", upto)
    weight = F.least("_upto", "_high") - F.greatest(F.col("_upto") - F.col("_c"), F.col("_low"))
    return met.withColumn("_weight", weight).filter("_weight > 0").select(*by, "_block", "_weight", "_x"), need.select(*by, "_block", F.col("_low").alias("below"), F.col("_m").alias("many"))
