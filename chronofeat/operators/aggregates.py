"""Aggregate modes: what each gives for a group of rows, and running along time.

Null values are skipped by all modes. A group without rows has the mode's default: 0 for
`sum`, `variance` and `nunique`, else null.

Running aggregates of a group with very many rows go by blocks (`blocks`): windows run within a block, and the state of all earlier
blocks is carried to it: moments by merging them, extremes, counts of values, the last rows; running medians look up the few
earlier values that can still be the median. Nothing is sorted again for a row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofeat.operators.blocks import Blocks
from chronofeat.operators.medians import past_values, running_medians

MODES = ("sum", "variance", "max", "min", "mean", "median", "nunique", "duplicates", "last", "mode", "mode_ratio", "kurtosis", "skewness", "rolling_sum10", "rolling_mean10", "delay10")
ZERO = {"sum", "variance", "nunique"}
#: Modes whose result depends on the order of rows.
ORDERED = {"last", "mode", "rolling_sum10", "rolling_mean10", "delay10"}
TRAILING = 10
COUNTED = {"nunique": "long", "duplicates": "long"}
#: A user's modes: from a column to one aggregate expression, which also runs over a window's frame.
Own = Mapping[str, Callable[[Column], Column]]
NO_OWN: Own = MappingProxyType({})

#: Modes that are one built-in aggregate, of a group and of a running frame alike.
PLAIN: Own = MappingProxyType(
    {
        "sum": lambda x: F.sum(x),
        "variance": lambda x: F.var_pop(x),
        "max": lambda x: F.max(x),
        "min": lambda x: F.min(x),
        "mean": lambda x: F.avg(x),
        "kurtosis": lambda x: F.kurtosis(x),
        "skewness": lambda x: F.skewness(x),
    }
)
MOMENTS = {"variance", "kurtosis", "skewness"}
FREQUENCY = {"nunique", "duplicates", "mode", "mode_ratio"}


def with_default(mode: str, value: Column) -> Column:
    return F.coalesce(value, F.lit(0)) if mode in ZERO else value


def check(mode: str, own: Own = NO_OWN) -> str:
    if mode in MODES and mode in own:
        raise ValueError(f"aggregate {mode!r} is there already")
    if mode not in MODES and mode not in own:
        raise ValueError(f"unknown aggregate {mode!r}; known: {', '.join([*MODES, *own])}")
    return mode


def moments(n: Column, mean: Column, variance: Column, skewness: Column, kurtosis: Column) -> Column:
    """(n, mean, m2, m3, m4) of a set, the last three as sums of powers of distances from its mean."""
    v = F.when(variance > 0, variance)
    zero = F.lit(0.0)
    return F.struct(n.cast("double").alias("n"), F.coalesce(mean, zero).alias("mean"), F.coalesce(v * n, zero).alias("m2"), F.coalesce(skewness * n * F.pow(v, F.lit(1.5)), zero).alias("m3"), F.coalesce((kurtosis + 3) * n * v * v, zero).alias("m4"))


def merged(a: Column, b: Column) -> Column:
    """Moments of the union of two sets."""
    n = a["n"] + b["n"]
    d = b["mean"] - a["mean"]
    m2 = a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n
    m3 = a["m3"] + b["m3"] + F.pow(d, F.lit(3)) * a["n"] * b["n"] * (a["n"] - b["n"]) / (n * n) + 3 * d * (a["n"] * b["m2"] - b["n"] * a["m2"]) / n
    m4 = a["m4"] + b["m4"] + F.pow(d, F.lit(4)) * a["n"] * b["n"] * (a["n"] * a["n"] - a["n"] * b["n"] + b["n"] * b["n"]) / F.pow(n, F.lit(3))
    m4 = m4 + 6 * d * d * (a["n"] * a["n"] * b["m2"] + b["n"] * b["n"] * a["m2"]) / (n * n) + 4 * d * (a["n"] * b["m3"] - b["n"] * a["m3"]) / n
    both = F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"))
    return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both)


def of_moments(mode: str, m: Column) -> Column:
    if mode == "variance":
        return F.when(m["n"] > 0, m["m2"] / m["n"])
    v = F.when(m["m2"] > 0, m["m2"] / m["n"])
    return m["m3"] / m["n"] / F.pow(v, F.lit(1.5)) if mode == "skewness" else m["m4"] / m["n"] / (v * v) - 3


def running(rows: DataFrame, key: list[str], order: list[str], wanted: list[tuple[str, str, str]], own: Own = NO_OWN, blocks: Blocks | None = None) -> DataFrame:
    """rows with a column for each (name, column, mode): the mode over the key's rows up to this one.

    All columns share one partitioning and sort; medians add a pass over it. Rows with a null in a column keep the state before them. blocks: where
    keys with very many rows are cut; a user's modes know no state to carry, and see their key in one window.
    """
    for _, _, mode in wanted:
        check(mode, own)
    blocks = blocks or Blocks(key, order)
    given, cut, at = rows.columns, blocks.split, F.struct(*order)
    rows = blocks.on(rows)
    g = blocks.group
    of = lambda modes: list(dict.fromkeys(c for _, c, m in wanted if m in modes))
    up_to = Window.partitionBy(*g).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    frequent, counted = of(FREQUENCY), of({*MODES} - {"max", "min", "last", "median"})

    # How often each value of a column occurs by block, and before the block.
    prior = {}
    if cut:
        for c in dict.fromkeys([*frequent, *of({"median"})]):
            seen = rows.filter(F.col("_cut") & F.col(c).isNotNull()).groupBy(*key, "_block", F.col(c).alias("_x")).agg(F.count(F.lit(1)).alias("_c"), F.max(at).alias("_o"))
            before = Window.partitionBy(*key, "_x").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
            prior[c] = seen.withColumn("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)))

    medians = {f"_median_{c}": c for c in of({"median"})}
    if medians:
        past, marked = {}, rows
        for name, c in medians.items() if cut else ():
            values = prior[c].select(*key, "_block", F.col("_x").cast("double").alias("_x"), "_c").groupBy(*key, "_block", "_x").agg(F.sum("_c").alias("_c"))
            past[name], sizes = past_values(rows, blocks, c, values)
            marked = blocks.carried(marked, sizes.withColumnsRenamed({"below": f"_below_{name}", "many": f"_many_{name}"}), [f"_below_{name}", f"_many_{name}"])
        rows = running_medians(marked, g, order, medians, past)

    for c in frequent if cut else ():
        side = prior[c].select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*key, "_block", "_x"])], F.col("_p").alias(f"_p_{c}"))
        rows = rows.join(side, [rows[k] == side[f"_k{i}"] for i, k in enumerate([*key, "_block", c])], "left").drop(*[f"_k{i}" for i in range(len(key) + 2)])
    extra = {f"_n_{c}": F.count(c).over(up_to) for c in counted}
    for c in frequent:
        same = Window.partitionBy(*g, c).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        extra[f"_f_{c}"] = F.when(F.col(c).isNotNull(), F.count(c).over(same) + (F.coalesce(f"_p_{c}", F.lit(0)) if cut else 0))
        extra[f"_new_{c}"] = (F.count(c).over(same) == 1) & F.col(c).isNotNull() & (F.coalesce(f"_p_{c}", F.lit(0)) == 0 if cut else F.lit(True))
    rows = rows.withColumns(extra) if extra else rows

    columns = {}
    for c in of({"sum", "mean", "rolling_sum10", "rolling_mean10"} if cut else {"sum"}):
        columns[f"_sum_{c}"] = F.sum(c).over(up_to)
    for c in of(MOMENTS) if cut else ():
        columns[f"_moments_{c}"] = moments(F.count(c).over(up_to), *[PLAIN[m](F.col(c)).over(up_to) for m in ("mean", "variance", "skewness", "kurtosis")])
    for c in frequent:
        columns[f"_distinct_{c}"] = F.count(F.when(F.col(f"_new_{c}"), 1)).over(up_to)
        # The value whose count was last to reach the running maximum.
        columns[f"_top_{c}"] = F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(f"_f_{c}").alias("f"), at.alias("o"), F.col(c).alias("x")))).over(up_to)
    for c in of({"rolling_sum10", "rolling_mean10", "delay10"}):
        # Collected over as many rows as have the last TRAILING numbers.
        recent = Window.partitionBy(*g).orderBy(f"_n_{c}").rangeBetween(-(TRAILING - 1), 0)
        columns[f"_recent_sum_{c}"] = F.sum(c).over(recent)
        columns[f"_recent_first_{c}"] = F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(f"_n_{c}").alias("n"), F.col(c).alias("x")))).over(recent)["x"]
    for _, c, mode in wanted:
        if mode in ("max", "min") or (not cut and mode in PLAIN and mode != "sum"):
            columns[f"_{mode}_{c}"] = PLAIN[mode](F.col(c)).over(up_to)
        elif mode == "last":
            columns[f"_last_{c}"] = F.last(c, ignorenulls=True).over(up_to)
        elif mode in own:
            columns[f"_{mode}_{c}"] = own[mode](F.col(c)).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns(columns)
    if cut:
        rows = with_carried(rows, blocks, at, wanted, prior, of)

    out = {}
    for name, c, mode in wanted:
        n = F.col(f"_n_{c}") if c in counted else None
        if mode == "median":
            v = F.col(f"_median_{c}")
        elif mode == "nunique":
            v = F.col(f"_distinct_{c}")
        elif mode == "duplicates":
            v = F.nullif(n, F.lit(0)) - F.col(f"_distinct_{c}")
        elif mode == "mode":
            v = F.col(f"_top_{c}")["x"]
        elif mode == "mode_ratio":
            v = F.col(f"_top_{c}")["f"] / F.nullif(n, F.lit(0))
        elif mode == "rolling_sum10":
            v = F.col(f"_recent_sum_{c}")
        elif mode == "rolling_mean10":
            v = F.col(f"_recent_sum_{c}") / F.nullif(F.least(n, F.lit(TRAILING)), F.lit(0))
        elif mode == "delay10":
            v = F.when(n >= TRAILING, F.col(f"_recent_first_{c}"))
        elif mode == "mean" and cut:
            v = F.col(f"_sum_{c}") / F.nullif(n, F.lit(0))
        elif mode in MOMENTS and cut:
            v = of_moments(mode, F.col(f"_moments_{c}"))
        else:
            v = F.col(f"_{mode}_{c}")
        out[name] = with_default(mode, v)
    return rows.withColumns(out).select(*given, *out)


def with_carried(rows: DataFrame, blocks: Blocks, at: Column, wanted: list[tuple[str, str, str]], prior: dict[str, DataFrame], of) -> DataFrame:
    """rows of blocks, with the states of earlier blocks merged into theirs."""
    key, before = blocks.by, blocks.before()
    recent = of({"rolling_sum10", "rolling_mean10", "delay10"})
    ends = {}
    for c in dict.fromkeys(c for _, c, _ in wanted):
        ends[f"_e_n_{c}"] = F.count(c)
    for c in of({"sum", "mean", "rolling_sum10", "rolling_mean10"}):
        ends[f"_e_sum_{c}"] = F.sum(c)
    for c in of(MOMENTS):
        ends[f"_e_moments_{c}"] = moments(F.count(c), *[PLAIN[m](F.col(c)) for m in ("mean", "variance", "skewness", "kurtosis")])
    for c in of({"max"}):
        ends[f"_e_max_{c}"] = F.max(c)
    for c in of({"min"}):
        ends[f"_e_min_{c}"] = F.min(c)
    for c in of({"last"}):
        ends[f"_e_last_{c}"] = F.max_by(c, F.when(F.col(c).isNotNull(), at))
    table = blocks.totals(rows, *[v.alias(k) for k, v in ends.items()])
    for c in of(FREQUENCY):
        by_block = prior[c].groupBy(*key, "_block").agg(F.count(F.when(F.col("_p") == 0, 1)).alias(f"_e_distinct_{c}"), F.max(F.struct((F.col("_p") + F.col("_c")).alias("f"), F.col("_o").alias("o"), F.col("_x").alias("x"))).alias(f"_e_top_{c}"))
        table = table.join(by_block, [*key, "_block"], "left")
    for c in recent:
        some = rows.filter(F.col("_cut") & F.col(c).isNotNull()).select(*key, "_block", at.alias("_o"), F.col(c).alias("_x")).withColumn("_back", F.row_number().over(Window.partitionBy(*key, "_block").orderBy(F.desc("_o")))).filter(F.col("_back") <= TRAILING)
        lists = some.groupBy(*key, "_block").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("b"), "_x"))), lambda s: s["_x"]).alias(f"_e_tail_{c}"))
        table = table.join(lists, [*key, "_block"], "left")
    carry = {f"_c_n_{c}": F.sum(f"_e_n_{c}").over(before) for c in dict.fromkeys(c for _, c, _ in wanted)}
    carry |= {f"_c_sum_{c}": F.sum(f"_e_sum_{c}").over(before) for c in of({"sum", "mean", "rolling_sum10", "rolling_mean10"})}
    nothing = F.struct(*[F.lit(0.0).alias(x) for x in ("n", "mean", "m2", "m3", "m4")])
    carry |= {f"_c_moments_{c}": F.aggregate(F.collect_list(f"_e_moments_{c}").over(before), nothing, merged) for c in of(MOMENTS)}
    carry |= {f"_c_max_{c}": F.max(f"_e_max_{c}").over(before) for c in of({"max"})} | {f"_c_min_{c}": F.min(f"_e_min_{c}").over(before) for c in of({"min"})}
    carry |= {f"_c_last_{c}": F.last(f"_e_last_{c}", ignorenulls=True).over(before) for c in of({"last"})}
    for c in of(FREQUENCY):
        carry |= {f"_c_distinct_{c}": F.sum(f"_e_distinct_{c}").over(before), f"_c_top_{c}": F.max(f"_e_top_{c}").over(before)}
    for c in recent:
        kind = dict(rows.dtypes)[c]
        carry[f"_c_tail_{c}"] = F.aggregate(F.collect_list(f"_e_tail_{c}").over(before), F.array().cast(f"array<{kind}>"), lambda a, b: F.slice(F.concat(a, b), F.greatest(F.lit(1), F.size(a) + F.size(b) - TRAILING + 1), TRAILING))
    rows = blocks.carried(rows, table.select(*key, "_block", *[v.alias(k) for k, v in carry.items()]), list(carry))

    plus = lambda a, b: F.coalesce(F.col(a) + F.col(b), F.col(a), F.col(b))
    new = {f"_n_{c}": F.col(f"_n_{c}") + F.coalesce(f"_c_n_{c}", F.lit(0)) for c in dict.fromkeys(c for _, c, _ in wanted) if f"_n_{c}" in rows.columns}
    new |= {f"_sum_{c}": plus(f"_sum_{c}", f"_c_sum_{c}") for c in of({"sum", "mean", "rolling_sum10", "rolling_mean10"})}
    new |= {f"_moments_{c}": F.when(F.col(f"_c_moments_{c}").isNull(), F.col(f"_moments_{c}")).otherwise(merged(F.col(f"_c_moments_{c}"), F.col(f"_moments_{c}"))) for c in of(MOMENTS)}
    new |= {f"_max_{c}": F.greatest(f"_max_{c}", f"_c_max_{c}") for c in of({"max"})} | {f"_min_{c}": F.least(f"_min_{c}", f"_c_min_{c}") for c in of({"min"})}
    new |= {f"_last_{c}": F.coalesce(f"_last_{c}", f"_c_last_{c}") for c in of({"last"})}
    for c in of(FREQUENCY):
        new |= {f"_distinct_{c}": F.col(f"_distinct_{c}") + F.coalesce(f"_c_distinct_{c}", F.lit(0)), f"_top_{c}": F.greatest(f"_top_{c}", f"_c_top_{c}")}
    for c in recent:
        n, tail = F.col(f"_n_{c}"), F.col(f"_c_tail_{c}")  # n: of the block's own rows
        short = (n < TRAILING) & (F.size(tail) > 0)
        some = F.slice(tail, F.greatest(F.lit(1), F.size(tail) - (TRAILING - n) + 1).cast("int"), TRAILING)
        more = F.aggregate(some, F.lit(0.0), lambda a, x: a + x.cast("double")) if dict(rows.dtypes)[c] in ("double", "float") else F.aggregate(some, F.lit(0).cast(dict(rows.dtypes)[f"_recent_sum_{c}"]), lambda a, x: (a + x).cast(dict(rows.dtypes)[f"_recent_sum_{c}"]))
        own_sum = F.coalesce(F.when(n > 0, F.col(f"_recent_sum_{c}")), F.lit(0))
        new[f"_recent_sum_{c}"] = F.when(short, own_sum + more).otherwise(F.col(f"_recent_sum_{c}"))
        new[f"_recent_first_{c}"] = F.when(short & (n + F.size(tail) >= TRAILING), F.try_element_at(tail, (n - TRAILING).cast("int"))).otherwise(F.col(f"_recent_first_{c}"))
    return rows.withColumns(new)


def grouped(rows: DataFrame, key: list[str], order: list[str], wanted: list[tuple[str, str, str]], own: Own = NO_OWN, blocks: Blocks | None = None) -> DataFrame:
    """One row per key, with a column for each (name, column, mode). Unordered modes aggregate directly, map side first; others are the running state of the key's last row."""
    rest = [w for w in wanted if check(w[2], own) in ORDERED or w[2] == "mode_ratio"]
    distinct = [w for w in wanted if w[2] in COUNTED]
    out = None
    # Distinct counts multiply the rows that they are taken from, so they go apart from what else a row holds.
    for part in ([w for w in wanted if w not in rest and w not in distinct], distinct):
        aggs = []
        for name, col, mode in part:
            x = F.col(col)
            if mode in PLAIN or mode in own:
                v = (PLAIN[mode] if mode in PLAIN else own[mode])(x)
            elif mode == "median":
                v = F.median(x)
            elif mode == "nunique":
                v = F.count_distinct(x)
            else:
                v = F.nullif(F.count(x), F.lit(0)) - F.count_distinct(x)
            aggs.append(with_default(mode, v).alias(name))
        if aggs:
            done = rows.groupBy(*key).agg(*aggs)
            out = done if out is None else out.join(done, key)
    if rest:
        names = [w[0] for w in rest]
        state = F.struct(*names)
        last = running(rows, key, order, rest, own, blocks).groupBy(*key).agg((F.max_by(state, F.struct(*order)) if order else F.first(state)).alias("_last")).select(*key, *[F.col("_last")[n].alias(n) for n in names])
        out = last if out is None else out.join(last, key)
    return out
