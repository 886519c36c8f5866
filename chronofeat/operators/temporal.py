"""Point-in-time joins and aggregates.

Both sides carry a time column. A source row sees the rows of its key whose time is at
most its own. States run along the destination's rows only, then the latest state
is carried over to source rows in one sort of both sides; no join condition compares times, so a busy
key costs its rows, not their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofeat.operators import blocks
from chronofeat.operators.aggregates import NO_OWN, ORDERED, ZERO, Own, grouped, running

HOUR = 3_600
#: Rows to a block of trailing counts.
TRAIL_BLOCK = 1 << 15


def seconds_since(ts: str | Column, start: Column) -> Column:
    """Seconds, with fractions, of a timestamp since start (another timestamp or literal)."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (micros(ts) - micros(start)) / F.lit(1e6)


def time_units(seconds: Column) -> dict[str, Column]:
    """Whole seconds, minutes, hours and days; negative ones round down too."""
    whole = F.floor(seconds)
    return {"second": whole, "minute": F.floor(whole / 60), "hour": F.floor(whole / HOUR), "day": F.floor(whole / (24 * HOUR))}


def latest_state(src: DataFrame, dst: DataFrame, src_key: str, dst_key: str, src_time: str, dst_time: str, order: list[str], state: list[str], strict: bool = False, block: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """src with the columns `state` of the last dst row, by (time, order), that it sees. With strict, only rows of earlier times are seen.

    A null in a state column is carried like any value. Source rows with a null key or time see nothing. A key with very many rows is cut into blocks of time,
    and a block's first rows see the last state of the blocks before. keys: (_key) of both sides, if cheaper to count; None is to look, an empty frame that no key is to be cut.
    """
    packed = F.struct(*[F.col(c) for c in state])
    others = [f"_o{i}" for i in range(len(order))]
    left = src.select(F.col(src_key).alias("_key"), F.col(src_time).alias("_time"), F.lit(0 if strict else 1).alias("_tag"), F.struct(*src.columns).alias("_src"), *[F.lit(None).alias(o) for o in others])
    seen = left.filter(F.col("_key").isNotNull() & F.col("_time").isNotNull())
    right = dst.filter(F.col(dst_key).isNotNull() & F.col(dst_time).isNotNull()).select(F.col(dst_key).alias("_key"), F.col(dst_time).alias("_time"), F.lit(1 if strict else 0).alias("_tag"), packed.alias("_state"), *[F.col(c).alias(o) for c, o in zip(order, others, strict=True)])
    both = seen.unionByName(right, allowMissingColumns=True)
    whole = ["_time", "_tag", *others]
    found = both.withColumn("_own", F.xxhash64("_src"))  # tells source rows of one time apart
    cuts = blocks.cut(found, ["_key"], [*whole, "_own"], block, keys)
    found = cuts.on(found)
    w = Window.partitionBy(*cuts.group).orderBy(*whole, *(["_own"] if cuts.split else [])).rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("_seen", F.last("_state", ignorenulls=True).over(w))
    if cuts.split:
        at = F.when(F.col("_state").isNotNull(), F.struct(*whole))
        last = cuts.totals(found, F.max_by("_state", at).alias("_e")).withColumn("_carry", F.last("_e", ignorenulls=True).over(cuts.before()))
        found = cuts.carried(found, last, ["_carry"]).withColumn("_seen", F.coalesce("_seen", "_carry"))
    found = found.filter(F.col("_src").isNotNull()).select("_src", F.col("_seen").alias("_state"))
    blind = left.filter(F.col("_key").isNull() | F.col("_time").isNull()).select("_src").unionByName(found.limit(0), allowMissingColumns=True)
    return found.unionByName(blind).select("_src.*", *[F.col("_state")[c].alias(c) for c in state])


def asof_lookup(src: DataFrame, dst: DataFrame, key: tuple[str, str], time: tuple[str, str], order: list[str], columns: list[tuple[str, str]], block: int | None = None) -> DataFrame:
    """As-of join, backward and inclusive: each (name, column) of the latest visible row, nulls included."""
    renamed = dst.select(*{key[1], time[1], *order}, *[F.col(c).alias(n) for n, c in columns])
    return latest_state(src, renamed, key[0], key[1], time[0], time[1], order, [n for n, _ in columns], block=block)


def asof_aggregate(src: DataFrame, dst: DataFrame, key: tuple[str, str], time: tuple[str, str], order: list[str], wanted: list[tuple[str, str, str]], own: Own = NO_OWN, block: int | None = None) -> DataFrame:
    """Running aggregates (name, column, mode) over the visible rows of the key; all in one pass over each side. own: modes of the user's.

    Keys of over two blocks of rows, on both sides together, are cut into blocks of time.
    """
    clean = dst.select(*dict.fromkeys([key[1], time[1], *order, *[c for _, c, _ in wanted]])).filter(F.col(key[1]).isNotNull() & F.col(time[1]).isNotNull())
    keys = clean.select(F.col(key[1]).alias("_key")).unionAll(src.filter(F.col(key[0]).isNotNull()).select(F.col(key[0]).alias("_key")))
    over = keys.groupBy("_key").count().filter(F.col("count") > 2 * (block or blocks.BLOCK)).limit(1).count()
    none = keys.limit(0)
    along = list(dict.fromkeys([time[1], *order]))
    cuts = blocks.cut(clean, [key[1]], along, block, None if over else clean.limit(0))
    states = running(clean, [key[1]], along, wanted, own, cuts).select(*dict.fromkeys([key[1], time[1], *order]), *[w[0] for w in wanted])
    out = latest_state(src, states, key[0], key[1], time[0], time[1], order, [w[0] for w in wanted], block=block, keys=keys if over else none)
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n, _, m in wanted if m in ZERO})


def lookup(src: DataFrame, dst: DataFrame, key: tuple[str, str], columns: list[tuple[str, str]], order: list[str] | None = None, large: bool = False) -> DataFrame:
    """Left join to one: each (name, column) of the key's row; of several, of the last by order. Spark broadcasts dst if its size allows; large: both sides are shuffled.

    Spark goes by compressed bytes, of which a table of a million keys has few, while the driver holds a hundred times as much.
    """
    kept = dst.filter(F.col(key[1]).isNotNull())
    row = F.struct(*[F.col(c).alias(n) for n, c in columns])
    kept = kept.groupBy(F.col(key[1]).alias("_key")).agg((F.max_by(row, F.struct(*order)) if order else F.first(row)).alias("_row"))
    kept = kept.hint("merge") if large else kept
    return src.join(kept, src[key[0]] == kept["_key"], "left").select(*[src[c] for c in src.columns], *[F.col("_row")[n].alias(n) for n, _ in columns])


def aggregate(src: DataFrame, dst: DataFrame, key: tuple[str, str], wanted: list[tuple[str, str, str]], order: list[str] | None = None, own: Own = NO_OWN, large: bool = False) -> DataFrame:
    """Left join to many: aggregates (name, column, mode) over all rows of the key. large: as in lookup()."""
    clean = dst.filter(F.col(key[1]).isNotNull())
    ordered = [m for _, _, m in wanted if m in ORDERED or m == "mode_ratio"]
    cuts = blocks.cut(clean, [key[1]], order) if ordered and order else None
    done = grouped(clean, [key[1]], order or [], wanted, own, cuts).withColumnRenamed(key[1], "_key")
    done = done.hint("merge") if large else done
    out = src.join(done, src[key[0]] == done["_key"], "left").drop("_key")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n, _, m in wanted if m in ZERO})


def squash(src: DataFrame, hops: list[tuple[DataFrame, str, str]], key: str, name: str) -> DataFrame:
    """Follow to-one hops (table, its id, its next key) from key: the last key, null where a hop finds nothing."""
    out = src.withColumn(name, F.col(key))
    for table, own, onward in hops:
        step = lookup(out.select(*src.columns, F.col(name).alias("_at")), table, ("_at", own), [("_on", onward)])
        out = step.select(*src.columns, F.col("_on").alias(name))
    return out


def merge_order(left: DataFrame, right: DataFrame, time: str, left_first: bool) -> DataFrame:
    """Both sides in time order, with `is_left`; on ties the chosen side first, null times last."""
    both = left.withColumn("is_left", F.lit(True)).unionByName(right.withColumn("is_left", F.lit(False)))
    return both.orderBy(F.col(time).asc_nulls_last(), F.col("is_left").desc() if left_first else F.col("is_left"))


def inherit_time(src: DataFrame, dst: DataFrame, key: tuple[str, str], time: str, name: str, large: bool = False) -> DataFrame:
    """An untimed table takes the time of the row that it refers to."""
    return lookup(src, dst, key, [(name, time)], large=large)


def trailing_count(rows: DataFrame, col: str, order: list[str], neighbours: int, name: str) -> DataFrame:
    """How often the row's value occurs among the last `neighbours` rows of the whole table's order, itself included."""
    from chronofeat.operators.numbering import global_row_number

    # Windows hold a value's rows of one block of row numbers, and of the block before those that its first rows look back to.
    size = max(neighbours, TRAIL_BLOCK)
    numbered = global_row_number(rows, order, "_rn").withColumn("_b", F.floor(F.col("_rn") / size))
    tail = F.floor((F.col("_rn") + neighbours - 1) / size) > F.col("_b")
    both = numbered.withColumn("_own", F.explode(F.when(tail, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    both = both.withColumn("_b", F.when(F.col("_own"), F.col("_b")).otherwise(F.col("_b") + 1))
    w = Window.partitionBy(col, "_b").orderBy("_rn").rangeBetween(-(neighbours - 1), 0)
    return both.withColumn(name, F.count(F.lit(1)).over(w)).filter("_own").drop("_rn", "_b", "_own")


def sequential_regression(src: DataFrame, dst: DataFrame, key: tuple[str, str], time: tuple[str, str], order: list[str], value: str, name: str) -> DataFrame:
    """Slope of time on value over the rows of the key seen so far; null for fewer than two different values."""
    w = Window.partitionBy(key[1]).orderBy(time[1], *order).rowsBetween(Window.unboundedPreceding, 0)
    states = dst.filter(F.col(key[1]).isNotNull() & F.col(time[1]).isNotNull()).withColumn(name, F.regr_slope(F.col(time[1]), F.col(value)).over(w))
    return latest_state(src, states, key[0], key[1], time[0], time[1], order, [name])
