"""Target encodings of categories and of bags of words.

Known targets are those that are not null; m is their mean over all rows, later ones too. k smooths
towards m. Totals per category are grouped and joined back, so a category that a third of all rows
hold is summed map side first. Running totals are kept per category and time bin, not per row.
A null category has a null encoding. Division by zero is null.
source: rows of the same columns that totals and means are taken from, where rows themselves are dear to compute again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofeat.session import stored

#: Rows whose words a task of bag() counts, about; rows of totals that may be broadcast.
TASK, FEW = 1 << 16, 1 << 16
#: Decay times to a stretch of exponential(); e to twice that is still a double.
FADE = 300.0
#: Least share of training rows, and of others, among a category's or word's rows that it isn't one-sided.
SHARE = 0.01


def global_mean(rows: DataFrame, y: str) -> DataFrame:
    return F.broadcast(rows.agg(F.avg(y).alias("_m")))  # one row


def with_mean(rows: DataFrame, y: str, source: DataFrame | None = None) -> DataFrame:
    return rows.crossJoin(global_mean(source or rows, y))


def totals(rows: DataFrame, ids: list[str], y: str, s: str, n: str, valid: Column | None = None, source: DataFrame | None = None) -> DataFrame:
    """rows with sum and number of known targets over rows alike in ids."""
    v = F.col(y) if valid is None else F.when(valid, F.col(y))
    sums = (source or rows).filter(" AND ".join(f"`{i}` IS NOT NULL" for i in ids)).groupBy(*ids).agg(F.coalesce(F.sum(v), F.lit(0.0)).alias(s), F.count(v).alias(n))
    return rows.join(sums, ids, "left")


def past_totals(rows: DataFrame, ids: list[str], y: str, time: str, s: str, n: str, valid: Column | None = None, source: DataFrame | None = None) -> DataFrame:
    """rows with sum and number of known targets over rows alike in ids whose time is strictly smaller."""
    v = F.col(y) if valid is None else F.when(valid, F.col(y))
    bins = (source or rows).groupBy(*ids, time).agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("_s"), F.count(v).alias("_n"))
    before = Window.partitionBy(*ids).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    past = bins.select(*ids, time, F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias(s), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(n))
    return rows.join(past, [*ids, time], "left")


def smooth(s: Column, n: Column, m: Column, k: float | Column) -> Column:
    k = F.lit(float(k)) if isinstance(k, (int, float)) else k
    return F.try_divide(s + m * k, n + k)


def leave_one_out(rows: DataFrame, c: str, y: str, k: float, name: str, source: DataFrame | None = None) -> DataFrame:
    """Mean of the category's other targets, smoothed."""
    t = totals(with_mean(rows, y, source), [c], y, "_s", "_n", source=source)
    own = F.coalesce(F.col(y), F.lit(0.0))
    value = smooth(F.col("_s") - own, F.col("_n") - F.col(y).isNotNull().cast("int"), F.col("_m"), k)
    return t.withColumn(name, F.when(F.col(c).isNotNull(), F.when(F.coalesce("_n", F.lit(0)) == 0, F.col("_m")).otherwise(value))).drop("_s", "_n", "_m")


def whole(rows: DataFrame, c: str, y: str, k: float, name: str) -> DataFrame:
    """Mean of the category's targets, the row's own too, smoothed."""
    t = totals(with_mean(rows, y), [c], y, "_s", "_n")
    value = F.when(F.coalesce("_n", F.lit(0)) == 0, F.col("_m")).otherwise(smooth(F.col("_s"), F.col("_n"), F.col("_m"), k))
    return t.withColumn(name, F.when(F.col(c).isNotNull(), value)).drop("_s", "_n", "_m")


def temporal(rows: DataFrame, c: str, y: str, time: str, k: float, name: str, source: DataFrame | None = None) -> DataFrame:
    """Mean of the category's targets of strictly earlier times, smoothed."""
    t = past_totals(with_mean(rows, y, source), [c], y, time, "_s", "_n", source=source)
    value = F.when(F.coalesce("_n", F.lit(0)) == 0, F.col("_m")).otherwise(smooth(F.col("_s"), F.col("_n"), F.col("_m"), k))
    return t.withColumn(name, F.when(F.col(c).isNotNull(), value)).drop("_s", "_n", "_m")


def exponential(rows: DataFrame, c: str, y: str, time: str, beta: float, k: float, name: str) -> DataFrame:
    """Like temporal(), with sums and counts that decay by exp(-beta x time since).

    Time is cut into stretches of FADE decay times. Sums run within a category's stretch, relative to its start, and the total of the
    stretch before is added; what is older has faded to nothing, so no exponent grows with the span and no category is one group.
    """
    bins = rows.filter(F.col(c).isNotNull() & F.col(time).isNotNull()).groupBy(c, time).agg(F.coalesce(F.sum(y), F.lit(0.0)).alias("_s"), F.count(y).cast("double").alias("_n"))
    x = beta * F.col(time).cast("double")
    bins = bins.withColumn("_b", F.floor(x / FADE)).withColumn("_x", x - F.col("_b") * FADE)
    grown = bins.withColumns({v: F.col(v) * F.exp("_x") for v in ("_s", "_n")})
    before = Window.partitionBy(c, "_b").orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    own = grown.select(c, time, "_b", "_x", *[F.coalesce(F.sum(v).over(before), F.lit(0.0)).alias(v) for v in ("_s", "_n")])
    last = grown.groupBy(F.col(c).alias("_c"), (F.col("_b") + 1).alias("_next")).agg(F.sum("_s").alias("_ls"), F.sum("_n").alias("_ln"))
    joined = own.join(last, (own[c] == last["_c"]) & (own["_b"] == last["_next"]), "left")
    faded = lambda v, w: F.exp(-F.col("_x")) * F.col(v) + F.exp(-F.col("_x") - FADE) * F.coalesce(F.col(w), F.lit(0.0))
    past = joined.select(F.col(c).alias("_c"), F.col(time).alias("_t"), faded("_s", "_ls").alias("_s"), faded("_n", "_ln").alias("_n"))
    base = with_mean(rows, y)
    t = base.join(past, (base[c] == past["_c"]) & (base[time] == past["_t"]), "left")
    value = F.when(F.coalesce("_n", F.lit(0.0)) == 0, F.col("_m")).otherwise(smooth(F.col("_s"), F.col("_n"), F.col("_m"), k))
    return t.withColumn(name, F.when(F.col(c).isNotNull(), value)).drop("_c", "_t", "_s", "_n", "_m")


def valid_categories(rows: DataFrame, c: str, is_train: str, low: float = SHARE, high: float = 1 - SHARE) -> DataFrame:
    """Categories whose share of training rows is neither tiny nor almost all."""
    share = rows.groupBy(F.col(c).alias("_v")).agg(F.avg(F.col(is_train).cast("double")).alias("_share"))
    return share.filter((F.col("_share") >= low) & (F.col("_share") <= high)).select("_v", F.lit(True).alias("_valid"))


def regularized(rows: DataFrame, c: str, y: str, is_train: str, k: float, name: str, time: str | None = None) -> DataFrame:
    """leave_one_out(), or temporal() with a time, where one-sided categories gather no targets."""
    flagged = rows.join(valid_categories(rows, c, is_train), F.col(c) == F.col("_v"), "left").drop("_v").withColumn("_y", F.when(F.coalesce("_valid", F.lit(False)), F.col(y)))
    base = flagged.crossJoin(global_mean(rows, y))
    t = totals(base, [c], "_y", "_s", "_n") if time is None else past_totals(base, [c], "_y", time, "_s", "_n")
    own, one = (F.coalesce("_y", F.lit(0.0)), F.col("_y").isNotNull().cast("int")) if time is None else (F.lit(0.0), F.lit(0))
    value = F.when(F.coalesce("_n", F.lit(0)) == 0, F.col("_m")).otherwise(smooth(F.col("_s") - own, F.col("_n") - one, F.col("_m"), k))
    return t.withColumn(name, F.when(F.col(c).isNotNull(), value)).drop("_s", "_n", "_m", "_y", "_valid")


def factorized(rows: DataFrame, c1: str, c2: str, y: str, k: tuple[float, float, float], name: str, time: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """Mean over the pair of categories, smoothed to the means of either, which are smoothed to m: k = (k0, k1, k2).

    Without a time the row's own target is left out; with one, only strictly earlier rows count.
    """
    k0, k1, k2 = map(float, k)
    t, source = with_mean(rows, y, source), source or rows
    for i, ids in enumerate(([c1], [c2], [c1, c2])):
        t = totals(t, ids, y, f"_s{i}", f"_n{i}", source=source) if time is None else past_totals(t, ids, y, time, f"_s{i}", f"_n{i}", source=source)
    own, one = (F.coalesce(y, F.lit(0.0)), F.col(y).isNotNull().cast("int")) if time is None else (F.lit(0.0), F.lit(0))
    mean = lambda i: F.try_divide(F.col(f"_s{i}") - own, (F.col(f"_n{i}") - one).cast("double"))
    pair = F.try_divide(mean(0) * k1 + mean(1) * k2 + F.col("_s2") - own, k1 + k2 + F.col("_n2") - one)
    value = F.try_divide(pair * (F.col("_n2") - one + k1 + k2) + F.col("_m") * k0, F.col("_n2") - one + k1 + k2 + k0)
    return t.withColumn(name, F.when(F.col(c1).isNotNull() & F.col(c2).isNotNull(), value)).drop("_m", *[f"_{x}{i}" for x in "sn" for i in range(3)])


def told(table: DataFrame) -> DataFrame:
    """A table to be joined with words: broadcast if it has few rows, which are counted."""
    kept = stored(table, "totals")
    return F.broadcast(kept) if kept.count() <= FEW else kept


def bag(rows: DataFrame, row: str, words: str | DataFrame, y: str, k1: float, k2: float, name: str, time: str | None = None, is_train: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """Encoding of a bag of words: totals of its words, weighted by their counts; the row's own part left out, or, with a time, strictly earlier rows only.

    num = sum of c x (T - y c + k1 m_w), den = sum of c x (N - c + k1) over words; the result is (num + k2 m) / (den + k2).
    T and N are a word's target-weighted and plain counts over rows with a known target; m_w is their ratio over all words.
    With is_train, one-sided words (by occurrences in training rows) gather no targets, and leave none out, but still smooth.
    words: a column of rows, or a frame (row, words) of parts of bags, any number to a row, so that no bag is gathered.
    """
    carried = [row, y, *([time] if time else []), *([is_train] if is_train else [])]
    whole, source = isinstance(words, str), source or rows
    parts = source.select(row, F.col(words).alias("words")).filter(F.size("words") > 0) if whole else words
    # As many tasks as keep each at some TASK rows of main, whatever the table's size.
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), source.count() // TASK)
    each = parts.select(row, "words").repartition(tasks, row).select(row, F.explode("words").alias("_w")).groupBy(row, "_w").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    each = stored(each.join(source.select(*carried).hint("merge"), row), "words")
    if is_train:
        share = each.groupBy("_w").agg((F.sum(F.col("_c") * F.col(is_train)) / F.sum("_c")).between(SHARE, 1 - SHARE).alias("_valid"))
        each = each.join(told(share), "_w").withColumn("_y", F.when(F.col("_valid"), F.col(y))).drop(y, "_valid").withColumnRenamed("_y", y)
    known = F.when(F.col(y).isNotNull(), F.col("_c"))
    each = each.withColumns({"_yc": F.col("_c") * F.col(y), "_kc": known})
    if time is None:
        per = each.groupBy("_w").agg(F.coalesce(F.sum("_yc"), F.lit(0.0)).alias("_T"), F.coalesce(F.sum("_kc"), F.lit(0.0)).alias("_N"))
        per = told(per)
        all_words = per.agg(F.try_divide(F.sum("_T"), F.sum("_N")).alias("_mw"))
        each = each.join(per, "_w").crossJoin(F.broadcast(all_words))
        own_y, own_n = F.coalesce("_yc", F.lit(0.0)), F.coalesce("_kc", F.lit(0.0))
    else:
        bins = each.groupBy("_w", time).agg(F.coalesce(F.sum("_yc"), F.lit(0.0)).alias("_t"), F.coalesce(F.sum("_kc"), F.lit(0.0)).alias("_n"))
        before = Window.partitionBy("_w").orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
        past = bins.select("_w", time, F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_T"), F.coalesce(F.sum("_n").over(before), F.lit(0.0)).alias("_N"))
        per_bin = bins.groupBy(time).agg(F.sum("_t").alias("_t"), F.sum("_n").alias("_n"))  # a row per time bin
        upto = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
        mean = per_bin.select(time, F.try_divide(F.coalesce(F.sum("_t").over(upto), F.lit(0.0)), F.coalesce(F.sum("_n").over(upto), F.lit(0.0))).alias("_mw"))
        each = each.join(told(past), ["_w", time]).join(told(mean), time)
        own_y, own_n = F.lit(0.0), F.lit(0.0)
    sums = each.groupBy(row).agg(F.sum(F.col("_c") * (F.col("_T") - own_y + k1 * F.col("_mw"))).alias("_num"), F.max(F.col("_mw").isNull()).alias("_none"), F.sum(F.col("_c") * (F.col("_N") - own_n + k1)).alias("_den"))
    t = with_mean(rows, y, source).join(sums.hint("merge"), row, "left")
    value = F.when(F.col("_den").isNull(), F.col("_m")).when(~F.col("_none"), F.try_divide(F.col("_num") + F.col("_m") * k2, F.col("_den") + k2))
    return t.withColumn(name, F.when(F.col(words).isNotNull(), value) if whole else value).drop("_num", "_den", "_none", "_m")


def through(rows: DataFrame, dst: DataFrame, key: tuple[str, str], c: str) -> DataFrame:
    """rows with the category of the row that they refer to, for encodings of an induced category."""
    from chronofeat.operators.temporal import lookup

    return lookup(rows, dst, key, [(c, c)])


def bag_through(rows: DataFrame, dst: DataFrame, key: tuple[str, str], words: str) -> DataFrame:
    """rows with the bag of the row that they refer to, for bag(); empty where there is none, which encodes to the overall mean."""
    out = through(rows, dst, key, words)
    return out.withColumn(words, F.coalesce(words, F.array().cast(out.schema[words].dataType)))
