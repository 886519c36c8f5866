"""Statistics that features are kept or dropped by."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofeat.operators.blocks import cut, quantiles, running_sum, running_sums
from chronofeat.operators.target_encoding import whole
from chronofeat.session import stored


def auc_of(rows: DataFrame, score: str, label: str, by: list[str] | None = None, block: int | None = None, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve (`auc`), of groups if `by` is given; rows with a null or non-finite score or null label don't count. weight: how many rows a row stands for.

    Ranks come from counts per distinct score, summed along ranges of scores, so equal scores share their average rank and no task holds all scores of a feature.
    """
    by = by or []
    each = F.col(weight) if weight else F.lit(1)
    ok = rows.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & (F.abs(F.col(score).cast("double")) < float("inf")) & F.col(label).isNotNull())
    counts = stored(ok.groupBy(*by, F.col(score).alias("_x")).agg(F.sum(F.col(label).cast("double") * each).alias("_p"), F.sum(each).cast("double").alias("_n")), "scores")
    upto = running_sum(counts, by, ["_x"], F.col("_n"), "_upto", cut(counts, by, ["_x"], block))
    ranked = upto.withColumn("_r", F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2)
    p, n = F.sum("_p"), F.sum("_n")
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("_r") * F.col("_p")) - p * (p + 1) / 2, p * (n - p)).alias("auc"))


def unpivoted(rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """A row (feature, value) for each feature of each row."""
    return rows.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("_f")).select(*keep, "_f.feature", "_f.value")


def auc_table(rows: DataFrame, features: list[str], label: str, weight: str | None = None) -> DataFrame:
    """(feature, auc) of all features in one pass. Features go by their number, so that their names aren't shuffled with every value."""
    values = F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("_at", "value")
    found = auc_of(rows.select(label, *([weight] if weight else []), values), "value", label, ["_at"], weight=weight)
    return found.select(F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_at") + 1).alias("feature"), "auc")


def drift(rows: DataFrame, numbers: list[str], categories: list[str], is_test: str) -> DataFrame:
    """Per feature: how well it tells test from training rows, and test over training ratios of deviation and of distinct values. Categories are encoded by the label first."""
    encoded = reduce(lambda d, c: whole(d, c, "_t", 1, f"_e_{c}"), categories, rows.withColumn("_t", F.col(is_test).cast("double")))
    named = encoded.select("_t", *numbers, *[F.col(f"_e_{c}").alias(c) for c in categories])
    long = unpivoted(named, [*numbers, *categories], ["_t"])
    test, train = F.when(F.col("_t") == 1, F.col("value")), F.when(F.col("_t") == 0, F.col("value"))
    spread = long.groupBy("feature").agg(F.try_divide(F.stddev_pop(test), F.stddev_pop(train)).alias("std_ratio"), F.try_divide(F.count_distinct(test).cast("double"), F.count_distinct(train).cast("double")).alias("nunique_ratio"))
    return spread.join(auc_of(long, "value", "_t", ["feature"]), "feature")


def selected(drifts: DataFrame, most: float = 0.3) -> DataFrame:
    """drift() with `keep`: little drift by AUC, and both ratios within a factor of three."""
    ratio = lambda c: F.coalesce((F.col(c) >= 1 / 3) & (F.col(c) <= 3), F.lit(False))
    return drifts.withColumn("keep", F.coalesce(F.abs(F.col("auc") - 0.5) < most, F.lit(False)) & ratio("std_ratio") & ratio("nunique_ratio"))


def key_hash(key: str) -> Column:
    """32 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")


def stratified_sample(rows: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """About n rows: of each label its share of n, rounded up; the ones with the smallest hashes of their keys.

    Counts by label and leading bits of the hash say which buckets are taken whole; only the bucket at the edge is ranked.
    """
    marked = rows.withColumn("_h", key_hash(key)).withColumn("_b", F.shiftright("_h", 20))
    counts = marked.groupBy(F.col(label).alias("_label"), F.col("_b").alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy("_label")
    want = F.ceil(F.lit(n) * F.sum("_n").over(by) / F.sum("_n").over(Window.partitionBy(F.lit(1))))
    before = F.coalesce(F.sum("_n").over(by.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = counts.select("_label", "_bucket", "_n", want.alias("_want"), before.alias("_before")).filter("_before < _want")  # 4096 rows a label at most
    near = marked.join(F.broadcast(edges), marked[label].eqNullSafe(edges["_label"]) & (marked["_b"] == edges["_bucket"]))
    rank = F.row_number().over(Window.partitionBy("_label", "_b").orderBy("_h", key))
    whole = near.filter("_before + _n <= _want")
    part = near.filter("_before + _n > _want").withColumn("_r", rank).filter("_before + _r <= _want")
    return whole.select(*rows.columns).unionByName(part.select(*rows.columns))


def random_split(rows: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """rows with `is_valid`, for a share of the keys that depends on the key alone."""
    return rows.withColumn("is_valid", (key_hash(key) < int(share * (1 << 32))).cast("int"))


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.2) -> DataFrame:
    """rows with `is_valid`, for the share of each label's rows, rounded up."""
    total = rows.count()
    chosen = stratified_sample(rows.select(label, key), label, key, -(-int(share * total * 1000) // 1000)).select(F.col(key).alias("_chosen")).distinct()
    return rows.join(chosen, rows[key] == chosen["_chosen"], "left").withColumn("is_valid", F.col("_chosen").isNotNull().cast("int")).drop("_chosen")


def gates(rows: DataFrame, features: list[str], label: str, is_test: str, least: float = 0.0001, most: float = 0.3) -> DataFrame:
    """(feature, gain, drift, keep): distance from chance of the AUC against the label and against being a test row. Kept are features that tell the label and not the test rows."""
    x, labels = F.col("value"), {"gain": label, "drift": is_test}
    long = rows.select(*labels.values(), F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("_at", "value"))
    sums = [g for n, c in labels.items() for g in (F.sum(F.col(c).cast("double")).alias(f"_p_{n}"), F.count(c).cast("double").alias(f"_n_{n}"))]
    # As in auc_of(), both areas from one count of values.
    counts = stored(long.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).groupBy("_at", x.alias("_x")).agg(*sums), "scores")
    upto = running_sums(counts, ["_at"], ["_x"], {f"_upto_{n}": F.col(f"_n_{n}") for n in labels}, cut(counts, ["_at"], ["_x"]))
    areas = []
    for n in labels:
        p, all_, rank = F.sum(f"_p_{n}"), F.sum(f"_n_{n}"), F.col(f"_upto_{n}") - F.col(f"_n_{n}") + (F.col(f"_n_{n}") + 1) / 2
        areas.append(F.abs(F.try_divide(F.sum(rank * F.col(f"_p_{n}")) - p * (p + 1) / 2, p * (all_ - p)) - 0.5).alias(n))
    both = upto.groupBy("_at").agg(*areas).select(F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_at") + 1).alias("feature"), *labels)
    return both.withColumn("keep", F.coalesce((F.col("gain") > least) & (F.col("drift") <= most), F.lit(False)))


def feature_limit(train: int, test: int) -> int:
    """Features that a job of these row counts should make at most."""
    return int(min(4.5e8 / max(1, train), 8e8 / max(1, train + test), 70 * math.log10(max(1, train)) + 200))


def category_limit(rows: DataFrame, y: str) -> DataFrame:
    """One row: the most values that a category may have in the model, the 0.3th power of the rarer class's rows."""
    c = rows.agg(F.coalesce(F.sum(y), F.lit(0)).alias("p"), F.coalesce(F.sum(1 - F.col(y)), F.lit(0)).alias("n"))
    return c.select(F.floor(F.least(F.pow("p", F.lit(0.3)), F.pow("n", F.lit(0.3)))).cast("long").alias("limit"))


def time_split(rows: DataFrame, time: str, share: float = 0.2) -> DataFrame:
    """rows with `is_valid`: the last share of rows by time."""
    cutoff = quantiles(rows, [time], 1 - share)[time]
    return rows.withColumn("is_valid", (F.col(time).cast("double") > F.lit(cutoff)).cast("int"))


def log_pair_gain(rows: DataFrame, numbers: list[str], label: str, least: float = 0.01, most: int = 10) -> DataFrame:
    """Pairs of nonnegative numbers whose log1p sum or difference separates the label better than either alone: (a, b, sign, gain), the best `most`. Values alike to nine decimals are ties."""
    from chronofeat.functions.scalar import log_pair

    ends = rows.agg(*[F.min(c).alias(c) for c in numbers]).first()
    fine = [c for c in numbers if ends[c] is not None and ends[c] >= 0]
    pairs = [(a, b, s) for i, a in enumerate(fine) for b in fine[i + 1 :] for s in (1, -1)]
    alike = rows.groupBy(label, *fine).agg(F.count(F.lit(1)).alias("_alike"))  # what follows is per different row
    wide = alike.select(label, "_alike", *fine, *[F.round(log_pair(a, b, s), 9).alias(f"_p{i}") for i, (a, b, s) in enumerate(pairs)])
    table = {r["feature"]: r["auc"] for r in auc_table(wide, [*fine, *[f"_p{i}" for i in range(len(pairs))]], label, "_alike").collect()}  # a row per feature
    far = lambda f: abs(table[f] - 0.5) if table.get(f) is not None else 0.0
    gains = [(a, b, s, far(f"_p{i}") - max(far(a), far(b))) for i, (a, b, s) in enumerate(pairs)]
    best = sorted((g for g in gains if g[3] >= least), key=lambda g: (-g[3], g[:3]))[:most]
    return rows.sparkSession.createDataFrame(best, "a string, b string, sign int, gain double")
