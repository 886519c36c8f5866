"""Features of single rows: calendar parts, null flags, logarithm pairs, rank buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofeat.operators.blocks import running_sum
from chronofeat.session import stored

#: Values that Spark may broadcast; by their compressed bytes it would take a hundred times as many.
FEW = 1 << 14
#: Calendar features: the span of the column, in hours, beyond which each is worth having.
HOURS = {"hour": 2, "year": 500 * 24, "dayofyear": 100 * 24, "weekday": 48, "weekend": 48, "quarter_of_day": 8}


def calendar(ts: Column) -> dict[str, Column]:
    return {
        "hour": F.hour(ts),
        "year": F.year(ts),
        "dayofyear": F.dayofyear(ts),
        "weekday": F.weekday(ts),
        "weekend": (F.weekday(ts) >= 5).cast("int"),
        "quarter_of_day": F.floor(F.hour(ts) / 6).cast("int"),
    }


def calendar_features(rows: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """rows with those calendar parts of col that its span allows."""
    span = rows.agg(((F.unix_micros(F.max(F.col(col).cast("timestamp"))) - F.unix_micros(F.min(F.col(col).cast("timestamp")))) / 3.6e9).alias("h")).first()["h"]
    return rows.withColumns({prefix + k: v for k, v in calendar(F.col(col)).items() if span is not None and span > HOURS[k]})


def parse_time(col: str, formats: list[str]) -> Column:
    """A timestamp by the first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(F.col(col), F.lit(f)) for f in formats])


def null_flags(rows: DataFrame, cols: list[str]) -> DataFrame:
    """A 0/1 column for each numeric column that has a null."""
    has = rows.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    return rows.withColumns({f"{c}_is_null": F.col(c).isNull().cast("int") for c in cols if has[c]})


def without_constants(rows: DataFrame, cols: list[str]) -> DataFrame:
    """rows less numeric columns with one distinct value; those with nulls only stay."""
    ends = rows.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in cols]).first()
    return rows.drop(*[c for c in cols if ends[c]["a"] is not None and ends[c]["a"] == ends[c]["b"]])


def log_pair(a: str, b: str, sign: int = 1) -> Column:
    """log1p(a) + log1p(b), or the difference, of nonnegative numbers."""
    return F.log1p(F.col(a)) + sign * F.log1p(F.col(b))


def rank_buckets(rows: DataFrame, col: str, name: str, buckets: int = 100) -> DataFrame:
    """(value, name), by value, to be joined: average rank of the value over (rows / buckets), rounded down. Ranks come from counts per distinct value, summed along ranges of values."""
    counts = stored(rows.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n")), "values")
    size = counts.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("values")).first()
    step = max(1, (size["rows"] or 0) // buckets)
    upto = running_sum(counts, [], [col], F.col("_n"), "_upto")
    mean_rank = F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2
    told = upto.select(col, F.floor(mean_rank / step).alias(name))
    return told.hint("merge") if size["values"] > FEW else told


def rank_bucket(rows: DataFrame, col: str, name: str, buckets: int = 100) -> DataFrame:
    """rows with rank_buckets()."""
    return rows.join(rank_buckets(rows, col, name, buckets), col, "left")
