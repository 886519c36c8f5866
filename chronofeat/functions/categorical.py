"""Categories and bags of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequency(rows: DataFrame, col: str, name: str) -> DataFrame:
    """Size of the row's category. Counted map side first, then joined back, so that a frequent value is no hot window."""
    counts = rows.groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias(name))
    return rows.join(counts, F.col(col).eqNullSafe(F.col("_v")), "left").drop("_v")


def most_common(rows: DataFrame, col: str, n: int) -> DataFrame:
    """The n most frequent values, ties to the smaller value."""
    return rows.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), col).limit(n)


def label_encode(rows: DataFrame, col: str, order: list[str], name: str) -> DataFrame:
    """Dense ids from 0 in the order in which values first occur; null stays null."""
    from chronofeat.operators.numbering import global_row_number

    first = rows.filter(F.col(col).isNotNull()).groupBy(col).agg(F.min(F.struct(*order)).alias("_f")).select(col, *[F.col("_f")[o].alias(o) for o in order])
    ids = global_row_number(first, order, "_rn").select(F.col(col).alias("_v"), (F.col("_rn") - 1).alias(name))
    return rows.join(ids, rows[col] == ids["_v"], "left").drop("_v")


def is_value(col: str, value) -> Column:
    return F.coalesce((F.col(col) == F.lit(value)).cast("int"), F.lit(0))


def words(col: Column | str, sep: str = ",") -> Column:
    """The words of a bag; an empty string has none, and empty words don't count."""
    return F.filter(F.split(col, sep), lambda w: w != "")


def bag_features(bag: Column) -> dict[str, Column]:
    """Of one bag, without leaving the row."""
    distinct = F.array_distinct(bag)
    counts = F.transform(distinct, lambda w: F.struct(F.size(F.filter(bag, lambda x: x == w)).alias("n"), w.alias("w")))
    best = F.array_sort(counts, lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["w"] < b["w"], -1).when(a["w"] > b["w"], 1).otherwise(0))
    n = F.transform(counts, lambda c: c["n"])
    return {
        "length": F.size(bag),
        "nunique": F.size(distinct),
        "duplicates": F.size(bag) - F.size(distinct),
        "mode": F.get(best, 0)["w"],
        "max_count": F.coalesce(F.array_max(n), F.lit(0)),
        "min_count": F.array_min(n),
    }


def document_frequency(rows: DataFrame, bag: Column) -> DataFrame:
    """word, documents, occurrences."""
    distinct = F.transform(F.array_distinct(bag), lambda w: F.struct(w.alias("word"), F.size(F.filter(bag, lambda x: x == w)).alias("n")))
    return rows.select(F.explode(distinct).alias("d")).groupBy(F.col("d.word").alias("word")).agg(F.count(F.lit(1)).alias("documents"), F.sum("d.n").alias("occurrences"))


def top_word_counts(rows: DataFrame, bag: Column, n: int = 10) -> DataFrame:
    """rows with count_0.. of the n words in most documents, ties to the smaller word; 0 for ranks beyond the vocabulary."""
    top = [r["word"] for r in document_frequency(rows, bag).orderBy(F.desc("documents"), "word").limit(n).collect()]  # n rows
    count = lambda w: F.size(F.filter(bag, lambda x: x == w))
    return rows.withColumns({f"count_{i}": count(top[i]) if i < len(top) else F.lit(0) for i in range(n)})


def bag_statistics(rows: DataFrame, bag: Column) -> DataFrame:
    """One row: words in all, most and mean per row, distinct words."""
    size = rows.select(F.size(bag).alias("n"))
    vocabulary = rows.select(F.explode(bag).alias("w")).agg(F.count_distinct("w").alias("unique_words"))
    return size.agg(F.sum("n").alias("total_words"), F.max("n").alias("max_words"), F.avg("n").alias("mean_words")).crossJoin(F.broadcast(vocabulary))


def word_labels(rows: DataFrame, bag: Column, label: str) -> DataFrame:
    """word, sum of label x count, count; rows with a null label don't count."""
    each = rows.filter(F.col(label).isNotNull()).select(label, F.explode(bag).alias("word"))
    return each.groupBy("word").agg(F.sum(label).alias("labels"), F.count(F.lit(1)).alias("n"))


def count_matrix(rows: DataFrame, row: str, bag: Column) -> DataFrame:
    """(row, word, n), the sparse document by word matrix."""
    return rows.select(row, F.explode(bag).alias("word")).groupBy(row, "word").agg(F.count(F.lit(1)).alias("n"))


def one_hot(rows: DataFrame, col: str, values: list, prefix: str) -> DataFrame:
    return rows.withColumns({f"{prefix}{i}": is_value(col, v) for i, v in enumerate(values)})


def tf_idf(rows: DataFrame, row: str, bag: Column) -> DataFrame:
    """(row, word, weight): count x ln(rows / documents)."""
    n = rows.count()
    matrix = count_matrix(rows, row, bag)
    often = matrix.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return matrix.join(often, "word").select(row, "word", (F.col("n") * F.log(F.lit(n) / F.col("df"))).alias("weight"))




def bucket(word: Column, size: int) -> Column:
    """A number below size by 32 bits of the word's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(size))


def fit_idf(rows: DataFrame, row: str, bag: Column, size: int) -> DataFrame:
    """(bucket, idf): ln(rows / rows with a word of the bucket), fitted once for many tables. A vocabulary of any size becomes `size` numbers."""
    n = rows.count()
    held = rows.select(row, F.explode(F.array_distinct(F.transform(F.filter(bag, lambda w: w.isNotNull()), lambda w: bucket(w, size)))).alias("bucket"))
    return held.groupBy("bucket").agg(F.log(F.lit(float(n)) / F.count(F.lit(1))).alias("idf"))


def hashed_tf_idf(rows: DataFrame, row: str, bag: Column, idf: DataFrame, size: int) -> DataFrame:
    """(row, indices, values): sparse vectors of count x idf by hashed word, in the order of their indices. Words of buckets that idf doesn't know, and bags without words, add nothing."""
    counts = rows.select(row, F.explode(bag).alias("word")).filter("word IS NOT NULL").groupBy(row, bucket(F.col("word"), size).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    weighted = counts.join(F.broadcast(idf), "bucket").select(row, F.struct(F.col("bucket").alias("i"), (F.col("n") * F.col("idf")).alias("v")).alias("cell"))  # idf has at most size rows
    cells = weighted.groupBy(F.col(row).alias("_row")).agg(F.sort_array(F.collect_list("cell")).alias("_cells"))
    out = rows.select(row).join(cells, F.col(row) == F.col("_row"), "left")
    return out.select(row, F.coalesce(F.transform("_cells", lambda c: c["i"]), F.array().cast("array<bigint>")).alias("indices"), F.coalesce(F.transform("_cells", lambda c: c["v"]), F.array().cast("array<double>")).alias("values"))


def heaviest_word(weights: DataFrame, row: str) -> DataFrame:
    """Of (row, word, weight) each row's word of largest weight, alike to nine decimals to the smaller word."""
    best = F.min(F.struct((-F.round("weight", 9)).alias("w"), F.col("word").alias("word")))
    return weights.groupBy(row).agg(best.alias("_b")).select(row, F.col("_b.word").alias("word"), (-F.col("_b.w")).alias("weight"))
