"""A pipeline that cleans and packs `documents`: each stage calls one operator and decides on all that its predecessor kept.

Defined cases: ids, null or repeated, have no part in verdicts; rows alike in text share theirs, but for the Jaccard stage, which keeps one of them; null,
empty and wordless texts are kept by all stages and pack as their end id alone; very long texts are judged whole; other columns
are carried along, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.llm import decontaminate, jaccard, packing, secretscan, toxicity
from chronofeat.llm.common import cut, read, small

MARK = "[secret]"


def keyed(docs: DataFrame) -> DataFrame:
    """(row, _th, text): whole rows as structs, whatever their columns' names, and a key by content, on which alone verdicts depend."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), F.xxhash64(text).alias("_th"), text.alias("text"))


def without(docs: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """The rows of docs less those whose key is among the rejected doc_ids: operators are given the key, never null, for an id."""
    rejected = rejected.select(F.col("doc_id").alias("_rejected")).distinct()
    return docs.join(small(cut(rejected, "rejected")), F.col(key) == F.col("_rejected"), "left_anti").select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier toxic than not go, judged by their text alone. The model learns from the labelled ones among docs."""
    model = toxicity.train(toxicity.texts_of(docs), read(spark, sf_dir, "labels"))
    docs = keyed(docs)
    scored = toxicity.score_rows(toxicity.texts_of(docs, id_col="_th"), model)
    return without(docs, scored.filter("predicted = 1"), "_th")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) one row stays: that with the smallest id (null last), of those that with the smallest hash of the text, of equal rows any. Documents without words all stay."""
    docs = cut(keyed(docs).select("row", "_th", F.monotonically_increasing_id().alias("_row")), "numbered")
    rows, ids = jaccard.similar_groups(docs.select("_row", "row.text"), 5, 80, id_col="_row")
    id_of = F.col("row.doc_id").cast("long")
    order = docs.select("_row", F.struct(id_of.isNull().alias("none"), id_of.alias("id"), "_th", "_row").alias("rank"))
    groups = rows.filter("n_shingles > 0").join(ids, "unit").select(F.col("doc_id").alias("_row"), "component_id")
    groups = cut(groups.join(order, "_row"), "ranked")
    kept = groups.groupBy("component_id").agg(F.min("rank").alias("least")).select(F.col("least._row").alias("_row"))
    gone = groups.select("_row").join(small(cut(kept, "least")), "_row", "left_anti")
    return without(docs, gone.select(F.col("_row").alias("doc_id")), "_row")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go, judged by their text alone."""
    docs = keyed(docs)
    return without(docs, decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark"), id_col="_th"), "_th")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; documents stay."""
    found, kinds = secretscan.with_spans(docs), dict(docs.dtypes)
    clean = secretscan.redacted(F.col("row.text").cast("string"), F.col("spans"), MARK)
    row = F.col("row").withField("text", clean.cast(kinds["text"]))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length(clean).cast(kinds["n_chars"]))
    return found.select(F.when(F.size("spans") > 0, row).otherwise(F.col("row")).alias("row")).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Training, alignment and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
