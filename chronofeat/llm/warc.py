"""WARC: a content-addressed archive.

`write_archive` stores each payload once under its SHA-256, and the exact header
block of each record apart from it. `read_archive` joins both and gives back
the original records byte for byte. A record is a `response`, or a `revisit` of
the response with the same payload and the smallest id, if the payload has at
least `min_revisit` bytes.

Defined cases: a null payload is empty; a null id is written as an empty record
id, sorts after all others, and refers to or is referred to like any other;
rows that repeat an id and payload are both responses or both revisits; very long
payloads are stored and rebuilt whole, one row each; an empty table gives an empty
archive; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofeat.session import shared_folder

CRLF = "\r\n"
#: WARC-Date of records whose table has no time; every record must have one.
DATE = "1970-01-01T00:00:00Z"


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_revisit: int = 100, date_col: str | None = None) -> None:
    """Two Parquet tables under path: payloads(digest, payload) and records(id, header, digest). date_col: the time of capture; without it, and where it is null, records are dated DATE."""
    body = F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "UTF-8")
    date = F.coalesce(F.date_format(F.col(date_col), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(DATE)) if date_col else F.lit(DATE)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), body.alias("payload"), date.alias("date"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # One row per digest: the map side already folds copies, so a payload that a third of all pages share is no hot group.
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    light = rows.select("id", "url", "date", "digest", F.octet_length("payload").cast("long").alias("n"))
    firsts = light.filter(F.col("n") >= min_revisit).groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    light = light.join(firsts, "digest", "left")
    again = F.col("first_id").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first_id")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, "0").otherwise(F.col("n").cast("string"))),
        F.lit(CRLF),
    )
    light.select("id", F.encode(head, "UTF-8").alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """record (bytes as a WARC file holds them), header, payload (the full one, revisits too) and `intact`: the digest holds."""
    payloads = spark.read.parquet(f"{path}/payloads").withColumn("intact", F.sha2("payload", 256) == F.col("digest"))
    joined = spark.read.parquet(f"{path}/records").join(payloads, "digest", "left")
    head = F.decode("header", "UTF-8")
    return joined.select(
        F.nullif(F.regexp_extract(head, r"WARC-Record-ID: <urn:page:(-?\d*)>", 1), F.lit("")).cast("long").alias("id"),
        F.regexp_extract(head, r"WARC-Type: (\w+)", 1).alias("record_type"),
        F.nullif(F.regexp_extract(head, r"WARC-Refers-To: <urn:page:(-?\d*)>", 1), F.lit("")).cast("long").alias("refers_to"),
        "header",
        "payload",
        "digest",
        F.coalesce("intact", F.lit(False)).alias("intact"),
    )


def record_bytes() -> F.Column:
    """The record as a WARC file holds it: header block, the payload unless it is a revisit, two line ends."""
    return F.concat("header", F.when(F.col("record_type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload")), F.encode(F.lit(CRLF * 2), "UTF-8"))


def rebuilt(archive: DataFrame) -> DataFrame:
    """read_archive() with `record` and `body`: what a reader finds in a response's record after its header, by the header's Content-Length; null where record and header disagree. A revisit's body is what it refers to."""
    length = F.regexp_extract(F.decode("header", "UTF-8"), r"\r\nContent-Length: (\d+)\r\n", 1).cast("int")
    rows = archive.withColumn("record", record_bytes())
    whole = F.octet_length("record") == F.octet_length("header") + length + len(CRLF * 2)
    found = F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(F.substr("record", F.octet_length("header") + 1, length))
    return rows.withColumn("body", F.when(whole, found))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    digest = F.sha2("body", 256)
    return rebuilt(read_archive(spark, path)).select(
        F.col("id").alias("page_id"),
        F.octet_length("body").cast("long").alias("payload_bytes"),
        F.when(F.col("intact") & (digest == F.col("digest")), digest).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


SQL = {
    "op4_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to
FROM q"""
}
