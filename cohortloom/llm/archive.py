"""Content-addressed web archive: payload bytes once by strong digest, record headers apart, records by join.

``write_archive`` makes two tables in one folder:

* ``payloads``: digest (SHA-256), payload; one row per different payload.
* ``headers``: page_id, digest, header; the exact header bytes of every record.

``read_records`` joins them back to the original records.  Every payload read is digested anew and compared with its
key, and its SHA-1 and length with what the header says; a difference fails the job, so equal keys mean equal bytes.

Defined results: null html is an empty payload; a null url is an empty one, line ends in a url become spaces; a null
page_id is written as ``null`` and never the largest; of equal rows that are the largest all are responses (their
bytes are still kept once); an empty table makes an empty archive; further columns are not archived.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortloom.session import lineage_dir, written

LEAST_REVISIT = 1000  # payload bytes from which an equal payload becomes a revisit
END = "\r\n"
DATE = "1970-01-01T00:00:00Z"  # of the capture, where the pages do not say it
#: fixed values of the format
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTENT_TYPE = "text/html; charset=utf-8"


def _records(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(
        "page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " ").alias("url"), payload.alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))


def _header(kind: Column, refers: Column, date: str) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    return F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", kind), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        F.when(refers.isNotNull(), F.concat(
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers.cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("X-Payload-Length", F.col("n_bytes").cast("string")), line("Content-Type", F.lit(CONTENT_TYPE)),
        line("Content-Length", F.when(kind == "revisit", "0").otherwise(F.col("n_bytes").cast("string"))), F.lit(END),
    ).cast("binary")


def write_archive(pages: DataFrame, folder: str, least_revisit: int = LEAST_REVISIT, date: str = DATE) -> None:
    """Write ``pages`` (page_id, url, html), captured at ``date``, as an archive.

    The bytes are not shuffled: digests alone are grouped, and the pages whose payload another page keeps are taken
    out by an anti join on a written list, which is broadcast only if it is small.
    """
    small = written(
        _records(pages).select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes")),
        "archive_digests",
    )
    keepers = written(
        small.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("same"))
        .groupBy("digest").agg(F.max(F.struct("page_id", "same")).alias("top")).select("digest", F.col("top.page_id").alias("keeper"), F.col("top.same").alias("same")),
        "archive_keepers",
    )
    known = small.join(keepers, "digest")
    moved = (F.col("n_bytes") >= least_revisit) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    kind = F.when(moved, "revisit").otherwise("response")
    known.select("page_id", "digest", _header(kind, F.when(moved, F.col("keeper")), date).alias("header")).write.parquet(f"{folder}/headers")

    others = written(known.where(~F.col("page_id").eqNullSafe(F.col("keeper"))).select("page_id", "digest").distinct(), "archive_others")
    ties = written(keepers.where("same > 1").select("digest"), "archive_ties")
    null_safe = [F.col("p.page_id").eqNullSafe(F.col("o.page_id")), F.col("p.digest") == F.col("o.digest")]
    kept = _records(pages).alias("p").join(others.alias("o"), null_safe, "left_anti").select("digest", "payload")
    once = kept.join(ties, "digest", "left_anti").unionByName(kept.join(ties, "digest", "left_semi").dropDuplicates(["digest"]))
    once.write.option("compression", "zstd").parquet(f"{folder}/payloads")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, record (the exact bytes), header, payload (of the page, also for a revisit), verified."""
    headers = spark.read.schema("page_id long, digest string, header binary").parquet(f"{folder}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    checked = payloads.withColumn("found", F.sha2("payload", 256))
    joined = headers.join(checked, "digest", "left")
    text = F.decode("header", "UTF-8")
    fault = F.when(F.col("found").isNull() | (F.col("found") != F.col("digest")), F.raise_error(F.lit("payload missing or damaged")).cast("boolean"))
    block = F.when(F.regexp_extract(text, r"\r\nWARC-Type: (\w+)\r\n", 1) == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select(
        "page_id", "header", "payload", F.concat("header", block, F.lit(f"{END}{END}".encode())).alias("record"),
        F.coalesce(fault, F.lit(True)).alias("verified"),
    )


def archived(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write the pages, read the archive back, and say of every record what its bytes hold."""
    spark = pages.sparkSession
    folder = f"{lineage_dir(spark)}/cohortloom/archive-{uuid.uuid4().hex}"
    write_archive(pages, folder, least_revisit)
    records = read_records(spark, folder)
    text = F.decode("header", "UTF-8")
    field = lambda name, value: F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1)
    stated, length = field("WARC-Payload-Digest", "sha1:([0-9a-f]+)"), field("X-Payload-Length", r"(\d+)").cast("long")
    same = (F.sha1("payload") == stated) & (F.octet_length("payload") == length)
    number = lambda name: F.when(field(name, r"<urn:page:(-?\d+)>") != "", field(name, r"<urn:page:(-?\d+)>").cast("long"))
    return records.where(F.col("verified")).select(
        number("WARC-Record-ID").alias("page_id"),
        F.when(same, length).otherwise(F.raise_error(F.lit("header and payload differ")).cast("long")).alias("payload_bytes"),
        stated.alias("payload_digest"), field("WARC-Type", r"(\w+)").alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
        (F.octet_length("record") - F.octet_length("header")).cast("long").alias("block_bytes"),
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     q AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
                  max(page_id) OVER (PARTITION BY sha256(body)) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 4 ELSE payload_bytes + 4 END AS block_bytes
FROM q
"""
