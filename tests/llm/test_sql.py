"""Queries with SQL counterparts, over the smallest tables and over odd rows."""

import hashlib
import math
import os

import duckdb
import pytest

from cohortloom.llm import archive, mixing, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _canonical(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)
    return sorted(columns), sorted(tuple(cell(row[i]) for i in order) for row in data)


def _same(df, con, sql):
    cursor = con.execute(sql)
    want = _canonical([d[0] for d in cursor.description], cursor.fetchall())
    assert _canonical(df.columns, df.collect()) == want
    return len(want[1])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    assert _same(queries.QUERIES[name](spark, SF_DIR), con, queries.ORACLES[name])


PAGES = [
    (1, "http://a", "x" * 1200), (2, "http://b", "x" * 1200), (3, None, "x" * 1200), (4, "u\r\nv", "small"), (5, "u", "small"),
    (6, "u", None), (7, "u", ""), (8, "é", "é" * 600), (9, "é", "é" * 600), (10, "r", "y" * 2000), (10, "r", "y" * 2000), (11, "z", "x" * 999), (12, "z", "x" * 999),
]


def test_archive_of_odd_pages(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    pages = spark.createDataFrame([(*p, "own") for p in PAGES], "page_id long, url string, html string, digest string")
    assert _same(archive.archived(pages), con, archive.ORACLE_SQL) == len(PAGES)
    assert archive.archived(pages.limit(0)).count() == 0
    archive.write_archive(pages, str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a/payloads"))
    assert stored.count() == len({p[2] or "" for p in PAGES})  # bytes once, ties and small ones too
    records = {r["page_id"]: bytes(r["record"]) for r in archive.read_records(spark, str(tmp_path / "a")).collect()}
    assert records[3].endswith(b"\r\n\r\n" + b"x" * 1200 + b"\r\n\r\n") and b"WARC-Type: response" in records[3]
    refers = b"WARC-Refers-To: <urn:page:3>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    sha = hashlib.sha1(b"x" * 1200).hexdigest().encode()
    assert records[3] == (
        b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:3>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: \r\n"
        b"WARC-Payload-Digest: sha1:" + sha + b"\r\nX-Payload-Length: 1200\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 1200\r\n\r\n" + b"x" * 1200 + b"\r\n\r\n")
    assert records[1] == (
        b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" + refers + b"WARC-Target-URI: http://a\r\n"
        b"WARC-Payload-Digest: sha1:" + sha + b"\r\nX-Payload-Length: 1200\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    assert records[1].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n") and b"WARC-Refers-To: <urn:page:3>" in records[1]


def test_damaged_payload_is_found(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:1], "page_id long, url string, html string")
    archive.write_archive(pages, str(tmp_path / "a"))
    bad = spark.read.parquet(str(tmp_path / "a/payloads")).selectExpr("digest", "cast('other' AS binary) AS payload")
    bad.write.parquet(str(tmp_path / "b"))
    os.rename(tmp_path / "a/payloads", tmp_path / "a/old")
    os.rename(tmp_path / "b", tmp_path / "a/payloads")
    with pytest.raises(Exception, match="missing or damaged"):
        archive.read_records(spark, str(tmp_path / "a")).select("verified").collect()


def test_mixture_of_odd_rows(spark, docs, rows, none):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r[:5] for r in rows])
    assert _same(mixing.mixture_report(docs), con, mixing.ORACLE_SQL) > 40
    assert mixing.mix(docs).columns == docs.columns and {r["copy"] for r in mixing.mix(docs).collect()} == {"own"}
    assert mixing.mix(none).count() == 0


def test_mixture_reaches_its_weights(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text", "if(id % 10 < 9, 'big', if(id % 100 = 9, 'rare', 'mid')) AS source")
    mixed = mixing.mix(docs, {"big": 1.0, "rare": 2.0, "mid": 1.0, "absent": 5.0}, rows=40_000)
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    total = sum(counts.values())
    assert abs(total - 40_000) < 1500 and abs(counts["rare"] / total - 0.5) < 0.02 and abs(counts["big"] / total - 0.25) < 0.02
    per_doc = {r["doc_id"]: r["count"] for r in mixed.where("source = 'rare'").groupBy("doc_id").count().collect()}
    mean = sum(per_doc.values()) / 40  # a mean of 500 copies comes from several draws
    assert abs(mean - 500) < 25
    assert "absent" not in counts and mixing.mix(docs, {"big": 1.0}).select("source").distinct().count() == 1
    keys = [r["shuffle_key"] for r in mixing.mixture_report(docs.selectExpr("*", "'en' AS lang", "1L AS n_chars")).select("shuffle_key").collect()]
    assert keys == sorted(keys)
