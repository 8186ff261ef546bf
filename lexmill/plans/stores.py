"""Queries of stored responses, and of tables that are synced more than once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import ingest
from lexmill.plans.catalog import query, table
from lexmill.plans.statutes import _GOOD, _pages, _text
from lexmill.scratch import fresh_path
from lexmill.sources import responses
from lexmill.streaming import keyed


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    return table(spark, sf_dir, "pages").select("url", (200 + k % 3).cast("int").alias("status"), F.lit("text/html").alias("media"), F.col("html").alias("body"), (k % 2).alias("odd"))


def _read() -> list[F.Column]:
    return [F.octet_length("body").cast("long").alias("bytes"), F.sha1(F.col("body").cast("binary")).alias("digest")]


@query("select url, (200 + page_id % 3)::int as status, 'text/html' as media, strlen(html)::bigint as bytes, sha1(html) as digest from pages")
def stored_responses(spark, sf_dir):
    """All pages as stored responses, read back."""
    fmt, path = responses.register(spark), fresh_path(spark, "store")
    _fetched(spark, sf_dir).write.format(fmt).mode("append").save(path)
    return spark.read.format(fmt).load(path).select("url", "status", "media", *_read())


@query("select page_id % 2 as append, url, (200 + page_id % 3)::int as status, strlen(html)::bigint as bytes, sha1(html) as digest from pages")
def stream_stored_responses(spark, sf_dir):
    """Pages with even numbers are stored, then the others; a stream takes each part once, going on where it ended."""
    fmt, path, folder = responses.register(spark), fresh_path(spark, "store"), fresh_path(spark, "taken")
    for odd in (0, 1):
        _fetched(spark, sf_dir).filter(F.col("odd") == odd).write.format(fmt).mode("append").save(path)
        got = keyed.run_into(spark.readStream.format(fmt).load(path), folder)
    return got.select(F.col("batch").cast("long").alias("append"), "url", "status", *_read())


def _citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _pages(spark, sf_dir).withColumn("fullText", _text("LUẬT\nChương I. A\nĐiều 1. B theo Luật số ", k + 1, "/2020/QH15 và ", F.col("title")))


def _synced(spark: SparkSession, sf_dir: str) -> ingest.Tables:
    tables, _, _ = ingest.sync(ingest.Tables.empty(spark), _citing(spark, sf_dir).drop("k"), datetime(2026, 1, 2))
    folder = fresh_path(spark, "synced")
    tables.save(folder)
    return ingest.Tables.load(spark, folder)


_NODES = f"with c as (select c_custkey as k, c_name as name from customer), g as (select * from c where k % 11 <> 0 and {_GOOD})"


def _number() -> F.Column:
    return F.split("citation_id", "/")[0].cast("long")


@query(f"""{_NODES}, n as (select k, 'chuong1' as path, 'A' as heading from g union all select k, 'chuong1.dieu1', 'B theo Luật số ' || (k + 1) || '/2020/QH15 và ' || name from g union all select k, 'chuong1.dieu2', 'C' from g where k % 3 = 0)
select k || '/2024/QH15' as citation, path, heading, case when k % 2 = 0 then 'con_hieu_luc' end as status, (date '2024-02-01' + (k % 28)::int)::varchar as valid_from from n""")
def resynced_nodes(spark, sf_dir):
    """Trees after a second batch: texts with numbers that three divides have one more article; a fifth of all trees was lost in between and comes back."""
    tables, k = _synced(spark, sf_dir), F.col("k")
    lost = tables.document.filter(_number() % 5 == 0).select(F.col("id").alias("document_id"))
    tables.document_node = tables.document_node.join(lost, "document_id", "left_anti")
    more = _citing(spark, sf_dir).withColumn("fullText", F.when(k % 3 == 0, F.concat("fullText", F.lit("\nĐiều 2. C"))).otherwise(F.col("fullText"))).drop("k")
    after, _, _ = ingest.sync(tables, more, datetime(2026, 1, 3))
    docs = after.document.select(F.col("id").alias("document_id"), F.col("citation_id").alias("citation"))
    return after.document_node.join(docs, "document_id").select("citation", "path", "heading", "status", F.col("valid_from").cast("string").alias("valid_from"))


@query(f"{_NODES} select k || '/2024/QH15' as source, 'cites' as reference_type, (k + 1) || '/2020/QH15' as citation from g where k % 2 = 0")
def re_extracted_edges(spark, sf_dir):
    """Half of the edges that texts hold were lost: reading the stored texts again gives these, and none that is there."""
    tables = _synced(spark, sf_dir)
    lost = tables.document.filter(_number() % 2 == 0).select(F.col("id").alias("source_document_id"))
    cited = tables.document_reference.filter("reference_type = 'cites'")
    kept = tables.document_reference.filter("reference_type <> 'cites'").unionByName(cited.join(lost, "source_document_id", "left_anti"))
    tables.document_reference = kept
    found = ingest.re_extract(tables, tables.document.select("id"), datetime(2026, 1, 3))
    docs = tables.document.select(F.col("id").alias("source_document_id"), F.col("citation_id").alias("source"))
    return found.join(docs, "source_document_id").select("source", "reference_type", "citation")
