"""Queries of the streams with keyed state, over tables read as logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.plans.catalog import _EDGE_SQL, _edges, query
from lexmill.scratch import fresh_path
from lexmill.streaming import keyed


@query("""with v as (select user_id::varchar as document_id, event_id as version, event_type as c, value::decimal(18,2)::varchar as h, lag(event_type) over w as pc, lag(value::decimal(18,2)::varchar) over w as ph from events window w as (partition by user_id order by event_id))
select document_id, version, c as id, 'upsert' as action, h as content_hash from v where pc is distinct from c or ph is distinct from h
union all select document_id, version, pc, 'delete', null from v where pc is not null and pc <> c
union all select document_id, version, 'last', 'upsert', version::varchar from v""")
def stream_chunk_diffs(spark, sf_dir):
    """A user's events as versions of a document with two chunks: the event's type with its value, and the last event."""
    c = F.col
    rows = keyed.stream_of(
        spark, f"{sf_dir}/events.parquet", c("user_id").cast("string").alias("document_id"), c("event_id").alias("version"), F.array("event_type", F.lit("last")).alias("ids"),
        F.array(c("value").cast("decimal(18,2)").cast("string"), c("event_id").cast("string")).alias("hashes"),
    )
    return keyed.run_into(keyed.chunk_diffs(rows), fresh_path(spark, "diffs")).select("document_id", "version", "id", "action", "content_hash")


@query(f"""{_EDGE_SQL} select distinct id, case when change_type is null then o_orderkey::varchar else s end as source_document_id, case when change_type is null then s else o_orderkey::varchar end as target_document_id, reference_type
from e join orders on o_orderkey::varchar = t""")
def stream_late_edges(spark, sf_dir):
    """Orders and their lines arrive as one stream; a line waits for the order that its part's number cites. Lines without a change are inbound ones."""
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    citation = lambda c: F.concat(F.lit("O-"), F.col(c).cast("string")).alias("citation")
    order, lines = (keyed.stream_of(spark, f"{sf_dir}/{name}.parquet", "*") for name in ("orders", "lineitem"))
    docs = order.select(citation("o_orderkey"), F.col("o_orderkey").cast("string").alias("document_id"), none("edge_id", "string"), none("own", "string"), none("inbound", "boolean"), none("reference_type", "string"), none("change_type", "string"))
    e = _edges(spark, sf_dir, lines)
    cards = e.select("citation", none("document_id", "string"), F.col("id").alias("edge_id"), F.col("source_document_id").alias("own"), F.col("change_type").isNull().alias("inbound"), "reference_type", "change_type")
    rows = keyed.run_into(keyed.bound_edges(docs.unionByName(cards), salts=2), fresh_path(spark, "late-edges"))
    return rows.select("id", "source_document_id", "target_document_id", "reference_type").dropDuplicates(["id"])
