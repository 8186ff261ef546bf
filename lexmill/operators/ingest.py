"""From raw pages to the engine's tables, for many pages at once.

Tables come in and go out as new snapshots; nothing is overwritten. Times and ids are arguments or follow from keys, so
the same batch twice gives the same tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import schemas
from lexmill.functions import authority, dates, hashing
from lexmill.functions.citations import citation_in_text
from lexmill.operators import body, edges, relations, upsert
from lexmill.scratch import written
from lexmill.sources.pages import CENTRAL


@dataclass
class Tables:
    issuing_body: DataFrame
    document: DataFrame
    document_node: DataFrame
    document_reference: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Tables:
        make = lambda s: spark.createDataFrame([], s)
        return Tables(make(schemas.ISSUING_BODY), make(schemas.DOCUMENT), make(schemas.DOCUMENT_NODE), make(schemas.DOCUMENT_REFERENCE))

    def save(self, folder: str) -> None:
        """Writes all tables under a new folder."""
        for name, df in vars(self).items():
            df.write.parquet(f"{folder}/{name}")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Tables:
        return Tables(*(spark.read.parquet(f"{folder}/{n}") for n in ("issuing_body", "document", "document_node", "document_reference")))


def parsed_documents(pages: DataFrame, now: datetime) -> DataFrame:
    """Raw pages in the shape of ``document``, with the issuing body's name and the relation cards; one row per citation,
    the last address where several pages share it. A page without a readable issue date fails the query."""
    rows = relations.consolidation(relations.parse_attributes(pages))
    raw = lambda c: F.col(f"{c}_date_raw")
    refused = F.when(F.col("citation").isNotNull(), F.raise_error(F.concat(F.lit("no issue date: "), F.col("citation"))).cast("date"))
    enacted = F.coalesce(dates.source_date(raw("issued")), refused)
    source = F.struct(F.col("fullText"), F.lit(now.isoformat()).alias("scrapedAt"), F.col("sourceUrl"), F.col("consolidates_raw_titles").alias("consolidatesRawTitles"), F.col("consolidated_into_raw_titles").alias("consolidatedIntoRawTitles"))
    version = hashing.content_version(F.col("fullText"), F.col("citation"), F.col("title"), F.col("validity_status_raw"), F.col("effective_date_raw"), F.col("expiry_date_raw"))
    none, at = F.lit(None), F.lit(now)
    made = rows.select(
        hashing.stable_id(F.col("citation")).alias("id"), F.col("citation").alias("citation_id"), "title", "document_type", hashing.stable_id(F.col("issuing_body")).alias("issuing_body_id"),
        "industry", "field", "signer_name", "signer_title", enacted.alias("enacted_date"), dates.source_date(raw("effective")).alias("effective_date"), dates.source_date(raw("expiry")).alias("expiry_date"),
        none.cast("date").alias("gazette_published_date"), authority.status_code(F.col("validity_status_raw")).alias("status"), F.lit("full").alias("index_scope"),
        (F.size("consolidates_raw_titles") > 0).alias("is_consolidated"), none.cast("string").alias("consolidates_document_id"), source.alias("raw_source"), version.alias("content_version"),
        at.cast("timestamp").alias("created_at"), at.cast("timestamp").alias("updated_at"), "issuing_body", "relations",
    )
    return upsert.latest(made, ["citation_id"], [F.desc("raw_source.sourceUrl"), F.desc("content_version")])


def skipped(pages: DataFrame) -> DataFrame:
    """Pages outside the central scope, with the reason."""
    return pages.filter(F.coalesce(F.col("scope"), F.lit("")) != CENTRAL).select("sourceUrl", F.concat(F.lit("scope is "), F.coalesce("scope", F.lit("missing"))).alias("reason"))


def parted(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages that can be taken, errors (sourceUrl, message) of the others): one broken page doesn't stop a batch.

    A broken page's pairs and cards become null before it is left out, so a parser that the optimizer moves ahead of the
    filter finds nothing to refuse."""
    plain = relations.once(pages, "__pairs", relations.trimmed(F.col("attributes")))
    marked = relations.once(plain, "__problem", relations.page_problem(plain="__pairs")).drop("__pairs")
    good = marked.withColumns({c: F.when(F.col("__problem").isNull(), F.col(c)) for c in ("attributes", "relations")})
    return good.filter("__problem is null").drop("__problem"), marked.filter("__problem is not null").select("sourceUrl", F.col("__problem").alias("message"))


def sync(tables: Tables, pages: DataFrame, now: datetime, insert: bool = True, legacy: bool = False) -> tuple[Tables, DataFrame, DataFrame]:
    """(new tables, outcomes by citation, errors by page): documents by content hash, edges, clause trees of what changed, late targets.

    insert=False updates known documents alone; others are reported as notFound. Trees are parsed for new and changed
    documents and for those without nodes, so texts that stayed the same aren't read again."""
    good, errors = parted(pages.filter(F.col("scope") == CENTRAL))
    docs = written(parsed_documents(good, now), "parsed")
    cols = tables.document.columns
    known = tables.document.select("citation_id")
    taken = docs if insert else docs.join(known, "citation_id", "left_semi")
    bodies = upsert.get_or_create_issuing_bodies(tables.issuing_body, taken.select(F.col("issuing_body").alias("name"))).select(*schemas.ISSUING_BODY.names)
    names = bodies.select(F.col("name").alias("issuing_body"), F.col("id").alias("__body"))
    incoming = taken.drop("issuing_body_id").join(names, "issuing_body").withColumnRenamed("__body", "issuing_body_id")
    kept = tables.document.select(F.col("citation_id"), F.col("id").alias("__id"), F.col("created_at").alias("__created"))
    incoming = incoming.join(kept, "citation_id", "left").withColumns({"id": F.coalesce("__id", "id"), "created_at": F.coalesce("__created", "created_at")})
    merged = written(upsert.upsert(tables.document, incoming.select(cols), "citation_id", "content_version"), "documents")
    document = _consolidated(merged.drop("outcome"))
    outcomes = merged.filter("outcome is not null").select("citation_id", "outcome")
    if not insert:
        outcomes = outcomes.unionByName(docs.join(known, "citation_id", "left_anti").select("citation_id", F.lit(upsert.NOT_FOUND).alias("outcome")))

    ids = document.select("citation_id", F.col("id").alias("document_id"))
    curated = relations.parse_relations(taken.select("citation_id", "relations").join(ids, "citation_id"), "document_id")
    found = edges.split_relations(curated, document)
    texts = merged.filter("outcome is not null").select(F.col("id").alias("document_id"), "citation_id", F.col("raw_source.fullText").alias("full_text"), "outcome", "status", dates.valid_from(F.col("effective_date"), F.col("enacted_date")).alias("valid_from"))
    cited = body.text_references(texts, legacy=legacy)
    targets = document.select(F.col("citation_id").alias("citation"), F.col("id").alias("target_document_id"))
    found = found.unionByName(cited.join(targets, "citation", "left").withColumnRenamed("document_id", "source_document_id").select(*found.columns))
    full = found.select(
        hashing.stable_id(*(F.col(c) for c in ("source_document_id", "target_document_id", "reference_type", "change_type", "raw_citation_text"))).alias("id"), "source_document_id", "target_document_id",
        F.lit(None).cast("string").alias("source_node_id"), F.lit(None).cast("string").alias("target_node_id"), "reference_type", "change_type", "raw_citation_text", "citation",
        F.lit("deterministic").alias("extraction_method"), F.lit(None).cast("float").alias("confidence"), F.lit(now).cast("timestamp").alias("created_at"),
    )
    healed = edges.heal(tables.document_reference, document).drop("healed")
    reference = healed.unionByName(edges.insert_edges(healed, full))

    bare = texts.join(tables.document_node.select("document_id").distinct(), "document_id", "left_anti").select("document_id")
    todo = texts.filter(F.col("outcome") != upsert.UNCHANGED).select("document_id").unionByName(bare).distinct()
    work = texts.join(todo, "document_id", "left_semi")
    tree = body.with_paths(body.clause_nodes(work, legacy=legacy), legacy=legacy).join(work.select("document_id", "status", "valid_from"), "document_id")
    tree = tree.withColumns({"valid_to": F.lit(None).cast("date"), "superseded_by_node_id": F.lit(None).cast("string")}).select(*schemas.DOCUMENT_NODE.names)
    node = tables.document_node.join(todo, "document_id", "left_anti").select(*schemas.DOCUMENT_NODE.names).unionByName(tree)
    return Tables(bodies, document, node, reference), outcomes, errors


def _consolidated(document: DataFrame) -> DataFrame:
    """Binds consolidates_document_id to the first consolidated title whose citation is a document's."""
    titles = document.select("id", F.posexplode("raw_source.consolidatesRawTitles").alias("n", "t")).withColumn("c", citation_in_text(F.col("t")))
    ids = document.select(F.col("citation_id").alias("c"), F.col("id").alias("__hit"))
    first = titles.join(ids, "c").groupBy("id").agg(F.min_by("__hit", "n").alias("__hit"))
    cols = document.columns
    return document.join(first, "id", "left").withColumn("consolidates_document_id", F.coalesce("__hit", "consolidates_document_id")).select(cols)


def report(outcomes: DataFrame, left_out: DataFrame, errors: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: documents by outcome, skipped and broken pages, and edges bound in this batch."""
    counts = outcomes.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in (upsert.INSERTED, upsert.CHANGED, upsert.UNCHANGED, upsert.NOT_FOUND)))
    loose = before.filter("target_document_id is null").select("source_document_id", "reference_type", "raw_citation_text").distinct()
    still = after.filter("target_document_id is null").select("source_document_id", "reference_type", "raw_citation_text")
    healed = loose.join(still, ["source_document_id", "reference_type", "raw_citation_text"], "left_anti").agg(F.count("*").alias("healed"))
    skips = left_out.agg(F.count("*").alias("skipped"))
    return counts.join(skips).join(errors.agg(F.count("*").alias("errors"))).join(healed)  # single rows


def re_extract(tables: Tables, document_ids: DataFrame, now: datetime) -> DataFrame:
    """Edges that the stored texts of the given documents hold and the table doesn't."""
    docs = tables.document.join(document_ids, "id", "left_semi").select(F.col("id").alias("document_id"), "citation_id", F.col("raw_source.fullText").alias("full_text"))
    cited = body.text_references(docs)
    targets = tables.document.select(F.col("citation_id").alias("citation"), F.col("id").alias("target_document_id"))
    rows = cited.join(targets, "citation", "left").withColumnRenamed("document_id", "source_document_id")
    rows = rows.withColumn("id", hashing.stable_id(*(F.col(c) for c in ("source_document_id", "target_document_id", "reference_type", "change_type", "raw_citation_text")))).withColumn("created_at", F.lit(now).cast("timestamp"))
    return edges.insert_edges(tables.document_reference, rows)
