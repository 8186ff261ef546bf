"""The citation graph's edges: null-safe insertion, binding of late targets, lookups and deletes."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.citations import citation_in_text
from lexmill.functions.hashing import stable_id
from lexmill.operators.search import Filters, matching
from lexmill.scratch import written

OUTGOING, INCOMING, ALL = "outgoing", "incoming", "all"


def edge_key() -> Column:
    """Null-safe key: source, target, type and change of a bound edge; source, type, change and raw text of a dangling one."""
    bound = F.col("target_document_id").isNotNull()
    last = F.when(bound, F.col("target_document_id")).otherwise(F.col("raw_citation_text"))
    return stable_id(bound, F.col("source_document_id"), F.col("reference_type"), F.col("change_type"), last)


def dedup_edges(edges: DataFrame, order: list[str] | None = None, stored: bool = False) -> DataFrame:
    """One edge per key: the least by ``order`` (created_at, then id), null first.

    Of ``stored`` edges, which are cheap to read again, keys are counted as 64-bit hashes first, so nothing but a number
    per row is shuffled; whole rows are compared, by the parts of their keys, only where a hash comes twice. These hashes
    are written first."""
    cols, order = edges.columns, [c for c in order or ["created_at", "id"] if c in edges.columns]
    bound = F.col("target_document_id").isNotNull()
    last = F.when(bound, F.col("target_document_id")).otherwise(F.col("raw_citation_text"))
    parts = F.struct(bound.alias("bound"), "source_document_id", "reference_type", "change_type", last.alias("last"))
    first = F.min_by(F.struct(*cols), F.struct(*(F.col(c) for c in [*order, "raw_citation_text"])))
    if not stored:
        return edges.groupBy(parts.alias("__key")).agg(first.alias("e")).select("e.*")
    marked = edges.withColumn("__hash", F.xxhash64(parts))
    again = marked.groupBy("__hash").agg(F.count("*").alias("__n")).filter("__n > 1").select("__hash")
    again = written(again, "again")  # few as a rule: once they are there, Spark knows it and leaves the edges where they are
    several = marked.join(again, "__hash", "left_semi").groupBy(parts.alias("__key")).agg(first.alias("e")).select("e.*")
    return marked.join(again, "__hash", "left_anti").select(cols).unionByName(several)


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The edges that aren't there yet, each once; nulls equal nulls."""
    keys = edges.select(edge_key().alias("__key"))
    return dedup_edges(new).withColumn("__key", edge_key()).join(keys, "__key", "left_anti").drop("__key")


def split_relations(relations: DataFrame, document: DataFrame) -> DataFrame:
    """Edges from curated relations (document_id, reference_type, change_type, this_is_source, raw_citation_text, citation).

    Outbound ones are kept with a target that may be null; inbound ones only if the other side is known, in this batch
    or before, so the outcome doesn't depend on the order of arrival."""
    ids = document.select(F.col("citation_id").alias("citation"), F.col("id").alias("other_id"))
    common = ["reference_type", "change_type", "raw_citation_text", "citation"]
    out = relations.filter("this_is_source").join(ids, "citation", "left").select(F.col("document_id").alias("source_document_id"), F.col("other_id").alias("target_document_id"), *common)
    back = relations.filter("not this_is_source").join(ids, "citation").select(F.col("other_id").alias("source_document_id"), F.col("document_id").alias("target_document_id"), *common)
    return out.unionByName(back)


def dangling(edges: DataFrame, source: str | None = None, reference_type: str | None = None, raw: str | None = None) -> DataFrame:
    keep = [F.col("target_document_id").isNull()]
    keep += [F.col("source_document_id") == source] if source else []
    keep += [F.col("reference_type") == reference_type] if reference_type else []
    keep += [F.col("raw_citation_text").ilike(f"%{raw}%")] if raw else []
    return edges.filter(reduce(and_, keep))


def dangling_list(edges: DataFrame, document: DataFrame, **filters) -> DataFrame:
    """Dangling edges with their source's citation and title, in no order."""
    side = document.select(F.col("id").alias("source_document_id"), F.col("citation_id").alias("source_citation"), F.col("title").alias("source_title"))
    return dangling(edges, **filters).join(side, "source_document_id", "left")


def page_of(edges: DataFrame, page: int, size: int, newest_first: bool = False) -> DataFrame:
    """A page (from 1) of edges by created_at and id: a top-k, so only as many rows as lie before its end are kept."""
    order = [F.desc("created_at") if newest_first else F.col("created_at"), F.col("id")]
    return edges.orderBy(*order).limit(page * size).offset((page - 1) * size)


def heal(edges: DataFrame, document: DataFrame, citations: list[str] | None = None) -> DataFrame:
    """All edges, dangling ones bound where their citation is a document's; ``healed`` marks the bound ones.

    The citation is the edge's own column or, without one, read from its raw text. Only dangling edges are joined, and
    only edges that share a bound one's source and target are told apart again: of equal ones the first stays. The
    others are taken to be distinct, as insertion leaves them."""
    loose = edges.filter("target_document_id is null").withColumn("__c", F.coalesce(F.col("citation"), citation_in_text(F.col("raw_citation_text"))))
    ids = document.select(F.col("citation_id").alias("__c"), F.col("id").alias("__t")).filter("__c is not null")
    if citations is not None:
        ids = ids.filter(F.col("__c").isin(citations))
    tried = loose.join(ids, "__c", "left").withColumn("healed", F.col("__t").isNotNull()).withColumn("target_document_id", F.col("__t")).drop("__c", "__t")
    bound, still = tried.filter("healed"), tried.filter("not healed")
    ends = ["source_document_id", "target_document_id"]
    before = edges.filter("target_document_id is not null").withColumn("healed", F.lit(False))
    near = bound.select(*ends).distinct()
    changed = dedup_edges(before.join(near, ends, "left_semi").select(*bound.columns).unionByName(bound), ["healed", "created_at", "id"])
    return before.join(near, ends, "left_anti").unionByName(still).unionByName(changed)


def heal_report(edges: DataFrame, document: DataFrame, citations: DataFrame) -> DataFrame:
    """(citation, error, healed, edge_ids): a row per asked citation; unknown ones carry an error."""
    loose = dangling(edges).withColumn("c", F.coalesce(F.col("citation"), citation_in_text(F.col("raw_citation_text")))).select("c", F.col("id").alias("edge_id"))
    ids = document.select(F.col("citation_id").alias("known"))
    joined = citations.join(ids, F.col("citation") == F.col("known"), "left").join(loose, F.col("known") == F.col("c"), "left")
    agg = joined.groupBy("citation").agg(F.count("edge_id").alias("healed"), F.array_sort(F.collect_list("edge_id")).alias("edge_ids"), F.max("known").alias("known"))
    return agg.select("citation", F.when(F.col("known").isNull(), "unknown citation").alias("error"), "healed", "edge_ids")


def references(edges: DataFrame, document: DataFrame, document_ids: DataFrame | None = None, direction: str = OUTGOING, reference_type: str | None = None) -> DataFrame:
    """Edges with both sides' citation and title, of the given documents (column id) or of all. They come in no order: a
    caller that shows a page sorts it by created_at and id, with a limit, instead of the whole table.

    With ``document`` itself as document_ids the joins of names tell the edges of its documents, and edges are shuffled
    by either end alone. In both directions an id that comes again with the same source is one edge."""
    rows = edges if reference_type is None else edges.filter(F.col("reference_type") == reference_type)
    own = document_ids is document
    if document_ids is not None and not own:
        ends = {OUTGOING: ["source_document_id"], INCOMING: ["target_document_id"], ALL: ["source_document_id", "target_document_id"]}[direction]
        wanted = document_ids.select(F.col("id").alias("__id")).distinct()
        parts = [rows.join(wanted, F.col(end) == F.col("__id"), "left_semi") for end in ends]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1].filter(~F.col("source_document_id").eqNullSafe(F.col("target_document_id")))).dropDuplicates(["id"])
    for side in ("source", "target"):
        names = document.select(F.col("id").alias(f"{side}_document_id"), F.col("citation_id").alias(f"{side}_citation"), F.col("title").alias(f"{side}_title"))
        if not own:
            rows = rows.join(names, f"{side}_document_id", "left")
        else:
            needed = direction == {"source": OUTGOING, "target": INCOMING}[side]
            rows = rows.join(names.withColumn(f"__{side}", F.lit(True)), f"{side}_document_id", "inner" if needed else "left")
            if direction == ALL and side == "source":
                rows = rows.dropDuplicates(["source_document_id", "id"])  # where the join has put them: no shuffle of its own
    if own:
        rows = rows.filter("__source or __target") if direction == ALL else rows
        rows = rows.drop("__source", "__target")
    return rows


def delete_documents(document: DataFrame, nodes: DataFrame, edges: DataFrame, ids: DataFrame | None, allow_all: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, nodes, edges left, report). ids has a column id; None means every document and needs allow_all."""
    if ids is None:
        if not allow_all:
            raise ValueError("no ids: pass allow_all=True to delete every document")
        ids = document.select("id")
    asked = ids.select("id").distinct()
    gone = asked.join(document.select("id"), "id", "left_semi")
    n = nodes.select(F.col("document_id").alias("id")).join(gone, "id", "left_semi").groupBy("id").agg(F.count("*").alias("nodes"))
    sides = [edges.select(F.col(f"{end}_document_id").alias("id"), F.col("id").alias("e")).join(gone, "id", "left_semi") for end in ("source", "target")]
    ends = sides[0].unionByName(sides[1]).distinct()
    e = ends.groupBy("id").agg(F.count("*").alias("edges"))
    found = document.select("id", F.lit(True).alias("there"))
    report = asked.join(found, "id", "left").join(n, "id", "left").join(e, "id", "left")
    zero = lambda c: F.when(F.col("there"), F.coalesce(F.col(c), F.lit(0))).otherwise(0)
    report = report.select("id", F.when(F.col("there"), "deleted").otherwise("notFound").alias("outcome"), zero("nodes").alias("nodes_deleted"), zero("edges").alias("references_deleted"))
    left = edges
    for end in ("source_document_id", "target_document_id"):
        left = left.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return document.join(gone, "id", "left_anti"), nodes.join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_anti"), left, report


def delete_matching(document: DataFrame, issuing_body: DataFrame, nodes: DataFrame, edges: DataFrame, f: Filters) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, nodes, edges left, counters matched, deleted, not_found) of a delete by search filters.

    Filters that leave every document match all of them, so empty ones are refused."""
    if f.empty():
        raise ValueError("no filters: delete_documents deletes every document if asked to")
    ids = matching(document, issuing_body, f).select("id").distinct()
    left = delete_documents(document, nodes, edges, ids)
    counts = left[3].agg(F.count("*").alias("matched"), F.count_if(F.col("outcome") == "deleted").alias("deleted"), F.count_if(F.col("outcome") == "notFound").alias("not_found"))
    return *left[:3], counts
