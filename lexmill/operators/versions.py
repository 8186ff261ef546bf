"""Versions of provisions: amendments become validity intervals, and texts are read as they stood on a day.

A change is an insertion or replacement with a text, or a repeal. A provision's version holds from its day to that of the
next change of the provision or of one above it: who replaces or repeals an article thereby ends its clauses. Versions
of one provision never overlap, and each says which change ended it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.tree import ancestors, path_array

INSERT, REPLACE, REPEAL = "insert", "replace", "repeal"
COLUMNS = ["document_id", "path", "action", "text", "source", "effective"]


def original_provisions(nodes: DataFrame, effective: Column) -> DataFrame:
    """A document's own nodes as its first changes; their source is the document itself."""
    return nodes.select("document_id", "path", F.lit(INSERT).alias("action"), F.col("text_content").alias("text"), F.col("document_id").cast("string").alias("source"), effective.alias("effective"))


def intervals(changes: DataFrame) -> DataFrame:
    """(document_id, path, version, text, valid_from, valid_to, source, superseded_by) from changes (COLUMNS).

    valid_to is the first day on which a version no longer holds, null while it does; superseded_by is the source of the
    change that ended it. Changes of one day take effect in the order of their sources, those above a provision before
    its own; a version that ends on its first day never held and is left out, and numbers count those that are left.
    Changes without a day, document or path have no effect, and the repeal of what isn't there has none either."""
    known = changes.filter("effective is not null and document_id is not null and path is not null").select(*COLUMNS)
    own = known.withColumn("depth", F.size(path_array(F.col("path")))).withColumn("own", F.lit(True))
    provisions = known.select("document_id", "path").distinct()
    above = known.filter(F.col("action").isin(REPLACE, REPEAL)).select("document_id", F.col("path").alias("up"), "action", "source", "effective")
    ended = provisions.select("document_id", "path", F.explode(ancestors(F.col("path"))).alias("up")).join(above, ["document_id", "up"])
    ended = ended.select("document_id", "path", "action", F.lit(None).cast("string").alias("text"), "source", "effective", F.size(path_array(F.col("up"))).alias("depth"), F.lit(False).alias("own"))
    order = Window.partitionBy("document_id", "path").orderBy("effective", "source", "depth", "action", F.col("text").asc_nulls_first())
    rows = own.unionByName(ended).withColumns({"valid_to": F.lead("effective").over(order), "superseded_by": F.lead("source").over(order)})
    held = rows.filter(F.col("own") & (F.col("action") != REPEAL) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("effective"))))
    number = F.row_number().over(Window.partitionBy("document_id", "path").orderBy("effective"))
    return held.select("document_id", "path", number.alias("version"), "text", F.col("effective").alias("valid_from"), "valid_to", "source", "superseded_by")


def holds(day: Column) -> Column:
    """Whether a version holds on a day."""
    return (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day))


def as_of(versions: DataFrame, day: Column) -> DataFrame:
    """The versions that hold on one day, a filter that the scan can take."""
    return versions.filter(holds(day))


def texts_as_of(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """(document_id, day, provisions, full_text) of each asked (document_id, day): the texts that held, label by label of
    their paths, one per line. Days on which nothing held have no row."""
    wanted = asked.select("document_id", "day").distinct()
    rows = versions.join(wanted, "document_id").filter(holds(F.col("day")))
    parts = F.array_sort(F.collect_list(F.struct(path_array(F.col("path")).alias("p"), F.coalesce("text", F.lit("")).alias("t"))))
    texts = F.array_join(F.transform(parts, lambda x: x["t"]), "\n")
    return rows.groupBy("document_id", "day").agg(F.count("*").alias("provisions"), texts.alias("full_text"))


def chain(versions: DataFrame) -> DataFrame:
    """(document_id, path, sources): the sources of a provision's versions in order, the newest last."""
    parts = F.array_sort(F.collect_list(F.struct("version", "source")))
    return versions.groupBy("document_id", "path").agg(F.transform(parts, lambda v: v["source"]).alias("sources"))
