"""Leaving out rows of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.scratch import written

#: rows that may be broadcast; more are joined by a shuffle
BROADCAST_ROWS = 200_000


def text_digest(text: Column) -> Column:
    """MD5 of a text; null counts as empty."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def without(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those whose id and text are among rows (id, digest); null ids are equal here. Texts move only if there are too many rows to broadcast."""
    out = written(rows.select(F.col("id").cast("long").alias("__id"), F.col("digest").alias("__digest")).distinct(), "left-out")
    small = out.count() <= BROADCAST_ROWS
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (text_digest(F.col(text_col)) == F.col("__digest"))
    return docs.join(F.broadcast(out) if small else out, same, "left_anti")


def once(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each row of an equal id and text once. rows (id, digest) tells which rows are there; only those that repeat are shuffled."""
    again = written(rows.groupBy("id", "digest").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("__id"), F.col("digest").alias("__digest")), "repeated")
    if again.isEmpty():
        return docs
    small = again.count() <= BROADCAST_ROWS
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (text_digest(F.col(text_col)) == F.col("__digest"))
    side = F.broadcast(again) if small else again
    single = docs.join(side, same, "left_semi").withColumn("__digest", text_digest(F.col(text_col))).dropDuplicates([id_col, "__digest"]).drop("__digest")
    return docs.join(side, same, "left_anti").unionByName(single)
