"""Counters and summaries of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(rows: DataFrame, outcome: str, values: list[str]) -> DataFrame:
    """One row: how many rows have each outcome, and how many there are."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col(outcome) == v).alias(v) for v in values))


def all_flag(rows: DataFrame, key: str, ok: Column, name: str) -> DataFrame:
    """Per key: the rows, and whether there are some and all hold."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.bool_and(ok).alias(name))


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; minima are combined before the shuffle."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def coverage(parts: DataFrame, whole: DataFrame, key: str, part_text: str, whole_size: Column) -> DataFrame:
    """Share of a document's text that its parts hold; 0 for documents without parts."""
    held = parts.groupBy(key).agg(F.sum(F.char_length(part_text)).alias("held"))
    return whole.select(key, whole_size.alias("size")).join(held, key, "left").select(key, (F.coalesce("held", F.lit(0)) / F.nullif("size", F.lit(0))).alias("coverage"))


def capped(rows: DataFrame, order: list[Column], limit: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(the first ``limit`` rows, the rest): a top-k, and an anti-join against its keys, which are at most ``limit``."""
    taken = rows.orderBy(*order).limit(limit)
    return taken, rows.join(F.broadcast(taken.select(key)) if limit <= 100_000 else taken.select(key), key, "left_anti")
