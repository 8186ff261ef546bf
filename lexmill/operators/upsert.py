"""Idempotent writes by content hash, as new snapshots. Parquet has no row updates: write the result to a new path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions.authority import authority_rank
from lexmill.functions.hashing import stable_id

INSERTED, CHANGED, UNCHANGED, NOT_FOUND = "inserted", "changed", "unchanged", "notFound"


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in that order, which should be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert(current: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """The new snapshot and each row's outcome: incoming rows replace current ones of another version, rows of the same
    version stay as they are. incoming has one row per key and the columns of current."""
    cols = current.columns
    old, new = current.select(F.struct(*cols).alias("old"), F.col(key).alias("k1")), incoming.select(F.struct(*cols).alias("new"), F.col(key).alias("k2"))
    both = old.join(new, F.col("k1") == F.col("k2"), "full_outer")
    same = F.col(f"old.{version}").eqNullSafe(F.col(f"new.{version}"))
    outcome = F.when(F.col("k2").isNull(), F.lit(None)).when(F.col("k1").isNull(), INSERTED).when(same, UNCHANGED).otherwise(CHANGED)
    row = F.when(outcome.isin(INSERTED, CHANGED), F.col("new")).otherwise(F.col("old"))
    return both.select(row.alias("row"), outcome.alias("outcome")).select("row.*", "outcome")


def update_outcomes(current: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """(key, outcome) of updates that never insert: notFound, unchanged or changed."""
    old = current.select(F.col(key), F.col(version).alias("__old"), F.lit(True).alias("__there"))
    joined = incoming.select(key, version).join(old, key, "left")
    outcome = F.when(F.col("__there").isNull(), NOT_FOUND).when(F.col(version).eqNullSafe(F.col("__old")), UNCHANGED).otherwise(CHANGED)
    return joined.select(key, outcome.alias("outcome"))


def get_or_create(dim: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """The dimension with a row for each new name, whose id follows from the name; nulls are no names."""
    new = names.select(name).filter(F.col(name).isNotNull()).distinct().join(dim.select(name), name, "left_anti")
    made = new.select(stable_id(F.col(name)).alias("id"), F.col(name))
    return dim.unionByName(made, allowMissingColumns=True)


def get_or_create_issuing_bodies(issuing_body: DataFrame, names: DataFrame, scope: str = "national") -> DataFrame:
    out = get_or_create(issuing_body, names)
    return out.withColumn("authority_rank", F.coalesce("authority_rank", authority_rank(F.col("name")))).withColumn("scope", F.coalesce("scope", F.lit(scope)))


def collisions(documents: DataFrame, key: str = "citation_id", version: str = "content_version") -> DataFrame:
    """Keys that stand for several contents: documents that overwrite one another."""
    return documents.groupBy(key).agg(F.countDistinct(version).alias("contents")).filter("contents > 1")


def upsert_manifest(entries: DataFrame, incoming: DataFrame, order: str = "version") -> DataFrame:
    """Entries keyed by subdir, folder and filename; a later version replaces, others stay or are added."""
    key = ["subdir", "folder", "filename"]
    return latest(entries.unionByName(incoming), key, [F.desc(order)])


def move_entry(entries: DataFrame, subdir: str, folder: str, to: str) -> DataFrame:
    hit = (F.col("subdir") == subdir) & (F.col("folder") == folder)
    return entries.withColumn("subdir", F.when(hit, F.lit(to)).otherwise(F.col("subdir")))
