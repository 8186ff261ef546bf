"""Traversals and checks on the reference graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paths(edges: DataFrame, starts: DataFrame, hops: int = 3, source: str = "source", target: str = "target") -> DataFrame:
    """(start, node, hops): what each start reaches in 1 to ``hops`` steps, with the fewest steps.

    Each step is an equi-join on the frontier, of which only new nodes go on; the depth is small and fixed."""
    step = edges.select(F.col(source).alias("node"), F.col(target).alias("next")).filter("next is not null").distinct()
    seen = starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("hops")).distinct()
    front = seen
    for k in range(1, hops + 1):
        front = front.select("start", "node").join(step, "node").select("start", F.col("next").alias("node")).distinct()
        front = front.join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(k))
        seen = seen.unionByName(front)
    return seen.filter("hops > 0")


def path_lists(edges: DataFrame, starts: DataFrame | None = None, hops: int = 3, source: str = "source", target: str = "target") -> DataFrame:
    """(start, path): every path of 1 to ``hops`` different edges as the array of its nodes, start included, that meets no node twice.

    starts has a column start; None means every source. Each step is an equi-join of the paths' ends with the distinct
    edges. There can be as many paths as the out-degree to the power of ``hops``: that is the result, and a bound belongs
    to the edges or to ``hops``."""
    step = edges.select(F.col(source).alias("end"), F.col(target).alias("next")).filter("end is not null and next is not null and end <> next").distinct()
    front = step.select(F.col("end").alias("start")).distinct() if starts is None else starts.select("start").distinct()
    front, found = front.select("start", F.array("start").alias("path"), F.col("start").alias("end")), None
    for _ in range(hops):
        front = front.join(step, "end").filter(~F.array_contains("path", F.col("next")))
        front = front.select("start", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("end"))
        found = front if found is None else found.unionByName(front)
    return found.select("start", "path")


def rank_conflicts(edges: DataFrame, ranks: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Edges whose source has less authority (a larger rank) than their target. ranks: (id, rank)."""
    a, b = ranks.select(F.col("id").alias(source), F.col("rank").alias("source_rank")), ranks.select(F.col("id").alias(target), F.col("rank").alias("target_rank"))
    return edges.join(a, source).join(b, target).filter("source_rank > target_rank")


def as_of(events: DataFrame, key: list[str], when: str, day: Column) -> DataFrame:
    """Each key's last event on or before a day; ties by the whole row."""
    return events.filter(F.col(when) <= day).groupBy(*key).agg(F.max_by(F.struct(*events.columns), F.struct(when, *[c for c in events.columns if c != when])).alias("r")).select("r.*")


def amendment_history(edges: DataFrame, document: DataFrame, document_id: str, day: Column) -> DataFrame:
    """Amending documents of one document that are in effect by a day, newest first."""
    hits = edges.filter((F.col("target_document_id") == document_id) & (F.col("reference_type") == "amends")).drop("citation")
    by = document.select(F.col("id").alias("source_document_id"), F.col("citation_id").alias("citation"), F.coalesce("effective_date", "enacted_date").alias("effective"))
    return hits.join(by, "source_document_id").filter(F.col("effective") <= day).orderBy(F.desc("effective"), "citation")


CENTRAL_DAYS, LOCAL_DAYS = 45, 10


def effect_violations(document: DataFrame, local: Column, expedited: Column) -> DataFrame:
    """Documents that take effect sooner after enactment than allowed, or before it, with the rule."""
    lag = F.date_diff("effective_date", "enacted_date")
    least = F.when(local, LOCAL_DAYS).otherwise(CENTRAL_DAYS)
    rule = F.when(lag < 0, "retroactive").when((lag < least) & ~expedited, "too_early")
    return document.withColumn("lag_days", lag).withColumn("rule", rule).filter("rule is not null")


def foreign_amendments(edges: DataFrame, document: DataFrame) -> DataFrame:
    """Amending edges between documents of different issuing bodies."""
    a = document.select(F.col("id").alias("source_document_id"), F.col("issuing_body_id").alias("source_body"))
    b = document.select(F.col("id").alias("target_document_id"), F.col("issuing_body_id").alias("target_body"))
    return edges.filter("reference_type = 'amends'").join(a, "source_document_id").join(b, "target_document_id").filter(~F.col("source_body").eqNullSafe(F.col("target_body")))
