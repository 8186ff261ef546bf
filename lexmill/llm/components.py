"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.scratch import discard, written

#: edges that a task holds at once
CHUNK = 100_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk of a partition's edges (u, v) as a forest of stars (node, least node), which joins the same nodes."""

    def stars(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for u, v in pairs:
            a, b = top(up.setdefault(u, u)), top(up.setdefault(v, v))
            if a != b:
                up[max(a, b)] = min(a, b)
        rows = [(x, r) for x in up if (r := top(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["u", "v"])

    held: list[tuple[int, int]] = []
    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if len(held) >= CHUNK:
            yield stars(held)
            held = []
    yield stars(held)


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One step: every node hands the least of its neighbours (itself included) to its larger neighbours, or all of them.

    The minima are rebalanced before the join, so that the join's two exchanges are its own and adaptive execution can
    split a hub's partition."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).hint("rebalance")
    joined = seen.join(least, "u")
    if both_ways:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Whether a node has two edges upwards, or stands at the end of one and the beginning of another."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
    return not ends.groupBy("x").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs")).filter("ups > 1 or (ups = 1 and downs = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node of an edge with two different ends, the smallest node it reaches.

    Nulls and loops are no edges. Whatever the number of edges, tasks first contract what they hold, in chunks of bounded
    size, and rounds of distributed steps join the rest. Each round is written to the shared folder, so lineage stays
    short, and the one before is removed. Neither edges nor labels ever come to the driver."""
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u > v").distinct()
    cur = written(cur.mapInArrow(_contracted, "u long, v long"), "edges")
    while _unfinished(cur):
        after = written(_star(_star(cur, True), False).mapInArrow(_contracted, "u long, v long"), "edges")
        discard(cur)
        cur = after
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
