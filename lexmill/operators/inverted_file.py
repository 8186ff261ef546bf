"""An inverted file for vector search: lists of vectors by their nearest centroid, written as partitions.

Centroids come from spherical k-means on a bounded sample; every vector is indexed. A search reads the lists nearest to
each query and ranks their vectors by exact cosine. Each list carries the smallest cosine of its vectors to the
centroid, so the angle between query and centroid bounds every cosine in the list: the exact form goes on with those
lists alone whose bound reaches a query's k-th best score, and gives what a scan of everything gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators.retrieval import cosine
from lexmill.scratch import written

#: vectors that centroids are fitted on, at most: those with the smallest hashes; lists; rounds of k-means
SAMPLE, LISTS, ROUNDS, SEED = 20_000, 64, 12, 5
#: lists that a search reads first
PROBES = 8
#: vectors and queries of a list that are compared in one group, at most on average; queries at once in it
BLOCK, AT_ONCE = 8192, 256
#: what rounding can take off a bound
SLACK = 1e-9


@dataclass
class Index:
    """vectors with a partition column ``list``, and lists (list, centroid, least), of which there are as many as asked for at most."""

    vectors: DataFrame
    lists: DataFrame

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Index:
        return Index(spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/lists"))

    def centroids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = self.lists.orderBy("list").collect()
        return np.array([r["list"] for r in rows]), np.array([r["centroid"] for r in rows], dtype=np.float64), np.array([r["least"] for r in rows])


def centroids(sample: np.ndarray, lists: int = LISTS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit vectors; sample: unit vectors. Fewer than asked for where the sample is small or some stay empty."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1)
        c = total[size > 0] / size[size > 0, None]
    return c


def _unit(column: pa.Array, d: int) -> np.ndarray:
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vector: Column, d: int | None = None) -> Column:
    ok = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok if d is None else ok & (F.size(vector) == d), F.lit(False))


def build(vectors: DataFrame, folder: str, id_col: str = "vec_id", vector_col: str = "embedding", lists: int = LISTS, sample: int = SAMPLE) -> Index:
    """Writes the index under a new folder, with all columns. Null, empty and zero vectors, and those with null or
    non-finite components, have no cosine and are left out; vectors must be of one length, that of the sample's first."""
    rows = vectors.filter(_usable(F.col(vector_col)))
    fitted = rows.select(vector_col).orderBy(F.xxhash64(id_col), id_col).limit(sample).toArrow().column(0).combine_chunks()
    if not len(fitted):
        raise ValueError("no vector to index")
    d = len(fitted[0])
    same = pa.array([x for x in fitted.to_pylist() if len(x) == d], pa.list_(pa.float64()))
    shared = vectors.sparkSession.sparkContext.broadcast(centroids(_unit(same, d), lists))
    at = rows.columns.index(vector_col)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _unit(batch.column(at), d) @ shared.value.T
                best = near.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near[np.arange(len(best)), best]), pa.array(best.astype(np.int32))], names=[*batch.schema.names, "near", "list"])

    schema = rows.schema.simpleString()[len("struct<") : -1]
    placed = written(rows.filter(F.size(vector_col) == d).mapInArrow(assign, f"{schema}, near double, list int"), "placed")
    placed.drop("near").repartition("list").write.partitionBy("list").parquet(f"{folder}/vectors")
    names = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(shared.value)], "list int, centroid array<double>")
    least = placed.groupBy("list").agg(F.min("near").alias("least"))
    least.join(F.broadcast(names), "list").write.parquet(f"{folder}/lists")  # a row per list
    return Index.load(vectors.sparkSession, folder)


def nearest_lists(index: Index, queries: DataFrame, probes: int, query_col: str = "query_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, vector, list, bound, probe): every list for every query, the nearest first, with a bound of the cosines in it."""
    numbers, c, least = index.centroids()
    d = c.shape[1]
    reach = np.arccos(np.clip(least, -1, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.clip(_unit(batch.column(1), d) @ c.T, -1, 1)
                bound = np.cos(np.maximum(np.arccos(near) - reach[None, :], 0)) + SLACK
                order = np.argsort(-near, axis=1, kind="stable")
                n, m = order.shape
                rows = pa.array(np.repeat(np.arange(n), m))
                columns = [x.take(rows) for x in batch.columns]
                made = [pa.array(numbers[order].ravel().astype(np.int32)), pa.array(np.take_along_axis(bound, order, 1).ravel()), pa.array(np.tile(np.arange(m) < probes, n))]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=["query_id", "vector", "list", "bound", "probe"])

    asked = queries.select(F.col(query_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(_usable(F.col("vector"), d))
    return asked.mapInArrow(run, "query_id long, vector array<double>, list int, bound double, probe boolean")


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed as ``cosine`` does, so that equal ones are ties in either form."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _nearest(asked: pa.Table, pool: pa.Table, k: int, d: int) -> pa.Table:
    """(query_id, id, score): of every asked row (query_id, vector) the k best of the pool (id, e), ties by id.

    A matrix product finds what can be among them; these pairs' cosines are then summed in order."""
    out = {"query_id": [np.empty(0, np.int64)], "id": [np.empty(0, np.int64)], "score": [np.empty(0)]}
    if asked.num_rows and pool.num_rows:
        flat = lambda column: np.asarray(column.combine_chunks().flatten(), dtype=np.float64).reshape(-1, d)
        q, x, ids = flat(asked.column("vector")), flat(pool.column("e")), pool.column("id").to_numpy()
        numbers = asked.column("query_id").to_numpy()
        q_size, x_size = np.sqrt(_in_order(q, q)), np.sqrt(_in_order(x, x))
        x_unit = (x / np.where(x_size > 0, x_size, np.nan)[:, None]).T
        for at in range(0, len(q), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            near = np.nan_to_num(q[part] / np.where(q_size[part] > 0, q_size[part], np.nan)[:, None] @ x_unit, nan=-np.inf)
            least = np.partition(near, -k, axis=1)[:, -k] if k < near.shape[1] else np.full(len(near), -2.0)
            row, col = np.nonzero((near >= least[:, None] - SLACK) & (near >= -2))
            score = _in_order(q[part][row], x[col]) / (q_size[part][row] * x_size[col])
            order = np.lexsort((ids[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            for name, values in (("query_id", numbers[part][row]), ("id", ids[col]), ("score", score)):
                out[name].append(values[first])
    return pa.table({name: np.concatenate(values) for name, values in out.items()})


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = PROBES, exact: bool = False, keep: Column | None = None, query_col: str = "query_id", vector_col: str = "vector", id_col: str = "vec_id", embedding_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): each query's k vectors with the largest cosines in the lists that it reads, among those that pass ``keep``.

    A list's vectors are compared with its queries in blocks, from which k rows a query come. With ``exact`` also the lists are read whose bound reaches the k-th score of the first ones. Ties go to the smaller id.
    Queries without a cosine, or of another length, have no rows."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    pool = index.vectors if keep is None else index.vectors.filter(keep)
    pool = pool.select(F.col(id_col).cast("long").alias("id"), F.col(embedding_col).alias("e"), F.col("list").alias("in"))

    d = len(index.lists.first()["centroid"])
    many = lambda rows, name: max(1, -(-(rows.groupBy(name).count().agg(F.max("count")).first()[0] or 0) // BLOCK))
    split = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    parts = many(pool, "in")

    def scored(asked: DataFrame) -> DataFrame:
        turns = many(asked, "list")
        left = asked.select("query_id", "vector", "list", split("query_id", turns).alias("turn"), every(parts).alias("part"))
        right = pool.withColumn("turn", every(turns)).withColumn("part", split("id", parts)).withColumnRenamed("in", "list")
        keys = ["list", "turn", "part"]
        make = lambda a, b: _nearest(a, b, k, d)
        return best(left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(make, "query_id long, id long, score double"))

    asked = nearest_lists(index, queries, probes, query_col, vector_col)
    if not exact:
        return scored(asked.filter("probe")).select("query_id", "rank", "id", "score")
    asked = written(asked, "asked")
    found = written(scored(asked.filter("probe")), "found")
    least = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    more = asked.filter("not probe").join(least, "query_id", "left").filter("least is null or bound >= least").select("query_id", "vector", "list")
    return best(found.drop("rank").unionByName(scored(more).drop("rank"))).select("query_id", "rank", "id", "score")


def search_one(index: Index, query: list[float], k: int = 10, probes: int = PROBES, keep: Column | None = None, id_col: str = "vec_id", embedding_col: str = "embedding") -> DataFrame:
    """(id, score) of one query over its nearest lists, which the plan names, so no other partition is opened."""
    numbers, c, _ = index.centroids()
    near = c @ (np.asarray(query, dtype=np.float64) / np.linalg.norm(query))
    wanted = [int(numbers[i]) for i in np.argsort(-near, kind="stable")[:probes]]
    rows = index.vectors.filter(F.col("list").isin(wanted))
    rows = rows if keep is None else rows.filter(keep)
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.select(F.col(id_col).alias("id"), cosine(F.col(embedding_col), q).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of the true neighbours (query_id, id) that were found."""
    hit = truth.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))
