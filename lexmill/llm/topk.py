"""Exact search for the largest inner products.

Vectors are whole numbers: floor(scale * x). Candidates are taken by descending length. All vectors are rotated by the
right singular vectors of the candidates, so the first dimensions hold most of what they have; the inner product over
these and Cauchy-Schwarz over the rest bound the whole one from above, and only what a bound lets pass is computed, in
whole numbers. A query is done with a list as soon as its own length times that of the next candidate is below its
k-th best score.

On Spark: the longest candidates alone give every query a first k-th best score. It says which bands of lengths the
query has to visit, and queries meet the blocks of these bands in groups of bounded size. Of equal vectors only as many
as can be in a result are candidates, and equal queries are asked once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.scratch import discard, written

SCALE, K, EVERY = 64, 20, 20
#: longest candidates that give the first scores, bands of lengths
HEAD, BANDS = 2048, 64
#: most candidates and most queries of a group; candidates that are taken at once
BLOCK, ASKED, STEP = 65_536, 32_768, 1024
#: parts of the singular values' sum that the first dimensions of a bound hold
PARTS = (0.5, 0.8)
#: what rounding can add to a bound, by lengths
SLACK = 1e-9


def _floats(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((_floats(x) ** 2).sum(axis=1))


def product_type(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest type in which inner products of these int64 vectors are exact."""
    bound = float(np.abs(_floats(a)).max(initial=0)) * float(np.abs(_floats(b)).max(initial=0)) * a.shape[1]
    return np.float64 if bound < 2**52 else np.int64 if bound < 2**62 else object


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, as longs; a product that no long holds becomes the nearest one."""
    out = a @ b.T
    return np.clip(out, -(2**63), 2**63 - 1).astype(np.int64) if out.dtype == object else out.astype(np.int64)


def products_at(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Those of rows i of a with rows j of b, in portions."""
    parts = [(a[i[at : at + STEP]] * b[j[at : at + STEP]]).sum(axis=1) for at in range(0, len(i), STEP)]
    out = np.concatenate(parts) if parts else np.empty(0)
    return np.clip(out, -(2**63), 2**63 - 1).astype(np.int64) if out.dtype == object else out.astype(np.int64)


class Rotation:
    """Right singular vectors of the candidates, from the sum of their outer products, and how many dimensions each bound takes."""

    def __init__(self, gram: np.ndarray) -> None:
        values, self.vectors = np.linalg.eigh(gram / max(1.0, float(np.abs(gram).max(initial=0))))
        self.vectors = self.vectors[:, ::-1]
        weight = np.cumsum(np.sqrt(np.clip(values[::-1], 0, None)))
        self.cuts = sorted({int(np.searchsorted(weight, part * weight[-1])) + 1 for part in PARTS})
        self.cuts = [c for c in self.cuts if c < len(values)]

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The rotated vectors, and the length of what follows each cut."""
        turned = _floats(x) @ self.vectors
        after = np.sqrt(np.maximum((turned[:, ::-1] ** 2).cumsum(axis=1)[:, ::-1], 0))
        return turned, [after[:, c] for c in self.cuts]


def best(q: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each q: by score, then id, then row."""
    order = np.lexsort((row, ident, ~score, q))
    qs = q[order]
    first = np.flatnonzero(np.concatenate([[True], qs[1:] != qs[:-1]])) if len(qs) else np.empty(0, dtype=np.int64)
    at = np.arange(len(qs)) - np.repeat(first, np.diff(np.append(first, len(qs))))
    return order[at < k]


def search(asked: np.ndarray, least: np.ndarray, x: np.ndarray, ident: np.ndarray, row: np.ndarray, k: int, rotation: Rotation) -> tuple[np.ndarray, ...]:
    """(query's place, score, id, row) of the k best candidates of each query, without those that can't be among its k
    best as ``least``, a lower bound of its k-th score, says. STEP queries and STEP candidates are held together at once."""
    far, kind = lengths(x), product_type(asked, x)
    order = np.argsort(-far, kind="stable")
    x, ident, row, far = x[order], ident[order], row[order], far[order]
    turned, after = rotation.parts(x)
    x, out = x.astype(kind), []
    for at in range(0, len(asked), STEP):
        part = slice(at, at + STEP)
        q, *rest = _searched(asked[part], least[part].copy(), kind, x, far, turned, after, ident, row, k, rotation)
        out.append((q + at, *rest))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.empty(0, dtype=np.int64) for _ in range(4))


def _searched(asked, least, kind, x, far, turned, after, ident, row, k, rotation) -> list[np.ndarray]:
    size, (own, own_after), asked = lengths(asked), rotation.parts(asked), asked.astype(kind)
    found = [np.empty(0, dtype=np.int64) for _ in range(4)]
    for start in range(0, len(x), STEP):
        block = slice(start, start + STEP)
        alive = np.flatnonzero(size * far[start] * (1 + SLACK) >= least)
        if not len(alive):
            break
        whole = size[alive, None] * far[None, block]
        need = least[alive, None] - whole * SLACK
        may = whole >= need
        for cut, q_after, x_after in zip(rotation.cuts, own_after, after):
            may &= own[alive, :cut] @ turned[block, :cut].T + q_after[alive, None] * x_after[None, block] >= need
        i, j = np.nonzero(may)
        few = len(i) * asked.shape[1] < may.size
        scores = products_at(asked[alive], x[block], i, j) if few else products(asked[alive], x[block])[i, j]
        good = scores >= need[i, j]
        i, j = i[good], j[good]
        if not len(i):
            continue
        found = [np.concatenate(c) for c in zip(found, (alive[i], scores[good], ident[block][j], row[block][j]))]
        keep = best(*found, k)
        found = [c[keep] for c in found]
        q, n = np.unique(found[0], return_counts=True)
        full, last = n == k, np.cumsum(n) - 1
        least[q[full]] = np.maximum(least[q[full]], _floats(found[1][last[full]]))
    return found


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, d)


def _gram(rows: DataFrame, d: int) -> np.ndarray:
    """Sum of the outer products of all vectors; d * d numbers come to the driver, however many vectors there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = _floats(_matrix(batch.column(0), d))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["i", "s"])

    out = np.zeros(d * d)
    table = rows.select("v").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    out[table.column("i").to_numpy()] = table.column("s").to_numpy()
    return out.reshape(d, d)


def _blocks(n: int, most: int, least: int, spread: int) -> int:
    """Groups of n rows: no more than ``most`` each, and as many as there are workers, unless they would be small."""
    return max(1, ceil(n / most), min(spread, n // least))


def _found(asked: DataFrame, candidates: DataFrame, d: int, k: int) -> DataFrame:
    """(q, score, id, row): the k best of each query (q, v) among candidates (v, id, row, far) of the same dimension."""
    sc = asked.sparkSession.sparkContext
    n, n_asked = candidates.count(), asked.count()
    rotation = Rotation(_gram(candidates, d))
    head = candidates.orderBy(F.desc("far"), "id", "row").limit(HEAD).select("v").toArrow()
    shared = sc.broadcast((rotation, _matrix(head.column(0), d)))
    bands = min(BANDS, ceil(n / BLOCK))
    cuts = candidates.select(F.percentile_approx("far", [1 - i / bands for i in range(1, bands)], 1000)).first()[0] if bands > 1 else []
    band = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("far"))) if cuts else F.lit(0)
    held = {r["band"]: (r["n"], r["far"]) for r in candidates.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    names = sorted(held)
    spread = 2 * sc.defaultParallelism
    parts = {b: _blocks(held[b][0], BLOCK, 512, ceil(spread / len(names))) for b in names}
    groups = _blocks(n_asked, ASKED, 256, ceil(spread / sum(parts.values())))
    reach = np.array([held[b][1] for b in names]) * (1 + SLACK)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with a lower bound of their k-th score, and how many bands they have to visit."""
        _, longest = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                x = _matrix(part.column(1), d)
                kind = product_type(x, longest)
                scores = _floats(products(x.astype(kind), longest.astype(kind)))
                least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(x), -np.inf)
                visits = (lengths(x)[:, None] * reach[None, :] >= least[:, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least), pa.array(np.maximum(visits, 1), pa.int32())], names=["q", "v", "least", "visits"])

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        q, x = left.column("q").to_numpy(), _matrix(left.column("v"), d)
        out = search(x, left.column("least").to_numpy(), _matrix(right.column("v"), d), right.column("id").to_numpy(), right.column("row").to_numpy(), k, shared.value[0])
        return pa.table({"q": q[out[0]], "score": out[1], "id": out[2], "row": out[3]})

    counted = asked.select("q", "v").mapInArrow(first, "q long, v array<bigint>, least double, visits int")
    of_band = F.element_at(F.array(*(F.lit(parts[b]) for b in names)), F.col("place") + 1)
    to_visit = counted.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("visits") - 1)))
    to_visit = to_visit.withColumn("part", F.explode(F.sequence(F.lit(0), of_band - 1))).withColumn("grp", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int")).drop("visits")
    place = F.array_position(F.array(*map(F.lit, names)), band).cast("int") - 1
    dealt = candidates.select("v", "id", "row", place.alias("place")).withColumn("part", F.pmod(F.xxhash64("row"), of_band).cast("int"))
    dealt = dealt.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    key = ["place", "part", "grp"]
    return to_visit.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(cell, "q long, score long, id long, row long")


def top_products(vectors: DataFrame, asked: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each row that ``asked`` marks (ids divisible by
    EVERY) with all other rows, exactly; ties go to the smaller vec_id, of equal ids to any row of them.

    Vectors are floor(scale * x). Null and empty vectors, those with null or non-finite components, and rows without an
    id take no part; vectors of different lengths don't meet. Rows that share an id are told apart: each is a query or
    candidate of its own. Fewer than k candidates: all of them. No queries: no rows."""
    asked = (F.col(id_col) % EVERY == 0) if asked is None else asked
    fine = F.col("id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.filter(fine).select("id", F.transform("x", lambda v: F.floor(v * scale)).alias("v"), "asked")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id", "row"))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    candidates = written(rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1).select("v", "id", "row", F.sqrt(square).alias("far")), "candidates")
    queries = written(rows.filter("asked").groupBy("v").agg(F.min("row").alias("q")), "queries")
    found = None
    for d in sorted(r[0] for r in queries.select(F.size("v")).distinct().collect()):
        part = _found(queries.filter(F.size("v") == d), candidates.filter(F.size("v") == d), d, k + 1)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id", "row")
    found = written(found, "found")
    tops = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    tops = tops.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "id", "row", "score"))).alias("tops"))
    tops = written(queries.join(tops, "q").select(F.col("v").alias("w"), "tops"), "tops")
    discard(candidates, found)
    own = rows.filter("asked").join(tops.hint("rebalance"), F.col("v") == F.col("w"))
    others = F.slice(F.filter("tops", lambda t: t["row"] != F.col("row")), 1, k)
    return own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "t")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("t.id").alias("vec_id"), F.col("t.score").alias("score"))


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle() -> str:
    """DuckDB SQL for the same rows: every query against every row."""
    dot = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1]::bigint * p[2]::bigint))::bigint"
    fine = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)"
    return f"""with r as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings where vec_id is not null and {fine}),
s as (select a.r, a.vec_id as query_id, b.vec_id, {dot} as score from r a join r b on a.r <> b.r and len(a.v) = len(b.v) where a.vec_id % {EVERY} = 0)
select query_id, rank, vec_id, score from (select query_id, vec_id, score, (row_number() over (partition by r order by score desc, vec_id))::int as rank from s) where rank <= {K}"""
