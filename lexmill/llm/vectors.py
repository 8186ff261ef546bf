"""Embedding near-duplicates by a forest of random-projection trees.

A tree splits recursively: vectors are projected on a random direction and parted at the median, and those within SPILL
of it go to both sides. The trees' upper levels are fitted on a bounded sample, and every vector is indexed; leaves that
still hold too many vectors are split on, in rounds, by the medians that Spark takes of all their vectors, so leaves
don't grow with the data. Within a leaf all vectors
of one label are compared by cosine in double precision; a leaf with more vectors than a block holds is compared block
by block, so no task's input grows and nothing is left out. A pair that several leaves hold counts in the first alone.
Only counts and a spanning forest of the links leave a block, never the pairs. Equal vectors are one class with a
multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.components import connected_components
from lexmill.scratch import written

#: vectors of the sample that trees are fitted on, at most: those with the smallest hashes
SAMPLE = 20_000
TREES, LEAF, SPILL, BLOCK, SEED, LINK = 6, 1024, 0.02, 512, 11, 0.98
TRIES, DEEPEST = 4, 24
#: a leaf beyond so many times the wanted size is split on; rounds of that, two splits each, at most
OVERSIZE, ROUNDS = 8, 14
#: a split counts if neither side holds more than this share of a leaf
SHARE = 0.65
#: leaves whose medians may be broadcast
BROADCAST_LEAVES = 200_000


class Tree:
    """Nodes as (direction, median, left, right), leaves as negative numbers from -1."""

    def __init__(self, sample: np.ndarray, leaf: float, rng: np.random.Generator) -> None:
        self.nodes: list = []
        self.leaves = 0
        self.root = self._grow(sample, leaf, rng, 0)

    def _grow(self, x: np.ndarray, leaf: float, rng: np.random.Generator, depth: int) -> int:
        if len(x) > max(leaf, 4) and depth < DEEPEST:
            for _ in range(TRIES):
                d = rng.standard_normal(x.shape[1])
                d /= np.linalg.norm(d)
                p = x @ d
                cut = float(np.median(p))
                left, right = x[p <= cut + SPILL], x[p > cut - SPILL]
                if max(len(left), len(right)) < 0.9 * len(x):
                    me = len(self.nodes)
                    self.nodes.append(None)
                    self.nodes[me] = (d, cut, self._grow(left, leaf, rng, depth + 1), self._grow(right, leaf, rng, depth + 1))
                    return me
        self.leaves += 1  # few vectors, or so close together that no direction parts them
        return -self.leaves

    def place(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf from 0, rows) of each leaf that rows of x reach."""
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node - 1, rows
                continue
            d, cut, left, right = self.nodes[node]
            p = x[rows] @ d
            todo += [(left, rows[p <= cut + SPILL]), (right, rows[p > cut - SPILL])]


def grow(sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> list[Tree]:
    """Trees whose leaves hold about ``leaf`` of ``total`` vectors; sample: unit vectors."""
    rng = np.random.default_rng(seed)
    return [Tree(sample, leaf * len(sample) / max(1, total), rng) for _ in range(trees)]


def compare(rows: pd.DataFrame, link: float = LINK) -> pd.DataFrame:
    """One block or pair of blocks of a leaf: (node, links, root) of each row with a link that no earlier leaf holds."""
    x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    first, second = rows["block"].to_numpy() == rows["b1"].iloc[0], rows["block"].to_numpy() == rows["b2"].iloc[0]
    a, b = np.flatnonzero(first), np.flatnonzero(second)
    near = (x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= link
    near &= a[:, None] < b[None, :] if rows["b1"].iloc[0] == rows["b2"].iloc[0] else True
    here = rows["leaf"].iloc[0]
    earlier = [[leaf for leaf in leaves if leaf < here] for leaves in rows["leaves"]]
    if near.any() and (names := sorted({leaf for own in earlier for leaf in own})):
        at = {leaf: i for i, leaf in enumerate(names)}
        member = np.zeros((len(rows), len(names)), dtype=np.float32)
        for i, own in enumerate(earlier):
            member[i, [at[leaf] for leaf in own]] = 1
        near &= (member[a] @ member[b].T) < 0.5
    i, j = np.nonzero(near)
    i, j = a[i], b[j]
    weight = rows["copies"].to_numpy()
    links = np.bincount(i, weights=weight[j], minlength=len(rows)) + np.bincount(j, weights=weight[i], minlength=len(rows))
    ids = rows["node"].to_numpy()
    root = ids.copy()
    while len(i):  # the least id over links, again and again until nothing changes
        low, before = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (root == before).all():
            break
    kept = links > 0
    return pd.DataFrame({"node": ids[kept], "links": links[kept].astype(np.int64), "root": root[kept]})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", link: float = LINK, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component_id, kept): one row per input row.

    Vectors without a label, null, empty, zero, or with null or non-finite components link with nothing; neither do
    vectors of different lengths, nor rows with a null id. Classes of equal vectors are numbered, so rows that share an id are
    told apart. Doubles stay doubles."""
    spark = vectors.sparkSession
    kind = "array<float>" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "array<double>"
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"), F.col(label_col).alias("label"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
    fine &= F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    src = src.withColumn("fine", F.coalesce(fine, F.lit(False)))
    classes = src.filter("fine").groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}
    found = None
    for d, n in sorted(sizes.items()):
        of = classes.filter(F.size("vector") == d)
        some = of.orderBy(F.xxhash64("rep", "label"), "rep").limit(sample).select("vector").toArrow().column(0).combine_chunks()
        x = np.asarray(some.flatten(), dtype=np.float64).reshape(-1, d)
        forest = spark.sparkContext.broadcast(grow(x / np.linalg.norm(x, axis=1, keepdims=True), n, trees, leaf))
        part = _compared(of, forest, link, OVERSIZE * leaf)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return src.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = written(found, "links")
    direct = found.groupBy("node").agg(F.sum("links").alias("direct"))
    named = classes.select("node", "rep").join(connected_components(found, "node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component")).hint("rebalance")
    named = named.select("node", "root").join(least, "root").select("node", "component")
    names = classes.join(direct, "node", "left").join(named, "node")
    names = written(names.select(F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("direct", F.lit(0)) + F.col("copies") - 1).alias("n"), "component"), "classes")
    good = src.filter("fine").join(names, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v"))).select("id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    rest = src.filter("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def _units(column: pa.ListArray, rows: int) -> np.ndarray:
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(rows, -1) if rows else np.empty((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a vector and a leaf, and the vector's places on two directions that follow from the leaf's number."""
    for batch in batches:
        x = _units(batch.column(batch.schema.get_field_index("vector")), batch.num_rows)
        leaves = batch.column(batch.schema.get_field_index("leaf")).to_numpy()
        order = np.argsort(leaves, kind="stable")
        out = np.empty((2, batch.num_rows))
        for rows in np.split(order, np.flatnonzero(np.diff(leaves[order])) + 1) if len(order) else ():
            d = np.random.default_rng([SEED, int(leaves[rows[0]])]).standard_normal((2, x.shape[1]))
            out[:, rows] = (d / np.linalg.norm(d, axis=1, keepdims=True)) @ x[rows].T
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[0]), pa.array(out[1])], names=[*batch.schema.names, "p1", "p2"])


def split_on(placed: DataFrame, most: int, rounds: int = ROUNDS) -> DataFrame:
    """placed, with the leaves that hold more than ``most`` vectors of a label split into leaves that don't.

    A leaf's number has its path below the first levels in its last 32 bits, a 1 before it. Each round takes two random
    directions per leaf; Spark counts their quantiles over all the leaf's vectors, and vectors within SPILL of a median
    go to both sides. A direction that parts a leaf badly isn't used; the next round tries others. When TRIES rounds have
    parted nothing, what is left stays as it is: those vectors are so close together that they have to be compared.
    Memberships are rows, so no group is ever in one task."""
    key = ["label", "leaf"]

    def over(rows: DataFrame) -> tuple[DataFrame, bool]:
        big = written(rows.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.col("label").alias("l"), F.col("leaf").alias("f")), "over")
        n = big.count()
        return (F.broadcast(big) if n <= BROADCAST_LEAVES else big), bool(n)

    same = (F.col("label") == F.col("l")) & (F.col("leaf") == F.col("f"))
    rows = placed.select("label", "node", "vector", F.explode("leaves").alias("leaf"))
    big, any_left = over(rows)
    if not any_left:
        return placed
    ended, idle = rows.join(big, same, "left_anti").select("node", "leaf"), 0
    for _ in range(rounds):
        todo = rows.join(big, same, "left_semi")
        schema = todo.schema.simpleString()[len("struct<") : -1]
        todo = written(todo.mapInArrow(_projected, f"{schema}, p1 double, p2 double"), "projected")
        marks = F.lit([1 - SHARE, 0.5, SHARE])
        cuts = todo.groupBy(*key).agg(F.percentile_approx("p1", marks, 2000).alias("q1"), F.percentile_approx("p2", marks, 2000).alias("q2"))
        fair = lambda q: F.when((F.col(q)[2] - F.col(q)[1] > SPILL) & (F.col(q)[1] - F.col(q)[0] > SPILL), F.col(q)[1])
        cuts = written(cuts.select(F.col("label").alias("l"), F.col("leaf").alias("f"), fair("q1").alias("c1"), fair("q2").alias("c2")), "cuts")
        n, parted = cuts.agg(F.count("*"), F.count(F.coalesce("c1", "c2"))).first()
        cuts, idle = F.broadcast(cuts) if n <= BROADCAST_LEAVES else cuts, 0 if parted else idle + 1
        side = lambda p, c: F.array_compact(F.array(F.when(F.col(c).isNull() | (F.col(p) <= F.col(c) + SPILL), 0), F.when(F.col(p) > F.col(c) - SPILL, 1)))
        path = F.col("leaf").bitwiseAND(F.lit(0xFFFFFFFF))
        below = F.col("leaf") - path + path * 4
        children = F.flatten(F.transform(side("p1", "c1"), lambda a: F.transform(side("p2", "c2"), lambda b: below + a * 2 + b)))
        met = todo.join(cuts, same).drop("l", "f")
        rows = written(met.select("label", "node", "vector", F.explode(children).alias("leaf")), "split")
        big, any_left = over(rows)
        ended = ended.unionByName(rows.join(big, same, "left_anti").select("node", "leaf"))
        if not any_left or idle == TRIES:
            break
    ended = ended.unionByName(rows.join(big, same, "left_semi").select("node", "leaf"))
    leaves = ended.groupBy("node").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))  # a row's own leaves
    return written(placed.drop("leaves").join(leaves, "node").select(placed.columns), "placed")


def _compared(classes: DataFrame, forest, link: float, most: int) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = forest.value
        firsts = np.cumsum([0, *(t.leaves for t in grown)])
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector"))
            x = _units(vectors, batch.num_rows)
            own: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for first, tree in zip(firsts.tolist(), grown):
                for leaf, rows in tree.place(x) if batch.num_rows else ():
                    for r in rows.tolist():
                        own[r].append((first + leaf) << 32 | 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sorted(o) for o in own], pa.list_(pa.int64()))], names=[*batch.schema.names, "leaves"])

    placed = classes.select("label", "vector", "node", "copies")
    schema = placed.schema.simpleString()[len("struct<") : -1]
    placed = written(placed.mapInArrow(assign, f"{schema}, leaves array<bigint>"), "placed")
    placed = split_on(placed, most)
    each = placed.withColumn("leaf", F.explode("leaves"))
    counts = each.select("label", "leaf").groupBy("label", "leaf").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("label").alias("l"), F.col("leaf").alias("f"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).hint("rebalance")
    dealt = each.join(counts, (F.col("label") == F.col("l")) & (F.col("leaf") == F.col("f"))).drop("l", "f")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other")).drop("other", "blocks")
    return dealt.groupBy("label", "leaf", "b1", "b2").applyInPandas(lambda pdf: compare(pdf, link), "node long, links long, root long")


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
