"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.portions import portions
from lexmill.scratch import discard, written

#: labelled ids of each class that a fit may take, at most: those with the smallest hashes
SAMPLE = 4000
#: bytes of text that a sample may hold, at most
SAMPLE_BYTES = 256 << 20


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text, modulo folds, is that fold; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int], tuple[float, float]]:
    """(texts, labels, how many labelled ids each sampled one of class 0 and 1 stands for).

    Ids are chosen from the labels alone, at most ``limit`` of each class, so the documents are read once, filtered by a
    broadcast of bounded size, and never shuffled. Labels other than 0 and 1, null ids and ids for which ``learn``
    doesn't hold are left out. Of documents that share a chosen id, all count, up to twice the limit in all. Texts are whole:
    in the order of their ids' hashes each is taken that fits into what is left of ``most_bytes``; sizes decide this on
    the driver, before any text comes there."""
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y"), learn.alias("learn"))
    marks = marks.filter(F.col("y").isin(0, 1) & F.col("learn") & F.col("id").isNotNull()).select("id", "y").distinct()
    there = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    hashed = F.xxhash64(F.col("id").cast("string"))
    chosen = [(r["id"], y) for y in (0, 1) for r in marks.filter(F.col("y") == y).orderBy(hashed, "id").select("id").limit(limit).collect()]
    if not chosen:
        return [], [], (1.0, 1.0)
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen, "id long, y int"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(ids, "id")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "labelled")
    sizes = rows.select("id", "row", "y", F.octet_length("text").alias("size"), F.md5(F.col("text").cast("binary")).alias("sum"))
    taken, left = [], most_bytes
    for r in sizes.orderBy(hashed, "sum", "y", "row").limit(2 * limit).select("row", "size").collect():
        if r["size"] <= left:
            taken.append((r["row"], len(taken)))
            left -= r["size"]
    order = F.broadcast(docs.sparkSession.createDataFrame(taken, "row long, place int"))
    got = sorted(rows.join(order, "row").select("place", "text", "y").collect(), key=lambda r: r["place"])
    discard(rows)
    return [r["text"] for r in got], [r["y"] for r in got], tuple(max(1.0, there.get(y, 0) / limit) for y in (0, 1))


def rated(docs: DataFrame, rate: Callable[[list[str | None]], np.ndarray], text_col: str = "text", name: str = "score", batch: int = 256) -> DataFrame:
    """docs with one more column, the rate of each text as a probability; rows keep their partitions and all their columns.

    rate takes texts, null ones too, and returns log-odds. A column of that name is replaced."""
    src = docs.drop(name)
    at = src.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, at):
            z = [rate(b.column(at).slice(i, batch).to_pylist()) for i in range(0, b.num_rows, batch)]
            scores = 1 / (1 + np.exp(-np.concatenate(z))) if z else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, name])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(name, T.DoubleType())]))
