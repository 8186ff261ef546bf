"""A written index for BM25: postings in blocks of documents with bounds, and searches of many queries at once.

Building counts the words and then takes one pass over the texts; postings are written where they are made and are not
shuffled, each task's sorted by term in the folders of the terms' buckets. A block is a run of neighbouring documents,
the same for all terms. Each of a term's blocks carries the largest weight that it gives to any of its documents, so the
sum over a query's terms bounds every score in the block. A search reads these bounds alone first, scores each query's
best blocks, which gives its least score, and then those blocks that can still hold one of its best documents. Of these
the postings of the queries' terms are shuffled once, to their blocks; there all queries are scored at once and each
keeps its k best, so no pair of query and document becomes a row. The result is that of scoring everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators.retrieval import K1, B, tokens
from lexmill.scratch import written

#: documents of a block, folders by term, blocks that give each query its first scores
BLOCK, BUCKETS, FIRST = 512, 16, 4
#: scores that differ by less are ties, and bounds are taken as larger by it
EPSILON, DIGITS = 1e-9, 9
#: words that a task inverts at once, unless one block has more; queries that are scored at once
WORDS, QUERIES = 1 << 20, 1024


@dataclass
class Index:
    """postings (bucket, term, block, top, ids, weights, postings), terms (bucket, term, idf), both written; postings are
    the ids with their weights."""

    postings: DataFrame
    terms: DataFrame

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Index:
        kind = "term string, block long, ids array<long>, weights array<double>, top double, bucket int"
        rows = spark.read.schema(kind).parquet(f"{folder}/postings")
        rows = rows.withColumn("postings", F.zip_with("ids", "weights", lambda i, w: F.struct(i.alias("id"), w.alias("w"))))
        return Index(rows, spark.read.schema("bucket int, term string, idf double").parquet(f"{folder}/terms"))


def _portions(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.Table]:
    """Rows (number, id, words) in order of their numbers in portions of whole blocks, which don't cross tasks."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[pa.Table]:
        rows = pa.Table.from_batches(held).combine_chunks()
        blocks = rows.column(0).to_numpy() // block
        ends = np.append(np.flatnonzero(np.diff(blocks)) + 1, [rows.num_rows] if last else [])
        words = np.cumsum(pc.list_value_length(rows.column(2)).to_numpy())
        start = 0
        while start < rows.num_rows and len(ends) and start < ends[-1]:
            before = words[start - 1] if start else 0
            fit = np.searchsorted(words[ends.astype(np.int64) - 1], before + WORDS, side="right") - 1
            end = int(ends[max(fit, np.searchsorted(ends, start, side="right"))])
            yield rows.slice(start, end - start)
            start = end
        held[:] = rows.slice(start).to_batches()

    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= WORDS:
                yield from cut(False)
                size = sum(len(b.column(2).flatten()) for b in held)
    if held:
        yield from cut(True)


def _inverted(batches: Iterator[pa.RecordBatch], block: int, average: float, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """(term, block, ids, weights, top) of rows (number, id, words)."""
    for rows in _portions(batches, block):
        numbers, words = rows.column(0).to_numpy(), rows.column(2).combine_chunks()
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            continue
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        keys = place[coded.indices.to_numpy()] * len(sizes) + np.repeat(np.arange(len(sizes)), sizes)
        keys, times = np.unique(keys, return_counts=True)
        term, doc = np.divmod(keys, len(sizes))
        blocks = numbers[doc] // block
        starts = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(blocks) != 0)))
        weights = times * (k1 + 1) / (times + k1 * (1 - b + b * sizes[doc] / average))
        cuts = pa.array(np.append(starts, len(keys)), pa.int32())
        ids = rows.column(1).combine_chunks().take(pa.array(doc))
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(order[term[starts]])).cast(pa.string()), pa.array(blocks[starts], pa.int64()), pa.ListArray.from_arrays(cuts, ids),
             pa.ListArray.from_arrays(cuts, pa.array(weights, pa.float64())), pa.array(np.maximum.reduceat(weights, starts), pa.float64())],
            names=["term", "block", "ids", "weights", "top"],
        )


def build(docs: DataFrame, folder: str, id_col: str = "id", text_col: str = "text", block: int = BLOCK, buckets: int = BUCKETS, k1: float = K1, b: float = B, only: DataFrame | None = None, only_col: str = "text") -> Index:
    """Writes the index of all rows under a new folder. Ids are longs that tell documents apart; null texts have no words but count as documents.

    With a table ``only`` postings are written for the words of its texts alone; sizes, weights and bounds stay those of the whole texts, so a
    search for these words finds what it finds in the index of all words, and other words are unknown to it."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # few files: their texts are dealt out
        docs = docs.select(id_col, text_col).repartition(cores, id_col)
    words = tokens(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    total, size = docs.select(F.count("*"), F.sum(F.size(words).cast("long"))).first()
    average = size / total if size else 1.0
    numbered = docs.select(F.monotonically_increasing_id().alias("number"), F.col(id_col).cast("long").alias("id"), words.alias("words"))
    made = numbered.mapInArrow(lambda batches: _inverted(batches, block, average, k1, b), "term string, block long, ids array<long>, weights array<double>, top double")
    if only is not None:
        made = made.join(_terms(only, only_col).select("term").distinct(), "term", "left_semi")
    made = made.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    made.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{folder}/postings")
    df = docs.sparkSession.read.schema("term string, ids array<long>, bucket int").parquet(f"{folder}/postings").groupBy("bucket", "term").agg(F.sum(F.size("ids")).alias("df"))
    df.select("bucket", "term", F.log(1 + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).write.parquet(f"{folder}/terms")
    return Index.load(docs.sparkSession, folder)


def _terms(texts: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    return texts.select(*columns, F.explode(F.array_distinct(tokens(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))).alias("term"))


def _best(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 10, query_col: str = "query_id", text_col: str = "text", first: int = FIRST) -> DataFrame:
    """(query_id, rank, id, score): each query's k best documents with one of its words at least, all queries in one job.

    A word counts once however often a query has it. Scores are rounded to DIGITS digits, ties go to the smaller id.
    Queries without known words, null ones among them, have no rows."""
    asked = written(_terms(queries, text_col, F.col(query_col).alias("query_id")).distinct().join(index.terms, "term"), "asked")
    bounds = index.postings.select("bucket", "term", "block", "top").join(asked, ["bucket", "term"])
    bounds = written(bounds.groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("top")).alias("bound")), "bounds")
    least = written(_least(index, asked, _best(bounds, first, [F.desc("bound"), F.col("block")]), k), "least")
    blocks = bounds.join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") + EPSILON >= F.col("least"))).select("block").distinct()
    parts = -(-asked.select("query_id").distinct().count() // QUERIES) or 1
    dealt = asked.join(least, "query_id", "left").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    dealt = dealt.groupBy("bucket", "term", "part").agg(F.collect_list(F.struct("query_id", "idf", "least")).alias("queries"))
    # both are written, so their sizes are known when the postings are joined with them
    dealt, blocks = written(dealt, "dealt"), written(blocks, "blocks")
    hits = index.postings.select("bucket", "term", "block", "ids", "weights", "top").join(dealt, ["bucket", "term"]).join(blocks, "block", "left_semi")
    kind = asked.schema["query_id"].dataType.simpleString()
    rows = hits.select("block", "part", "term", "ids", "weights", "top", "queries").groupBy("block", "part").applyInArrow(lambda t: _block_best(t, k), f"query_id {kind}, id long, score double")
    return _best(rows, k, [F.desc("score"), F.col("id")]).select("query_id", "rank", "id", "score")


def _least(index: Index, asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, least): the score of the k-th best document in the query's given blocks, where these hold so many."""
    wanted = written(asked.join(blocks.select("query_id", "block"), "query_id"), "wanted")  # few rows a query; written, so their number is known
    hits = index.postings.select("bucket", "term", "block", "ids", "weights").join(wanted, ["bucket", "term", "block"]).select("query_id", "idf", F.explode(F.arrays_zip("ids", "weights")).alias("p"))
    scored = hits.groupBy("query_id", F.col("p.ids").alias("id")).agg(F.round(F.sum(F.col("idf") * F.col("p.weights")), DIGITS).alias("score"))
    return _best(scored, k, [F.desc("score"), F.col("id")]).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))


def _block_best(rows: pa.Table, k: int) -> pa.Table:
    """(query_id, id, score) of each query's k best documents in one block, from all its postings of the queries' terms."""
    rows = rows.take(pc.sort_indices(rows.column("term"))).combine_chunks()  # equal documents are added up in the same order
    ids, weights, asked = (rows.column(name).combine_chunks() for name in ("ids", "weights", "queries"))
    cuts, ends = (np.append(0, np.cumsum(pc.list_value_length(c).to_numpy(zero_copy_only=False))) for c in (ids, asked))
    ids = ids.flatten().dictionary_encode("encode")
    asked = asked.flatten()
    query = asked.field("query_id").dictionary_encode("encode")
    order = pc.sort_indices(ids.dictionary, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))  # of equal scores the smaller id comes first
    doc, of, weight = place[ids.indices.to_numpy()], query.indices.to_numpy(), weights.flatten().to_numpy()
    idf = asked.field("idf").to_numpy()
    least = np.full(len(query.dictionary), -np.inf)
    least[of] = pc.fill_null(asked.field("least"), -np.inf).to_numpy(zero_copy_only=False)
    bound = np.bincount(of, idf * np.repeat(rows.column("top").to_numpy(), np.diff(ends)), len(least))
    open_ = bound + EPSILON >= least
    scores = np.zeros((len(least), len(order)))
    for i in range(len(rows)):
        some = slice(ends[i], ends[i + 1])
        some = np.arange(some.start, some.stop)[open_[of[some]]]
        if len(some):
            at = slice(cuts[i], cuts[i + 1])
            scores[of[some][:, None], doc[at]] += idf[some][:, None] * weight[at]
    found = np.where(scores > 0, np.floor(scores * 10**DIGITS + 0.5) / 10**DIGITS, -np.inf)
    found[found + EPSILON < least[:, None]] = -np.inf
    best = np.argsort(-found, axis=1, kind="stable")[:, :k]
    score = np.take_along_axis(found, best, axis=1)
    q, n = np.nonzero(score > -np.inf)
    return pa.table({"query_id": query.dictionary.take(pa.array(q)), "id": ids.dictionary.take(pa.array(order[best[q, n]])), "score": pa.array(score[q, n])})
