"""A word analyser for languages that write syllables apart: a lexicon of collocations learned from the texts, and the best path of each text through it.

A run of two or three syllables is a word if it is frequent and comes much oftener than its syllables would meet by
chance. A text is then cut so that the sum of its words' scores is largest; syllables of no word stay by themselves.
Words are written with a joining letter between their syllables, so they are single terms to everything that splits at
non-letters, BM25 among it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import fold_diacritics
from lexmill.operators.retrieval import bm25_folded, tokens
from lexmill.scratch import discard, written

#: most syllables of a word, least occurrences, least logarithm of occurrences over those by chance
LONGEST, MIN_COUNT, LEAST = 3, 20, 3.0
#: entries of a lexicon, at most: those with the largest score times occurrences
ENTRIES = 200_000
#: hashes that a task counts at once, and parts of all hashes, by their first bits, that are summed up apart
CHUNK, PART_BITS = 4_000_000, 10
HASH_BITS = 32
#: bits of the table of frequent hashes, 16 MB whatever the texts, that goes to every worker: one for each 32 hashes
TABLE_BITS = 27
#: a letter (modifier apostrophe) that joins the syllables of a word
JOIN = "ʼ"


def _hash(syllables: list[Column]) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*syllables), 64 - HASH_BITS)


def frequent(hashes: DataFrame, least: int) -> np.ndarray:
    """A table of 2 ** TABLE_BITS bits, told by a hash's first bits, in which all hashes of HASH_BITS bits, one per row, are marked
    that come ``least`` times or more; ``marked`` reads it. Others that share a bit with one are marked with it.

    Tasks count what they hold in chunks; what is shuffled is a chunk's different hashes as steps from one to the next, with
    their counts, packed by the parts that are summed up: about two bytes each, where a row for each took twelve."""
    low = HASH_BITS - PART_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            n += batch.num_rows
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint32))
            if n >= CHUNK:
                yield packed(np.concatenate(held))
                held, n = [], 0
        if held:
            yield packed(np.concatenate(held))

    def packed(h: np.ndarray) -> pa.RecordBatch:
        values, n = np.unique(h, return_counts=True)
        parts = (values >> np.uint32(low)).astype(np.int64)
        firsts = np.flatnonzero(np.diff(parts, prepend=-1))
        bodies = [_packed(v & np.uint32((1 << low) - 1), c.astype(np.uint32)) for v, c in zip(np.split(values, firsts[1:]), np.split(n, firsts[1:]))] if len(firsts) else []
        return pa.RecordBatch.from_arrays([pa.array(parts[firsts], pa.int32()), pa.array(bodies, pa.binary())], names=["part", "body"])

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        total: np.ndarray = np.zeros(1 << low, dtype=np.int64)
        for body in table.column("body"):
            values, n = _unpacked(body.as_py())
            total[values] += n
        bits = np.packbits((total >= least).reshape(-1, 1 << (HASH_BITS - TABLE_BITS)).any(axis=1), bitorder="little")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros((1 << PART_BITS, 1 << (TABLE_BITS - PART_BITS - 3)), dtype=np.uint8)
    for r in hashes.mapInArrow(count, "part int, body binary").groupBy("part").applyInArrow(summed, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set."""
    at = hashes >> (HASH_BITS - TABLE_BITS)
    return table[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _places(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """(w, at) of rows (w, h): the places from 0 at which the hashes of an array are marked. The table goes to every worker; nothing is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(1)
            sizes = h.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            hit = marked(shared.value, h.flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            place = np.arange(len(hit)) - np.repeat(ends[:-1], sizes)
            before = np.concatenate([[0], np.cumsum(hit)])[ends]
            at = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(place[hit], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), at], names=["w", "at"])

    return rows.mapInArrow(run, "w array<string>, at array<int>")


def _packed(values: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending numbers and how often each comes, byte by byte of all steps and counts, so that what is zero in most of them shrinks."""
    planes = np.stack([np.diff(values, prepend=np.uint32(0)), n]).astype("<u4").view(np.uint8).reshape(2, -1, 4)
    return zlib.compress(planes.transpose(0, 2, 1).tobytes(), 1)


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(2, 4, -1).transpose(0, 2, 1)
    steps, n = np.ascontiguousarray(planes).view("<u4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int64), n


def collocations(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, min_count: int = MIN_COUNT, least: float = LEAST) -> DataFrame:
    """(word, n, score) of all runs of two to ``longest`` syllables, parted by blanks, that are words by the bounds; counted over all rows.

    score is ln(n * N ** (k - 1) / (n1 * ... * nk)) with N syllables in all and ni occurrences of the i-th. Null texts have none.

    Runs are counted by hashes first; only those whose hash is marked as one that comes ``min_count`` times, all words among
    them, are then counted by their letters, where they stand: no join shuffles the runs. The texts are split once; their syllables are read once by themselves and twice for each length of run."""
    split = written(docs.select(tokens(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("w")), "split", compression="zstd")
    single = written(split.select(F.explode("w").alias("s")).groupBy("s").agg(F.count("*").alias("own")), "syllables")
    total = single.agg(F.sum("own").alias("total"))

    counts = []
    for k in range(2, longest + 1):
        hashes = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: _hash([F.get("w", i + j) for j in range(k)]))
        long = split.filter(F.size("w") >= k)
        table = frequent(long.select(F.explode(hashes).alias("h")), min_count)
        names = [f"s{j}" for j in range(k)]
        runs = _places(long.select("w", hashes.alias("h")), table).select("w", F.explode("at").alias("at"))
        found = runs.select(*(F.get("w", F.col("at") + j).alias(s) for j, s in enumerate(names))).groupBy(*names).agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
        counts.append(found.select(F.concat_ws(" ", *names).alias("word"), F.lit(k).alias("k"), "n"))
    counts = written(reduce(DataFrame.unionByName, counts), "runs")
    discard(split)
    parts = counts.select("word", "k", "n", F.explode(F.split("word", " ")).alias("s")).join(single, "s")
    scored = parts.groupBy("word", "k", "n").agg(F.sum(F.log("own")).alias("apart")).join(F.broadcast(total))  # a single row
    score = F.log("n") + (F.col("k") - 1) * F.log("total") - F.col("apart")
    return scored.select("word", "n", score.alias("score")).filter(F.col("score") >= least)


def best_path(syllables: list[str], scores: dict[str, float], longest: int = LONGEST) -> list[str]:
    """The words of the cut with the largest sum of scores; of equal cuts the one with the shorter last words."""
    best, back = [0.0], [0]
    for i in range(1, len(syllables) + 1):
        top, at = best[i - 1], 1
        for k in range(2, min(longest, i) + 1):
            score = scores.get(" ".join(syllables[i - k : i]))
            if score is not None and best[i - k] + score > top:
                top, at = best[i - k] + score, k
        best.append(top)
        back.append(at)
    out, i = [], len(syllables)
    while i:
        out.append(JOIN.join(syllables[i - back[i] : i]))
        i -= back[i]
    return out[::-1]


def segmented(docs: DataFrame, lexicon: DataFrame, text_col: str = "text", name: str = "words", longest: int = LONGEST, entries: int = ENTRIES) -> DataFrame:
    """docs with a text of words, parted by blanks. The lexicon, of bounded size, goes to every worker; nothing is shuffled."""
    kept = lexicon.orderBy(F.desc(F.col("score") * F.col("n")), "word").limit(entries).select("word", "score").collect()
    shared = docs.sparkSession.sparkContext.broadcast(dict(map(tuple, kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(best_path(w.as_py(), shared.value, longest)) for w in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words, pa.string())], names=batch.schema.names)

    schema = docs.withColumn(name, F.lit("")).schema
    return docs.withColumn(name, tokens(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).mapInArrow(run, schema)


def word_search(docs: DataFrame, lexicon: DataFrame, query: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, score) by BM25 over words, exact ones and, at a lower weight, those without marks.

    The query is cut by the same lexicon and its entries without marks, so it finds words however it is typed."""
    plain = lexicon.withColumn("word", fold_diacritics(F.col("word")))
    both = lexicon.select("word", "n", "score").unionByName(plain.select("word", "n", "score")).groupBy("word").agg(F.max("n").alias("n"), F.max("score").alias("score"))
    asked = segmented(docs.sparkSession.createDataFrame([(query,)], "q string"), both, "q").first()["words"]
    return bm25_folded(segmented(docs.select(id_col, text_col), lexicon, text_col), asked.split(), id_col, "words")
