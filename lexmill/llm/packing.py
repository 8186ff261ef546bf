"""Best-fit packing by linear grouping.

Documents are cut into pieces of at most ``capacity`` tokens. Only the number of pieces of each length decides where
they go, and there are at most ``capacity`` lengths, so the plan is made on the driver from that histogram, whatever the
input's size: lengths over ``small`` are ranked and grouped into groups of equal cardinality, each rounded up to its
longest piece; configurations of these few sizes are chosen one after another, each with the largest remaining size
and the fullest fill; actual pieces then take their groups' places, and the room they leave, also below the rounded
size, is given to the small pieces by best fit. The plan holds ranges of ranks; executors rank the pieces of a length
in buckets and look their places up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.portions import portions
from lexmill.llm.tokens import DEFAULT, encoder
from lexmill.scratch import written

CAPACITY, SEPARATOR = 1024, 2
#: rows of a plan that may be broadcast; a longer plan is joined by a shuffle
PLAN_ROWS = 200_000
#: pieces of a bucket of ranks, at least; the square root of a length's pieces beyond that
BUCKET = 256


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR, vocabulary: str = DEFAULT, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row[, ids]): each document's ids and the separator, cut from the end into
    pieces of ``capacity``, so that only the first may be shorter. Null counts as empty: the separator alone. row is a
    number of the input's row, which keeps rows with one id, or without one, apart."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "row"))]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(vocabulary), separator.to_bytes(4, "little")
        for batch in portions(batches, 1):
            cols: list[list] = [[] for _ in kinds]
            for doc, text, row in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = enc.ids(text.as_py() or "") + last
                n = len(ids) // 4
                ends = range((n - 1) % capacity + 1, n + 1, capacity)
                for k, end in enumerate(ends):
                    start = max(0, end - capacity)
                    part = ids[4 * start : 4 * end]
                    for col, x in zip(cols, (doc, k, start, end - start, zlib.crc32(part), row, part)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=schema.names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.monotonically_increasing_id()).mapInArrow(run, schema)


def _fill(sizes: list[int], left: list[int], room: int) -> list[int]:
    """Indices whose sizes add up to the most that fits in room, larger sizes first; left: how many of each there are.

    Sets of reachable sums are bit strings; sizes are taken up from small to large and given out from large to small."""
    mask, reach, seen = (1 << (room + 1)) - 1, 1, []
    for i in range(len(sizes) - 1, -1, -1):
        if not left[i] or sizes[i] > room:
            continue
        for _ in range(min(left[i], room // sizes[i])):
            seen.append((i, reach))
            grown = (reach | reach << sizes[i]) & mask
            if grown == reach:
                break
            reach = grown
        if reach >> room & 1 and len(seen) > 64:
            break
    total, out = reach.bit_length() - 1, []
    for i, before in reversed(seen):
        if not before >> total & 1:
            out.append(i)
            total -= sizes[i]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 512, small: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, to rank, sequence of the first, offset): pieces of a length, by rank, take consecutive sequences."""
    small = capacity // 8 if small is None else small
    out: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, sequences)
    rooms: list[int] = []
    sequences = 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                insort(rooms, room)
            free.setdefault(room, []).append((first, n))

    large = sorted((n for n in histogram if n > small), reverse=True)
    share = max(1, -(-sum(histogram[n] for n in large) // groups))
    sizes, runs = [], []  # of each group: its size, and its pieces as [length, from rank, to rank]
    free_in_group = 0
    for n in large:
        at, end = 0, histogram[n]
        while at < end:
            if not free_in_group:
                sizes.append(n)
                runs.append([])
                free_in_group = share
            took = min(free_in_group, end - at)
            runs[-1].append([n, at, at + took])
            at, free_in_group = at + took, free_in_group - took
    left = [sum(b - a for _, a, b in r) for r in runs]
    for g in range(len(sizes)):
        while left[g]:
            left[g] -= 1
            config = [g, *_fill(sizes, left, capacity - sizes[g])]
            left[g] += 1
            uses = {i: config.count(i) for i in config}
            times = min(left[i] // k for i, k in uses.items())
            slots = []
            for i in config:
                left[i] -= times
                need, own = times, []
                while need:
                    run = runs[i][0]
                    took = min(need, run[2] - run[1])
                    own.append((run[0], run[1], took))
                    run[1] += took
                    need -= took
                    if run[1] == run[2]:
                        runs[i].pop(0)
                slots.append(own)
            done = 0
            while done < times:  # a stretch in which each place holds pieces of one length
                step, offset = min(s[0][2] for s in slots), 0
                for s in slots:
                    n, rank, took = s.pop(0)
                    out.append((n, rank, rank + step, sequences + done, offset))
                    offset += n
                    if took > step:
                        s.insert(0, (n, rank + step, took - step))
                leave(capacity - offset, sequences + done, step)
                done += step
            sequences += times
    for n in sorted((n for n in histogram if n <= small), reverse=True):
        rank, end = 0, histogram[n]
        while rank < end:
            k = bisect_left(rooms, n)
            if k == len(rooms):
                opened = max(1, (end - rank) // (capacity // n))
                leave(capacity, sequences, opened)
                sequences += opened
                continue
            room = rooms[k]
            first, there = free[room].pop()
            took = min(there, end - rank)
            if took < there:
                free[room].append((first + took, there - took))
            elif not free[room]:
                del free[room]
                rooms.pop(k)
            out.append((n, rank, rank + took, first, capacity - room))
            leave(room - n, first, took)
            rank += took
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = 512) -> DataFrame:
    """The pieces with sequence_id and offset; sequences have no gaps before their pieces' end.

    cut is read more than once and has to be a written table: its row numbers deal pieces out to buckets, so neither null
    nor repeated ids fill one. Ranks within a length are counted in buckets of bounded
    size: a window ranks within a bucket, and a running sum over the buckets' counts gives each bucket's first rank."""
    spark = cut.sparkSession
    counted = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    buckets = {n: -(-k // max(BUCKET, int(k**0.5))) for n, k in counted.items()}
    of = F.broadcast(spark.createDataFrame([(n, b) for n, b in buckets.items()], "length long, buckets long"))
    dealt = cut.join(of, "length").withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), "buckets")).drop("buckets")
    sums = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = dealt.withColumn("at", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "piece")) - 1)
    ranked = ranked.join(sums, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("at")).drop("bucket", "first", "at", "row")
    made = plan(counted, capacity, groups)
    places = spark.createDataFrame(made, "size long, low long, high long, base long, offset long")
    places = F.broadcast(places) if len(made) <= PLAN_ROWS else places
    placed = ranked.join(places, (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.withColumn("sequence_id", F.col("base") + F.col("rank") - F.col("low")).drop("size", "low", "high", "base", "rank")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, groups: int = 512, vocabulary: str = DEFAULT, with_ids: bool = False) -> DataFrame:
    cut = written(pieces(docs, id_col, text_col, capacity, vocabulary=vocabulary, with_ids=with_ids), "pieces")
    return pack(cut, capacity, groups)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
