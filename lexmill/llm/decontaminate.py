"""Benchmark decontamination: CGK embedding and bit-sampling LSH, then exact edit distances.

The CGK random walk turns a word sequence into a longer one: at each step the current word is put out, and a random
bit, a function of step and word, decides whether the walk moves to the next word. Sequences at a small edit distance
walk together for long stretches, so their embeddings have a small Hamming distance. A table of the LSH samples a few
of the embedding's places; an item and a window as long as the item that agree in a table are aligned, and the exact
word edit distance of the item to its best place in the text decides. Windows begin at every word of a text where the
edit distance can be small enough at all: an edit spoils two of an item's word pairs at most, so a place within the
allowed distance holds a known number of word pairs of items, which running sums count. Words are lower-case and
without ASCII punctuation, and compared as words, not by hash. With the default tables at least 0.95 of items at the
allowed distance are met (see the tests).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: independent walks, half of them from the windows' ends; tables of each walk; places that a table samples
WALKS, TABLES, SAMPLES, SEED = 2, 20, 2, 7
#: share of an item's words that may be edited
EDITS = 0.2
#: characters of items that one pass over the texts holds in memory, at most; more items make more passes
ITEM_CHARS = 1_000_000
CHUNK_WORDS = 1 << 18
#: windows that are embedded at once
BLOCK = 1 << 12
_CLEAN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_SHARES = np.random.default_rng(SEED).random((WALKS, TABLES, SAMPLES))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_indexes: dict[str, Index] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def embed(s: np.ndarray, starts: np.ndarray, stops: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """steps x windows: a CGK walk over each window of s, from its end if the walk's number is odd; past the window the symbol is 0."""
    back, most = walk % 2, len(s) - 1
    at, width = np.zeros(len(starts), dtype=np.int64), stops - starts
    out = np.zeros((steps, len(starts)), dtype=s.dtype)
    for step in range(steps):
        place = stops - 1 - at if back else starts + at
        out[step] = sym = np.where(at < width, s[np.clip(place, 0, most)], 0)
        mixed = (sym.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(2654435761 + 40503 * (2 * (step * WALKS + walk) + 1))
        at += (mixed >> np.uint64(31) & np.uint64(1)).astype(np.int64)
    return out


def signatures(s: np.ndarray, starts: np.ndarray, stops: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """One array per table: the hash of the sampled places of each window's walks, which take two steps per word."""
    column = np.arange(len(starts))
    for walk in range(WALKS):
        walks = embed(s, starts, stops, 2 * int(sizes.max()), walk)
        for shares in _SHARES[walk]:
            h = sizes.astype(np.uint64) * _MIX
            for share in shares:
                h = (h ^ walks[(share * 2 * sizes).astype(np.int64), column].astype(np.uint64)) * _MIX
                h ^= h >> np.uint64(29)
            yield h


def edit_place(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(distance, first, last): the least word edit distance of item to a run of region, and that run, last exclusive."""

    def rows(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        j = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, dtype=np.int64) if free else j.copy()
        for i, x in enumerate(a):
            t = row + 1
            t[1:] = np.minimum(t[1:], row[:-1] + (b != x))
            row = np.minimum.accumulate(t - j) + j
        return row

    row = rows(item, region, True)
    last = int(np.argmin(row))
    back = rows(item[::-1], region[:last][::-1], False)
    return int(row[last]), last - int(np.argmin(back)), last


class Index:
    """Tables over a block of items, given as (id, text). Its memory is bounded by the items' words and TABLES."""

    def __init__(self, items: list[tuple[int, str | None]], edits: float = EDITS) -> None:
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.items = [(i, np.array([number(x) for x in w], dtype=np.int32)) for i, t in items if (w := words_of(t))]
        self.sizes = np.array([len(x) for _, x in self.items], dtype=np.int64)
        self.allowed = (self.sizes * edits).astype(np.int64)
        self.base = np.int64(len(self.vocabulary) + 1)
        owned = [k * self.base + np.unique(x) for k, (_, x) in enumerate(self.items)]
        self.owned = np.sort(np.concatenate(owned)) if owned else np.empty(0, np.int64)
        pairs = [self._pairs(x) for _, x in self.items]
        self.bits = max(16, math.ceil(math.log2(40 * (1 + sum(map(len, pairs))))))
        self.paired = np.zeros(1 << self.bits, dtype=bool)
        for p in pairs:
            self.paired[self._slot(p)] = True
        self.edits = edits
        groups: dict[int, list[int]] = {}
        for n in np.unique(self.sizes).tolist():
            groups.setdefault(int(math.log(n) / math.log(1.25)), []).append(n)
        self.groups = [(g, max(n + int(n * edits) for n in g), min(map(self._least, g))) for g in groups.values()]
        self.tables, self.slots = [], max(12, math.ceil(math.log2(16 * (1 + len(self.items)))))
        for owners, sigs in self._signed():
            order = np.argsort(sigs, kind="stable")
            seen = np.zeros(1 << self.slots, dtype=bool)
            seen[(sigs >> np.uint64(64 - self.slots)).astype(np.int64)] = True
            self.tables.append((sigs[order], owners[order], seen))

    def _pairs(self, s: np.ndarray) -> np.ndarray:
        return s[:-1].astype(np.int64) * self.base + s[1:]

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * _MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def _least(self, n: int) -> int:
        """Word pairs of an item of n words that its place in a text holds at least; 0 for a single word."""
        return n - 1 - 2 * int(n * self.edits)

    def _signed(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(items, signatures) of each table; items are embedded in blocks of like sizes."""
        order, parts = np.argsort(self.sizes, kind="stable"), []
        for i in range(0, len(order), BLOCK):
            ks = order[i : i + BLOCK]
            s, sizes = np.concatenate([self.items[k][1] for k in ks]), self.sizes[ks]
            starts = np.cumsum(sizes) - sizes
            parts.append((ks, list(signatures(s, starts, starts + sizes, sizes))))
        for t in range(WALKS * TABLES if parts else 0):
            yield np.concatenate([ks for ks, _ in parts]).astype(np.int32), np.concatenate([sig[t] for _, sig in parts])

    def windows(self, s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(starts, sizes) of the windows of s that items of their sizes can be near to, in blocks."""
        known = s > 0
        both = np.flatnonzero(known[:-1] & known[1:]) if len(s) > 1 else np.empty(0, np.int64)
        hits = both[self.paired[self._slot(s[both].astype(np.int64) * self.base + s[both + 1])]]
        paired = np.zeros(len(s) + 1, dtype=np.int32)
        paired[hits + 1] = 1
        paired = np.cumsum(paired, dtype=np.int32)  # pairs that begin before a word
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for sizes, reach, least in self.groups:
            if least < 1:
                places = np.flatnonzero(known)
            else:
                stop = np.r_[paired[reach - 1 :], np.full(min(reach - 1, len(s) + 1), paired[-1])][: len(s)]
                places = np.flatnonzero(stop - paired[: len(s)] >= least)
            for n in sizes if len(places) else ():
                stop = np.minimum(places + n + int(n * self.edits) - 1, len(s))
                own = places[paired[stop] - paired[places] >= self._least(n)]
                for i in range(0, len(own), BLOCK):
                    part = own[i : i + BLOCK]
                    held.append((part, np.full(len(part), n, dtype=np.int64)))
                    if sum(len(h[0]) for h in held) >= BLOCK:
                        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                        held = []
        if held:
            yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])

    def candidates(self, s: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items, starts) of all windows that agree with an item in a table and whose surroundings hold enough of its words."""
        found = []
        for (keys, owners, seen), sigs in zip(self.tables, signatures(s, starts, np.minimum(starts + sizes, ends), sizes)):
            at = np.flatnonzero(seen[(sigs >> np.uint64(64 - self.slots)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, sigs[at], "left"), np.searchsorted(keys, sigs[at], "right")
            n = hi - lo
            hit = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append((owners[hit].astype(np.int64) << 40) + np.repeat(starts[at], n))
        both = np.unique(np.concatenate(found))
        item, place = both >> 40, both & ((1 << 40) - 1)
        keep = np.zeros(len(item), dtype=bool)
        for i in range(0, len(item), BLOCK):
            k, p = item[i : i + BLOCK], place[i : i + BLOCK]
            n, allowed = self.sizes[k], self.allowed[k]
            first, last = np.maximum(p - allowed - 1, 0), np.minimum(p + n + allowed + 1, len(s))
            held = np.zeros(len(k), dtype=np.int64)
            for j in range(int((last - first).max())):
                asked = k * self.base + s[np.minimum(first + j, len(s) - 1)]
                at = np.minimum(np.searchsorted(self.owned, asked), len(self.owned) - 1)
                held += (self.owned[at] == asked) & (first + j < last)
            keep[i : i + BLOCK] = held >= n - allowed  # each edit spoils one of the item's words at most
        return item[keep], place[keep]

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(number of the text, item id, distance, words of the item, first word, last word) of the best place of each item within the allowed distance, over whole texts."""
        parts, owner, sizes, held = [], [], [], 0
        for n, text in enumerate(texts):
            words = words_of(text)
            parts.append(np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int32, count=len(words)))
            owner.append(n)
            sizes.append(len(words))
            held += len(words)
            if held >= CHUNK_WORDS:
                yield from self._search(np.concatenate(parts), owner, sizes)
                parts, owner, sizes, held = [], [], [], 0
        if held:
            yield from self._search(np.concatenate(parts), owner, sizes)

    def _search(self, s: np.ndarray, owner: list[int], sizes: list[int]) -> Iterator[tuple[int, int, int, int, int, int]]:
        ends = np.cumsum(sizes)
        begins = ends - np.array(sizes)
        found: dict[tuple[int, int], list[int]] = {}
        for starts, window in self.windows(s):
            text = np.searchsorted(ends, starts, "right")
            items, places = self.candidates(s, starts, window, ends[text])
            for d, k, p in zip(np.searchsorted(ends, places, "right").tolist(), items.tolist(), places.tolist()):
                found.setdefault((d, k), []).append(p)
        for (d, k), places in sorted(found.items()):
            item_id, item = self.items[k]
            lo, hi = int(begins[d]), int(ends[d])
            allowed, n, best = int(self.allowed[k]), len(item), None
            slack, places = allowed + 1, sorted(set(places))
            runs = [[places[0], places[0]]]
            for p in places[1:]:
                if p - runs[-1][1] <= 2 * slack:
                    runs[-1][1] = p
                else:
                    runs.append([p, p])
            for a, b in runs:
                first, last = max(lo, a - slack), min(hi, b + n + slack)
                region = s[first:last]
                if np.isin(item, region).sum() < n - allowed:
                    continue
                dist, x, y = edit_place(item, region)
                if dist <= allowed and (best is None or dist < best[0]):
                    best = (dist, first + x - lo, first + y - lo - 1)
            if best:
                yield owner[d], item_id, best[0], n, best[1], best[2]


def _blocks(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator:
    """Broadcast blocks of items, each of bounded size; one alone, empty, if there are none."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("t is not null").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.length("t") + 1)).first()[0] or 0) // ITEM_CHARS))
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).orderBy("i", "t").collect()
        yield benchmark.sparkSession.sparkContext.broadcast([(r["i"], r["t"]) for r in rows])


def _index(name: str, shared, edits: float) -> Index:
    """A worker keeps one index at a time."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Index(shared.value, edits)
    return _indexes[name]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """(id, item_id, distance, n_words, first_word, last_word): a row for each text and item that is found in it.

    distance counts words inserted, left out or replaced, at most ``edits`` of the item's n_words; the place is in words
    from 0. Null and empty texts and items hold nothing. Items are taken in blocks of bounded size, each by one pass
    over the texts; nothing is shuffled."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, item_id long, distance int, n_words int, first_word long, last_word long"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    out = None
    for shared in _blocks(benchmark, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared, edits)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                got = [[] for _ in kinds]
                best: dict[tuple[int, int], tuple] = {}
                for n, item, *rest in index.matches(batch.column(1).to_pylist()) if index.items else ():
                    best[n, item] = min(best.get((n, item), tuple(rest)), tuple(rest))
                for (n, item), rest in best.items():
                    for col, x in zip(got, (ids[n], item, *rest)):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(got, kinds)], names=["id", "item_id", "distance", "n_words", "first_word", "last_word"])

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """The rows of docs, with all their columns, in whose texts no item is found. Each row is judged by its own text,
    whatever its id; null and empty texts stay. Nothing is shuffled."""
    out, at = docs, docs.columns.index(text_col)
    for shared in _blocks(benchmark, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared, edits)
            for batch in batches:
                found = {m[0] for m in index.matches(batch.column(at).to_pylist())} if index.items else set()
                yield batch.filter(pa.array([n not in found for n in range(batch.num_rows)], pa.bool_())) if found else batch

        out = out.mapInArrow(run, docs.schema)
    return out


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark).withColumnRenamed("id", "doc_id")
