"""SimHash near-duplicates, searched by pigeonring chains.

A text is lower-cased (A-Z), split at ASCII white space and cut into word shingles, repeats included; a bit of its
fingerprint is 1 if more than half of the shingles' XXH64 values have it set.

Search: a fingerprint is cut into tau + 1 segments on a ring (three at least). If two fingerprints differ in at most tau bits, there is
a start segment from which every chain of l segments differs in at most floor(l * tau / segments) bits. The budgets of
the chains of one and two segments are 0 and 1 at most, so the first two segments of the chain are the join key: one side has
its own value, the other all values at most one bit away in the second segment. Candidates that meet in a key are
tested against the budgets of the longer chains, and what is left by the full Hamming distance. Rows per fingerprint
are fixed, whatever the group sizes; equal fingerprints are one class and are never paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.components import connected_components
from lexmill.llm.filters import text_digest
from lexmill.llm.portions import portions
from lexmill.scratch import discard, written

BITS = 64
_BLOCK = 1 << 16
#: for the order of shingles: texts of the sample, texts of it that share a common shingle at least, common shingles kept
SAMPLE, COMMON, LISTED = 20_000, 3, 200_000
#: rounds in which a key's texts are held against some of them, before all that are still apart are, and how many
TURNS, HUBS = 2, 4
#: bits by which fingerprints differ at most whose texts are tried first
TAU = 2
#: digests of texts that may be broadcast; more are joined by a shuffle
BROADCAST_DIGESTS = 200_000
#: longs of parity bits per text
PARITY = 16


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of that many words; of the whole sequence if there are fewer; none for a text without words."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype="<u8")
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, seed)], dtype="<u8")
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())), dtype="<u8", count=len(parts) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority bits as a signed 64-bit number; 0 without shingles."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp). Null and empty texts: 0. One row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(text.as_py(), words, seed)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def segments(tau: int) -> list[tuple[int, int]]:
    """(first bit, width) of each of tau + 1 segments, three at least, so that two fit into a key."""
    n = max(3, tau + 1)
    cuts = [i * BITS // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _segment(fp, first: int, width: int):
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def near_pairs(fps: DataFrame, tau: int = 2, col: str = "fp") -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints that differ in at most tau bits; tau from 1."""
    segs, fp = segments(tau), F.col("fp")
    base = fps.select(F.col(col).alias("fp")).distinct()

    def keys(variants: bool) -> list:
        out = []
        for i, (first, width) in enumerate(segs):
            nfirst, nwidth = segs[(i + 1) % len(segs)]
            head = F.lit(i << (width + nwidth)).bitwiseOR(F.shiftleft(_segment(fp, first, width), nwidth))
            nxt = _segment(fp, nfirst, nwidth)
            out.append(head.bitwiseOR(nxt))
            if variants:
                out += [head.bitwiseOR(nxt.bitwiseXOR(F.lit(1 << j))) for j in range(nwidth)]
        return out

    index = base.select(fp.alias("a"), F.explode(F.array(*keys(False))).alias("key"))
    probe = base.select(fp.alias("b"), F.explode(F.array(*keys(True))).alias("key"))
    met = probe.join(index, "key").filter(F.col("a") < F.col("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    parts = [F.bit_count(_segment(diff, first, width)) for first, width in segs]
    ring = None
    for i in range(len(segs)):
        total, ok = F.lit(0), None
        for n in range(1, len(segs) + 1):
            total = total + parts[(i + n - 1) % len(segs)]
            step = total <= F.lit(n * tau // len(segs))
            ok = step if ok is None else ok & step
        ring = ok if ring is None else ring | ok
    return met.filter(ring).filter(F.bit_count(diff) <= tau).select("a", "b").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, tau: int = 2, seed: int = 42) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over fingerprints at most tau bits apart.

    Null ids stay as rows and are never the smallest, unless a class has no other: then component_id is null. Equal ids
    count as one node of each of their texts' classes."""
    fps = written(fingerprints(docs, id_col, text_col, words, seed), "fps")
    links = connected_components(near_pairs(fps, tau))
    return _labelled(fps, links)


def _labelled(fps: DataFrame, links: DataFrame) -> DataFrame:
    """Class (fingerprint) -> smallest id, then over linked classes; classes are few against rows, minima are combined before the shuffle."""
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    rooted = least.join(links.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    tops = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = written(rooted.select("fp", "root").join(tops.hint("rebalance"), "root").select("fp", "component_id"), "classes")
    return fps.join(names, "fp").select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, digest, component_id, kept): one row per input row. component_id is the smallest id reachable over links,
    pairs of texts whose distinct word shingles have at least that Jaccard similarity; kept marks one of each group's
    texts, that with the smallest id (null ids last) and MD5 digest. Rows of equal id and text share these values.

    Texts are first searched by their fingerprints, by pigeonring chains as in ``near_pairs``: of equal fingerprints each text is
    tried against one, of fingerprints at most TAU bits apart one against one. A fingerprint alone makes no link, and most
    links at the similarity are further apart, so what is still apart afterwards goes on by exact search:

    No link is lost: texts with equal shingle sets (told by a 128-bit digest) are one class, whatever their ids, and
    classes are joined by prefix filter. With the shingles of every text in one order, two texts at the similarity share
    one of their first size - ceil(similarity * size) + 1, so those are the join keys. What comes of a key is cut only
    by bounds that no link breaks (sizes, places in the order, parity bits) and then verified by exact intersection.
    The order puts shingles that are frequent in a sample last; it decides the work, not the result.

    A class leaves a key where even the key's smallest set and longest rest are out of its reach.

    A hot key would meet itself in pairs. So its classes are first held against a few hubs alone, in several rounds: the
    least of the key's classes in orders that all keys share, so a group of near copies meets few hubs; half of these
    orders go by place first, as texts with few shingles of their own before a shared one are in the middle of their
    group. What the links join needs no further test; all pairs of a key that are still apart are tried in the end,
    against the parity bits within the join.
    Null and empty texts are one class. Classes are numbered, so rows that share an id, or have none, stay apart."""
    prefixes = written(_prefixes(docs, id_col, text_col, words, similarity), "prefixes")
    who = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    classes = prefixes.groupBy("d1", "d2").agg(F.min(who).alias("least"), F.min(F.col("row")).alias("row"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    named = classes.select(F.col("row").alias("own"), "node")
    reps = prefixes.filter("size > 0").join(named, F.col("row") == F.col("own")).select("node", "digest", "d1", "d2", "size", "bits", "fp", "prefix")
    reps = written(reps, "reps")
    rows = written(prefixes.select("id", "digest", "d1", "d2"), "rows")
    discard(prefixes)
    lists = reps.select(F.col("node").alias("id"), "size", F.posexplode("prefix").alias("place", "key"), F.col("node").alias("root"))
    lists = written(_within_reach(lists, similarity), "lists")
    links = _more_links(docs, text_col, words, similarity, reps, _by_fingerprint(reps), None)
    lists = _open(lists, links, None, similarity)
    for turn in range(TURNS):
        if lists.isEmpty():
            break
        orders = [(F.col("place") if i % 2 else F.lit(0), F.xxhash64(F.lit(turn * HUBS + i), "id")) for i in range(HUBS)]
        own = [F.struct(first.alias("first"), then.alias("then"), "id", "size", "place", "root") for first, then in orders]
        hubs = lists.groupBy("key").agg(*(F.min(o).alias(f"f{i}") for i, o in enumerate(own)))
        hubs = hubs.select(F.col("key").alias("k"), F.explode(F.array_distinct(F.array(*(F.struct(*(f"f{i}.{c}" for c in ("id", "size", "place", "root"))) for i in range(HUBS))))).alias("f"))
        hubs = hubs.hint("rebalance")
        met = lists.join(hubs, F.col("key") == F.col("k")).filter("root <> f.root")
        pairs = _possible(met.select("id", "size", "place", F.col("f.id").alias("id2"), F.col("f.size").alias("size2"), F.col("f.place").alias("place2")), similarity)
        before, links = links, _more_links(docs, text_col, words, similarity, reps, pairs, links)
        lists = _open(lists, links, before, similarity)
    if not lists.isEmpty():
        left = lists.join(reps.select(F.col("node").alias("id"), "bits"), "id")
        right = left.select("key", *(F.col(c).alias(f"{c}2") for c in ("id", "size", "place", "root", "bits")))
        met = left.join(right, "key").filter("id < id2 and root <> root2")
        pairs = _possible(met.filter(_parity_allows("bits", "bits2", F.col("size") + F.col("size2"), similarity)), similarity)
        links = _more_links(docs, text_col, words, similarity, reps, pairs, links)
    discard(lists, reps)
    rooted = _rooted(classes, links, "node", "top")
    tops = rooted.groupBy("top").agg(F.min("least").alias("first")).hint("rebalance")
    named = written(rooted.select("d1", "d2", "top").join(tops, "top").select("d1", "d2", "first"), "named")
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))
    discard(classes)
    return rows.join(named, ["d1", "d2"]).select("id", "digest", F.col("first.id").alias("component_id"), kept.alias("kept"))


def _by_fingerprint(reps: DataFrame) -> DataFrame:
    """(x, y) of classes to be verified: each against the least of its fingerprint, and the least of near fingerprints."""
    least = reps.groupBy("fp").agg(F.min("node").alias("hub"))
    same = reps.select("node", "fp").join(least, "fp").filter("node <> hub").select(F.col("hub").alias("x"), F.col("node").alias("y"))
    a, b = (least.select(F.col("fp").alias(c), F.col("hub").alias(f"hub_{c}")) for c in "ab")
    near = near_pairs(reps, TAU).join(a, "a").join(b, "b").select(F.least("hub_a", "hub_b").alias("x"), F.greatest("hub_a", "hub_b").alias("y"))
    return same.unionByName(near)


def _within_reach(lists: DataFrame, similarity: float) -> DataFrame:
    """The rows of keys whose classes aren't all joined yet that may pass ``_possible`` with another row of their key: its
    smallest size and longest rest bound all partners."""
    rest = F.col("size") - F.col("place")
    ends = (F.min("root").alias("lowest"), F.max("root").alias("highest"))
    keys = lists.groupBy("key").agg(F.min("size").alias("low"), F.max(rest).alias("far"), *ends).filter("lowest <> highest")
    keys = keys.select(F.col("key").alias("k"), "low", "far").hint("rebalance")
    near = F.least(rest, "far") >= _shared(F.col("size") + F.col("low"), similarity)
    return lists.join(keys, F.col("key") == F.col("k")).filter(near).select("key", "id", "size", "place", "root")


def _rooted(rows: DataFrame, links: DataFrame | None, node: str, root: str) -> DataFrame:
    """rows with their nodes' roots; a node without links, or all of them where there are none (None), is its own."""
    if links is None:
        return rows.withColumn(root, F.col(node))
    return rows.join(links.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left").withColumn(root, F.coalesce(root, node))


def _open(lists: DataFrame, links: DataFrame | None, before: DataFrame | None, similarity: float) -> DataFrame:
    """The lists with the classes' roots, written anew without what the links have joined; as they were if no link came in."""
    if links is before:
        return lists
    after = written(_within_reach(_rooted(lists.drop("root"), links, "id", "root"), similarity), "open")
    discard(lists)
    return after


def _shared(sizes: Column, similarity: float) -> Column:
    """Shingles that a link with that sum of sizes shares at least."""
    return F.lit(similarity / (1 + similarity) - 1e-9) * sizes


def _parity_allows(x: str, y: str, sizes: Column, similarity: float) -> Column:
    """Bits that differ in parity are shingles of one set alone, so more of them than a link can have rule a pair out."""
    apart = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(PARITY)), F.lit(0))
    return apart <= F.lit((1 - similarity) / (1 + similarity) + 1e-9) * sizes


def _possible(met: DataFrame, similarity: float) -> DataFrame:
    """(x, y) of the met pairs that sizes and places allow. A link's first shared key passes, whatever becomes of its others."""
    need = _shared(F.col("size") + F.col("size2"), similarity)
    rest = F.least(F.col("size") - F.col("place"), F.col("size2") - F.col("place2"))
    return met.filter(rest >= need).select(F.least("id", "id2").alias("x"), F.greatest("id", "id2").alias("y")).filter("x < y").distinct()


def _more_links(docs: DataFrame, text_col: str, words: int, similarity: float, reps: DataFrame, pairs: DataFrame, links: DataFrame | None) -> DataFrame | None:
    """links (node, root), joined further by those of the pairs that are similar; links itself, without further jobs, if there are none."""
    x, y = (reps.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("bits").alias(f"b{c}")) for c in "xy")
    may = _parity_allows("bx", "by", F.col("nx") + F.col("ny"), similarity)
    pairs = written(pairs.join(x, "x").join(y, "y").filter(may).select("x", "y"), "candidates")
    close = None if pairs.isEmpty() else _verified(docs, text_col, words, similarity, reps, pairs)
    discard(pairs)
    if close is None or close.isEmpty():
        return links
    if links is not None:
        close = links.select(F.col("node").alias("x"), F.col("root").alias("y")).unionByName(close)
    return connected_components(close, "x", "y")


def _common(docs: DataFrame, id_col: str, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample share, sorted, and how many do."""
    every = max(1, docs.count() // SAMPLE)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.pmod(F.xxhash64("id", "text"), F.lit(every)) == 0)
    counts = shingle_sets(texts, words).select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter(f"n >= {COMMON}")
    table = counts.orderBy(F.desc("n"), "h").limit(LISTED).toArrow()
    h, n = (table.column(c).to_numpy() for c in ("h", "n"))
    h = h.astype("<i8").view("<u8")
    order = np.argsort(h)
    return h[order], n[order]


def _prefixes(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """(row, id, digest, d1, d2, size, bits, prefix) per row: a number, the MD5 digest of the text, digest and size of
    the set of shingles, parities of the numbers of shingles that fall on each of PARITY * 64 bits, the fingerprint,
    and the first shingles in order."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, id_col, text_col, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, counts = common.value
        for batch in portions(batches, 2):
            digests, sizes, bits, fps, prefixes = [], [], [], [], []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), words)
                fps.append(fingerprint(hashes))
                s = np.unique(hashes)
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8"))
                sizes.append(len(s))
                odd = np.bincount((s % np.uint64(PARITY * 64)).astype(np.int64), minlength=PARITY * 64) & 1
                bits.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"))
                often = np.zeros(len(s), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = np.where(known[at] == s, counts[at], 0)
                first = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1
                prefixes.append(s[np.argsort(often, kind="stable")[:first]].view("<i8"))
            d = np.array(digests, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(fps, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["id", "digest", "d1", "d2", "size", "bits", "fp", "prefix"],
            )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_digest(F.col(text_col)).alias("digest"), text.alias("text"))
    made = texts.mapInArrow(run, "id long, digest string, d1 long, d2 long, size long, bits array<long>, fp long, prefix array<long>")
    return made.withColumn("row", F.monotonically_increasing_id())


def _verified(docs: DataFrame, text_col: str, words: int, similarity: float, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (x, y) whose shingle sets have that Jaccard similarity at least; of the texts, those in a pair alone are
    cut into shingles again, found by digest: by a broadcast of bounded size, or beyond it by a shuffle."""
    ids = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
    asked = written(reps.select("node", F.col("digest").alias("own")).join(ids, "node"), "asked")
    small = asked.count() <= BROADCAST_DIGESTS
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(text_digest(F.col(text_col)).alias("digest"), text.alias("text"))
    texts = texts.join(F.broadcast(asked) if small else asked, F.col("digest") == F.col("own")).select(F.col("node").alias("id"), "text")
    sets = written(shingle_sets(texts.groupBy("id").agg(F.first("text").alias("text")), words), "shingles")
    x, y = sets.select(F.col("id").alias("x"), F.col("s").alias("sx")), sets.select(F.col("id").alias("y"), F.col("s").alias("sy"))
    close = pairs.join(x, "x").join(y, "y").withColumn("both", F.size(F.array_intersect("sx", "sy")))
    close = close.filter(F.col("both") >= F.lit(similarity) * (F.size("sx") + F.size("sy") - F.col("both")) - 1e-9)
    out = written(close.select("x", "y"), "close")
    discard(sets, asked)
    return out


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(id, s): the distinct shingle hashes of each row, sorted; several rows of one id stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            sets = [np.unique(shingle_hashes(t.as_py(), words)).view("<i8") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    return texts.select("id", "text").mapInArrow(run, "id long, s array<long>")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
