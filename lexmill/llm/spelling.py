"""Spelling variants: words one edit apart, grouped under their most frequent form.

Near words are found by a trie self-join. Words that differ in one place share what stands before it and what stands
after it, so of two words whose shorter one has L letters, those that differ in the second half share their first
L // 2 letters, and the others their last L - L // 2. Words are dealt out by these parts. A part's words make a trie of
their remainders (reversed, where the part is the end), and each node hands its children the set of active nodes, those
at most one edit away, until terminal nodes meet. A part with very many words is cut in the same way once more, so no
task holds more words than its parameter says, or than there are remainders of three letters. Pairs that share both
parts are put out by the first alone.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.portions import portions
from lexmill.scratch import discard, written

MIN_LETTERS, MIN_COUNT, FACTOR = 5, 3, 2
#: one of so many (document, word) pairs loses a letter
EVERY = 97
#: words of a part that a task makes a trie of; longer lists are cut again
LEAF = 20_000
#: entries that a worker counts before it hands them on
HELD = 200_000

#: Latin-1: letters stay, A-Z are lower-cased, everything else parts words
_LETTERS = bytes(b if b >= 0xC0 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def words_of(doc_id: int | None, text: str | None, every: int = EVERY) -> Iterator[tuple[bytes, int]]:
    """(word in Latin-1, occurrences) of a text; a pair of document and word whose crc32 ``every`` divides loses a letter. No id counts as an empty one."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter((text or "").encode("latin-1", "replace").translate(_LETTERS).split()).items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n) of all words with as many letters and occurrences at least."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in portions(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in words_of(doc_id, text.as_py(), every):
                    if len(word) >= min_letters:
                        counts[word] += n
            if len(counts) > HELD:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    found = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def trie_pairs(words: Iterable[str]) -> Iterator[tuple[int, int]]:
    """The numbers of every two different words at edit distance one, both ways."""
    kids: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, word in enumerate(words):
        node = 0
        for c in word:
            after = kids[node].get(c)
            if after is None:
                after = kids[node][c] = len(kids)
                kids.append({})
                ends.append(-1)
            node = after
        ends[node] = i
    todo = [(0, {0: 0} | dict.fromkeys(kids[0].values(), 1))]
    while todo:
        node, active = todo.pop()
        if ends[node] >= 0:
            yield from ((ends[node], ends[other]) for other, d in active.items() if d == 1 and ends[other] >= 0)
        for c, child in kids[node].items():
            mine: dict[int, int] = {}
            for other, d in active.items():
                if d == 0:
                    mine.setdefault(other, 1)  # c is left out
                    for x, after in kids[other].items():
                        if x == c:
                            mine[after] = 0
                            for more in kids[after].values():  # one letter is put in after c
                                mine.setdefault(more, 1)
                        else:
                            mine.setdefault(after, 1)  # c is replaced
                elif (after := kids[other].get(c)) is not None:
                    mine.setdefault(after, 1)
            todo.append((child, mine))


_KEY = ["size", "head", "tail", "below"]


def _parts(rows: DataFrame) -> DataFrame:
    """Each row twice: with half of its free letters added to the shared beginning, and with the others added to the
    shared end. In the second, pairs that share the longer beginning are left to the first (``below``)."""
    free = F.col("size") - F.col("front") - F.col("back")
    more = (free / 2).cast("int")
    first = rows.withColumn("front", F.col("front") + more)
    second = rows.withColumn("below", F.least("below", F.col("front") + more)).withColumn("back", F.col("back") + free - more)
    text = lambda df: df.withColumns({"head": F.left("word", F.col("front")), "tail": F.right("word", F.col("back"))})
    return text(first).unionByName(text(second))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, other_n, other): for each word of each part, how many near words it has there and the best of them.
    Rows (size, head, tail, below, word, n) come in order of the first four."""
    found: dict[str, tuple[int, int, str]] = {}

    def rows() -> pa.RecordBatch:
        best = list(found.values())
        columns = [pa.array(list(found), pa.string()), *(pa.array([b[i] for b in best], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string())))]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "other_n", "other"])

    def every() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    for (size, head, tail, below), part in groupby(every(), itemgetter(0, 1, 2, 3)):
        words, counts = zip(*(r[4:] for r in part))
        if len(words) < 2:
            continue
        middle = [w[len(head) : len(w) - len(tail)] for w in words]
        for i, j in trie_pairs(m[::-1] for m in middle) if tail else trie_pairs(middle):
            u, v = words[i], words[j]
            if min(len(u), len(v)) != size or u[:below] == v[:below]:
                continue
            n, best_n, best = found.get(u, (0, -1, ""))
            if counts[j] > best_n or (counts[j] == best_n and v < best):
                best_n, best = counts[j], v
            found[u] = n + 1, best_n, best
        if len(found) > HELD:
            yield rows()
            found = {}
    yield rows()


def near_words(words: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(word, n_near, other_n, other): the words of (word, n) that have near ones, with their number and that with the largest n, the first of equals."""
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("size")).filter("size > 0")
    rows = rows.withColumns({"front": F.lit(0), "back": F.lit(0), "below": F.lit(1 << 30)})
    rows, done = _parts(rows), None
    if words.count() > leaf:
        while True:
            rows = written(rows, "parts")
            long = rows.groupBy(*_KEY).agg(F.count("*").alias("words"), F.min(F.col("size") - F.col("front") - F.col("back")).alias("free"))
            long = written(long.filter((F.col("words") > leaf) & (F.col("free") > 1)).select(*_KEY), "long-parts")
            if long.isEmpty():
                break
            short = rows.join(long.hint("rebalance"), _KEY, "left_anti")
            done = short if done is None else done.unionByName(short)
            rows = _parts(rows.join(long.hint("rebalance"), _KEY, "left_semi").drop("head", "tail"))
    done = rows if done is None else done.unionByName(rows)
    dealt = done.select(*_KEY, "word", "n").repartition(*_KEY).sortWithinPartitions(*_KEY)
    found = dealt.mapInArrow(_near, "word string, n_near long, other_n long, other string")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), "other"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("other_n"), F.col("b.other").alias("other"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the last word of each chain of forms. Chains rise in frequency, so they end; each round doubles the steps taken."""
    cur = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = cur.select(F.col("word").alias("at"), F.col("root").alias("next")).hint("rebalance")
        after = cur.join(ahead, F.col("root") == F.col("at"), "left")
        after = written(after.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(cur)
        moved, cur = not after.filter("moved").isEmpty(), after
        if not moved:
            return cur.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = FACTOR, leaf: int = LEAF, every: int = EVERY) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word with its near words' number, its form (the most frequent near
    word, where it has ``factor`` times the word's occurrences at least) and the root of its chain of forms.

    Null texts have no words, null ids count as empty, repeated rows count as often as they come. A word is a run of
    Latin letters up to U+00FF; other characters part words. No documents: no rows."""
    words = written(vocabulary(docs, id_col, text_col, every=every), "vocabulary")
    joined = words.join(near_words(words, leaf), "word", "left")
    held = F.col("other_n") >= factor * F.col("n")
    rows = joined.select("word", F.when(held, F.col("other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(held, F.col("other_n")).alias("form_n"))
    rows = written(rows, "variants")
    return rows.join(roots(rows.filter("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
