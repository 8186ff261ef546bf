"""Edit-aware token counts.

A document's pre-tokens are the leaves of a balanced segment tree whose nodes hold sums of characters and tokens. An
edit replaces a range of characters. A node whose children have grown uneven is built anew, so the tree stays of
logarithmic depth wherever edits fall. The special token is a leaf of its own. The pre-tokenizer reads from left to right and looks at most two characters ahead
of a match, so it is restarted two pre-tokens before the edit and stopped where a new cut falls on an old one after the
edit: from there on both agree. Only pre-tokens between are encoded again; the sums on the path to the root follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.tokens import DEFAULT, SPECIAL, encoder

LEAF, CONTEXT = 64, 2
#: share of a node's pre-tokens that one child may hold, beyond a few leaves; then the node is built anew
UNEVEN = 0.7


class Tree:
    """A node: sums of characters, tokens and pre-tokens, and either two children or its pre-tokens' sizes."""

    __slots__ = ("chars", "tokens", "n", "left", "right", "sizes", "counts")

    def __init__(self, sizes: list[int], counts: list[int]) -> None:
        self.n = len(sizes)
        if self.n <= LEAF:
            self.left = self.right = None
            self.sizes, self.counts = sizes, counts
            self.chars, self.tokens = sum(sizes), sum(counts)
        else:
            half = self.n // 2
            self.join(Tree(sizes[:half], counts[:half]), Tree(sizes[half:], counts[half:]))

    def join(self, left: Tree, right: Tree) -> None:
        self.left, self.right, self.sizes, self.counts = left, right, None, None
        self.chars, self.tokens, self.n = left.chars + right.chars, left.tokens + right.tokens, left.n + right.n

    def index(self, at: int) -> int:
        """Number of pre-tokens that end at or before that character."""
        if self.left is not None:
            return self.left.index(at) if at < self.left.chars else self.left.n + self.right.index(at - self.left.chars)
        n = 0
        for size in self.sizes:
            if size > at:
                break
            at -= size
            n += 1
        return n

    def start(self, i: int) -> int:
        """First character of pre-token i."""
        if self.left is not None:
            return self.left.start(i) if i < self.left.n else self.left.chars + self.right.start(i - self.left.n)
        return sum(self.sizes[:i])

    def size(self, i: int) -> int:
        if self.left is not None:
            return self.left.size(i) if i < self.left.n else self.right.size(i - self.left.n)
        return self.sizes[i]

    def splice(self, lo: int, hi: int, sizes: list[int], counts: list[int]) -> None:
        """Puts new pre-tokens in place of lo to hi, exclusive, and sums anew what lies on the path."""
        if self.left is None:
            self.__init__(self.sizes[:lo] + sizes + self.sizes[hi:], self.counts[:lo] + counts + self.counts[hi:])
            return
        cut = self.left.n
        if hi <= cut:
            self.left.splice(lo, hi, sizes, counts)
        elif lo >= cut:
            self.right.splice(lo - cut, hi - cut, sizes, counts)
        else:
            self.left.splice(lo, cut, sizes, counts)
            self.right.splice(0, hi - cut, [], [])
        self.join(self.left, self.right)
        if max(self.left.n, self.right.n) > UNEVEN * self.n + 2 * LEAF or self.n <= LEAF:
            sizes, counts = [], []
            for leaf in self.leaves():
                sizes += leaf.sizes
                counts += leaf.counts
            self.__init__(sizes, counts)

    def leaves(self) -> Iterator[Tree]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                yield node
            else:
                todo += [node.right, node.left]


class Counted:
    """A text with its tree. edit() keeps tokens equal to a full count of the new text."""

    def __init__(self, text: str, enc) -> None:
        import regex

        self.cut = regex.compile(enc.pattern)
        self.enc, self.text, self.encoded = enc, text, 0
        pieces = list(self.pieces(0))
        self.tree = Tree([b - a for a, b, _ in pieces], [n for *_, n in pieces])

    @property
    def tokens(self) -> int:
        return self.tree.tokens

    def pieces(self, at: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, ids) of the pre-tokens from a place on. The special token's string is cut out first, as the encoder does."""
        while at < len(self.text):
            found = self.text.find(SPECIAL, at)
            end = found if found >= 0 else len(self.text)
            for m in self.cut.finditer(self.text, at, end):
                yield m.start(), m.end(), self.enc.count(m.group())
            if found >= 0:
                yield found, found + len(SPECIAL), 1
            at = end + len(SPECIAL)

    def edit(self, start: int, end: int, put: str) -> None:
        """Replaces characters start to end, exclusive, both clamped to the text; counts what it encodes in ``encoded``."""
        start = min(max(0, start), len(self.text))
        end = min(max(start, end), len(self.text))
        tree, old = self.tree, self.text
        self.text = old[:start] + put + old[end:]
        first = max(0, tree.index(max(0, start - len(SPECIAL))) - CONTEXT)  # the edit may complete a special token
        at = tree.start(first)
        settled, moved = start + len(put), len(put) - (end - start)
        sizes, counts = [], []
        last, reach = tree.index(end), None
        for begin, stop, n in self.pieces(at):
            if begin >= settled:
                if reach is None:
                    reach = tree.start(last) if last < tree.n else tree.chars
                while reach < begin - moved and last < tree.n:
                    reach += tree.size(last)
                    last += 1
                if reach == begin - moved:
                    break
            sizes.append(stop - begin)
            counts.append(n)
        else:
            last = tree.n
        self.encoded += len(sizes)
        tree.splice(first, last, sizes, counts)


def edit_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", vocabulary: str = DEFAULT) -> DataFrame:
    """(id, n_pretokens, n_tokens, n_edits, n_chars_edited, n_pretokens_edited, n_tokens_edited, n_reencoded) per row.

    edits: array of (start, end, put), applied one after another, each to the text that the former left. Null texts and
    nulls in an edit count as empty and 0; a null array as no edits. Row order within a batch is kept; nothing is shuffled."""
    names = ["n_pretokens", "n_tokens", "n_edits", "n_chars_edited", "n_pretokens_edited", "n_tokens_edited", "n_reencoded"]
    schema = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            rows = []
            for text, edits in zip(batch.column(1), batch.column(2)):
                doc, todo = Counted(text.as_py() or "", enc), edits.as_py() or []
                row = [doc.tree.n, doc.tokens, len(todo)]
                for e in todo:
                    e = e or {}
                    doc.edit(e.get("start") or 0, e.get("end") or 0, e.get("put") or "")
                rows.append([*row, len(doc.text), doc.tree.n, doc.tokens, doc.encoded])
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["id", *names])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"), F.col(edits_col)).mapInArrow(run, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after three edits: a cut in its first quarter, an insertion at its middle, a replacement in its last quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = F.coalesce(F.char_length("text"), F.lit(0))
    at = lambda start, size, put: F.struct(start.cast("long").alias("start"), (start + size).cast("long").alias("end"), F.lit(put).alias("put"))
    edits = F.array(at(F.floor(n / 4), 16, ""), at(F.floor(n / 2), 0, " [edited] "), at(F.floor(n * 3 / 4), 8, "x's"))
    return edit_counts(docs.withColumn("edits", edits)).withColumnRenamed("id", "doc_id")
