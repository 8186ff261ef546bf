"""Audit of how the sources of a language differ in the words they use.

Two passes. The first counts, exactly, in how many documents of its language each term stands; terms in enough of them
are kept. The second counts the kept terms' occurrences with an automaton: every term is a key between two delimiters,
and a text whose delimiters are all blanks is run through it once. What comes of a text are sparse postings (language,
source, term, count), from which shares, distances between all sources of a language and the terms above its average are
computed in whole numbers.

A distance sums over all kept terms, most of which neither source holds. With z for the share of a term that a source
lacks, |p - q| over all terms is the number of terms times |z - z'|, plus what each source's own terms change against
the other's z, plus a correction for the terms that both hold. The second summand follows from how often each share
occurs in a source, the third from the postings of each term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.portions import portions
from lexmill.scratch import discard, written

MIN_DOCUMENTS, SMOOTH, SCALE, RANKS = 30, 5, 1_000_000_000, 50
#: entries that a worker counts before it hands them on
HELD = 500_000
#: bytes of kept terms of all languages that may be broadcast; more are dealt out with the texts
VOCABULARY = 2 << 20
#: bytes of text that are counted with one automaton where terms are dealt out
BUNDLE = 16 << 20
#: pairs of postings that are compared at once
PAIRS = 1 << 20

_LETTERS = bytes(b if b >= 0x80 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def blanked(text: str | None) -> bytes:
    """UTF-8 of a text with A-Z lower-cased and every ASCII character that is no letter made a blank."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS)


def automaton(terms: Iterable[str]):
    """Finds each term between two blanks, and gives its number in the order of the terms; None without terms."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        out.add_word(f" {term} ", i)
    if not len(out):
        return None
    out.make_automaton()
    return out


def occurrences(found, text: str | None) -> Iterator[int]:
    """The numbers of all terms in a text, in order and as often as they stand there."""
    return map(itemgetter(1), found.iter(f" {blanked(text).decode('utf-8', 'surrogatepass')} "))


def _texts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(lang, term, n): the documents of each language that hold a term, all terms."""

    def rows(counts: dict[str, Counter]) -> pa.RecordBatch:
        langs = [lang for lang, c in counts.items() for _ in c]
        terms = [t for c in counts.values() for t in c]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.string()), pa.array([n for c in counts.values() for n in c.values()], pa.int64())], names=["lang", "term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in portions(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts.setdefault(lang, Counter()).update(set(blanked(text.as_py()).split()))
            if sum(map(len, counts.values())) > HELD:
                yield rows(counts)
                counts = {}
        yield rows(counts)

    found = texts.select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n"))


class _Postings:
    """Counts of terms by language and source, handed on as batches of bounded size."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str, str], Counter] = {}

    def add(self, lang: str, source: str, found, text: str | None) -> None:
        self.counts.setdefault((lang, source), Counter()).update(occurrences(found, text))

    def full(self) -> bool:
        return sum(map(len, self.counts.values())) > HELD

    def rows(self, terms: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        """A batch per language and source; terms: those of a language by their numbers."""
        for (lang, source), c in self.counts.items():
            numbers, n = (np.fromiter(x, dtype=np.int64, count=len(c)) for x in (c.keys(), c.values()))
            named = [pa.repeat(pa.scalar(x, pa.string()), len(c)) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*named, terms[lang].take(pa.array(numbers)), pa.array(n)], names=["lang", "source", "term", "n"])
        self.counts = {}


_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])
_POSTINGS = "lang string, source string, term string, n long"


def _counted_by_all(texts: DataFrame, kept: DataFrame) -> DataFrame:
    """Occurrences with one automaton for each language, whose terms every worker holds."""
    by_lang: dict[str, list[str]] = {}
    for lang, term in kept.select("lang", "term").collect():
        by_lang.setdefault(lang, []).append(term)
    shared = texts.sparkSession.sparkContext.broadcast(by_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, found, held = {lang: pa.array(own, pa.string()) for lang, own in shared.value.items()}, {}, _Postings()
        for batch in portions(batches, 2):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if lang not in found:
                    found[lang] = automaton(shared.value.get(lang, ()))
                if found[lang] is not None:
                    held.add(lang, source, found[lang], text.as_py())
            if held.full():
                yield from held.rows(terms)
        yield from held.rows(terms)

    return texts.mapInArrow(run, _POSTINGS)


def _counted_by_bundle(texts: DataFrame, kept: DataFrame, bundle: int) -> DataFrame:
    """Occurrences by bundles of texts, each of which meets those kept terms alone that stand in it: however many terms
    are kept, an automaton holds no more than its bundle's own words."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = texts.withColumn("bundle", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(total // bundle + 1)))
    dealt = written(dealt, "bundles")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2):
            found: dict[tuple[str, int], set[bytes]] = {}
            for lang, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found.setdefault((lang, b), set()).update(blanked(text.as_py()).split())
            out = [(lang, b, t) for (lang, b), terms in found.items() for t in terms]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))], names=["lang", "bundle", "term"])

    def count(own: pa.Table, there: pa.Table) -> pa.Table:
        terms, held = there.column("term").combine_chunks(), _Postings()
        if own.num_rows and (found := automaton(terms.to_pylist())) is not None:
            for lang, source, text in zip(own.column("lang").to_pylist(), own.column("source").to_pylist(), own.column("text")):
                held.add(lang, source, found, text.as_py())
        return pa.Table.from_batches(held.rows({lang: terms for lang, _ in held.counts}), _ARROW)

    of_bundle = dealt.select("lang", "bundle", "text").mapInArrow(words, "lang string, bundle long, term string").distinct()
    of_bundle = of_bundle.join(kept.select("lang", "term"), ["lang", "term"])
    return dealt.groupBy("lang", "bundle").cogroup(of_bundle.groupBy("lang", "bundle")).applyInArrow(count, _POSTINGS)


def postings(texts: DataFrame, kept: DataFrame, vocabulary: int = VOCABULARY, bundle: int = BUNDLE) -> DataFrame:
    """(lang, source, term, n): occurrences of the kept terms, where there are any."""
    size = kept.agg(F.sum(F.octet_length("term") + 2)).first()[0] or 0
    found = _counted_by_all(texts, kept) if size <= vocabulary else _counted_by_bundle(texts, kept, bundle)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)) in whole numbers of any size; null without terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    over, under = whole(count + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), F.nullif(whole(total + SMOOTH * terms), F.lit(0).cast("decimal(20,0)"))
    return F.lit(1).cast("long") + F.call_function("div", over, under)


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, d) from rows (lang, term, node, p, zero) in order of language, term and node: what the terms that two nodes share change."""

    def sums(nodes: np.ndarray, p: np.ndarray, zero: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, local = np.unique(nodes, return_inverse=True)
        for k in np.unique(sizes[sizes > 1]).tolist():
            at = starts[sizes == k]
            left, right = np.triu_indices(k, 1)
            step = max(1, PAIRS // len(left))
            for part in (at[i : i + step] for i in range(0, len(at), step)):
                x, y = (part[:, None] + left).ravel(), (part[:, None] + right).ravel()
                d = np.abs(p[x] - p[y]) - np.abs(p[x] - zero[y]) - np.abs(zero[x] - p[y]) + np.abs(zero[x] - zero[y])
                keys, at_key = np.unique(local[x] * len(names) + local[y], return_inverse=True)
                total = np.zeros(len(keys), dtype=np.int64)
                np.add.at(total, at_key, d)
                yield pa.RecordBatch.from_arrays([pa.array(names[keys // len(names)]), pa.array(names[keys % len(names)]), pa.array(total)], names=["a", "b", "d"])

    rest: pa.Table | None = None

    def done(table: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
        """The terms of a table that are complete; the last one's rows wait for the next batch."""
        nonlocal rest
        named = [table.column(c).combine_chunks() for c in ("lang", "term")]
        codes = [c.dictionary_encode() for c in named]
        key = np.stack([np.asarray(c.chunk(0).indices if isinstance(c, pa.ChunkedArray) else c.indices) for c in codes])
        first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        ends = np.append(first[1:], table.num_rows)
        if not whole:
            rest = table.slice(int(first[-1]))
            first, ends = first[:-1], ends[:-1]
        if len(first):
            yield from sums(*(table.column(c).combine_chunks().to_numpy(zero_copy_only=False)[: ends[-1]] for c in ("node", "p", "zero")), first, ends - first)

    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            yield from done(table if rest is None else pa.concat_tables([rest, table]), False)
    if rest is not None:
        yield from done(rest, True)


def distances(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(a, b, d): the distance of every two nodes of a language, a < b.

    groups: (node, lang, terms, zero), shares: (lang, term, node, p, zero) of the terms that a node holds. A row per node
    carries its language's nodes and its own different shares with their numbers, so nothing is paired by term but the
    nodes that share it."""
    z, none = F.coalesce("zero", F.lit(0).cast("long")), F.array().cast("array<struct<p:long,m:long>>")
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("node", z.alias("zero"))).alias("peers"))
    own = shares.groupBy("node", "p").agg(F.count("*").alias("m")).groupBy("node").agg(F.collect_list(F.struct("p", "m")).alias("own"))
    rows = groups.join(own, "node", "left").join(peers, "lang").withColumn("own", F.coalesce("own", none)).withColumn("z", z)

    def against(y: Column) -> Column:
        base = F.abs(F.col("z") - y["zero"])
        own_terms = F.aggregate("own", F.lit(0).cast("long"), lambda s, h: s + h["m"] * (F.abs(h["p"] - y["zero"]) - base))
        return F.struct(F.least("node", y["node"]).alias("a"), F.greatest("node", y["node"]).alias("b"), (own_terms + F.when(F.col("node") < y["node"], F.col("terms") * base).otherwise(0)).alias("d"))

    one = rows.select(F.explode(F.transform(F.filter("peers", lambda y: y["node"] != F.col("node")), against)).alias("r")).select("r.*")
    dealt = shares.select("lang", "term", "node", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term", "node")
    return one.unionByName(dealt.mapInArrow(_both, "a long, b long, d long")).groupBy("a", "b").agg(F.sum("d").alias("d"))


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, ranks: int = RANKS, vocabulary: int = VOCABULARY, bundle: int = BUNDLE) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` holds each source's distance from every other one of its
    language, part ``term`` its ``ranks`` terms that stand furthest above the language's share.

    Null texts, languages and sources are empty strings. Every row is a document, repeated ones too. A source without
    kept terms has the smoothed share for all of them; in a language without kept terms all distances are 0 and there is
    no term. Ties go by item. No documents: no rows."""
    texts = _texts(docs, lang_col, source_col, text_col)
    kept = written(document_frequencies(texts).filter(F.col("n") >= min_documents), "kept")
    counts = written(postings(texts, kept, vocabulary, bundle), "postings")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = totals.groupBy("lang").agg(F.sum("total").alias("every"))
    groups = texts.select("lang", "source").distinct().join(sizes, "lang", "left").join(every, "lang", "left").join(totals, ["lang", "source"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    groups = groups.select(F.monotonically_increasing_id().alias("node"), "lang", "source", zero("terms").alias("terms"), zero("total").alias("total"), zero("every").alias("every"))
    groups = written(groups.withColumn("zero", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))), "groups")
    shares = counts.join(groups.hint("rebalance"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    shares = written(shares.select("lang", "source", "term", "node", "terms", "every", "n", "p", "zero"), "shares")
    discard(counts)
    far = written(distances(groups, shares), "distances")
    both = far.select(F.col("a").alias("node"), F.col("b").alias("other"), "d").unionByName(far.select(F.col("b").alias("node"), F.col("a").alias("other"), "d"))
    names = groups.select(F.col("node").alias("other"), F.col("source").alias("item"))
    pairs = both.join(groups.select("node", "lang", "source"), "node").join(names, "other").select("lang", "source", F.lit("pair").alias("part"), "item", F.col("d").alias("value"))
    whole = shares.groupBy("lang", "term").agg(F.sum("n").alias("all"))
    above = shares.join(whole, ["lang", "term"]).withColumn("value", F.col("p") - share(F.col("all"), F.col("every"), F.col("terms")))
    terms = above.filter("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    placed = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return placed(pairs).unionByName(placed(terms).filter(F.col("rank") <= ranks))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """DuckDB SQL for the same rows, every group with every kept term."""
    cut = "regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    low = "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    p = lambda n, total: f"(1 + ({SCALE}::hugeint * ({n} + {SMOOTH})) // ({total} + {SMOOTH} * v))::bigint"
    return f"""with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, {cut} as w from documents),
o as (select i, lang, source, {low} as term from (select i, lang, source, unnest(w) as t from d)),
kept as (select lang, term from o group by all having count(distinct i) >= {MIN_DOCUMENTS}), size as (select lang, count(*) as v from kept group by 1),
grp as (select distinct lang, source from d), here as (select lang, source, term, count(*) as n from o join kept using (lang, term) group by all),
dense as (select g.lang, g.source, k.term, coalesce(h.n, 0) as n from grp g join kept k using (lang) left join here h on h.lang = g.lang and h.source = g.source and h.term = k.term),
total as (select lang, source, sum(n) as total from dense group by all), lt as (select lang, term, sum(n) as n from dense group by all), ll as (select lang, sum(n) as total from dense group by all),
p as (select lang, source, term, n, {p("n", "total")} as p from dense join total using (lang, source) join size using (lang)),
q as (select lang, term, {p("lt.n", "total")} as q from lt join ll using (lang) join size using (lang)),
dist as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from grp a join grp b on a.lang = b.lang and a.source <> b.source left join dist on dist.lang = a.lang and dist.source = a.source and dist.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from p join q using (lang, term) where n > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::int as rank from (select * from pairs union all select * from terms)
qualify part = 'pair' or rank <= {RANKS}"""
