"""Ranked retrieval: BM25, filtered vector search and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import fold_diacritics
from lexmill.scratch import written

K1, B, RRF_K = 1.2, 0.75, 60
FOLDED_BOOST = 0.5


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25(docs: DataFrame, terms: list[str], id_col: str = "id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of rows with a query term. One pass over the texts counts sizes and the query's terms and writes these
    numbers; the corpus statistics, one row, and the scores are taken from them."""
    terms = sorted({t.lower() for t in terms})
    words = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    tf = words.select("id", F.size("w").alias("dl"), *(_times("w", t).alias(f"t{i}") for i, t in enumerate(terms)))
    tf = written(tf, "terms")
    stats = tf.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    joined = tf.filter(" or ".join(f"t{i} > 0" for i in range(len(terms))) or "false").join(F.broadcast(stats))  # a single row

    def part(i: int) -> Column:
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        norm = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
        return idf * F.col(f"t{i}") * (k1 + 1) / (F.col(f"t{i}") + norm)

    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + part(i)
    return joined.select("id", score.alias("score"))


def bm25_folded(docs: DataFrame, terms: list[str], id_col: str = "id", text_col: str = "text", boost: float = FOLDED_BOOST) -> DataFrame:
    """BM25 on the exact words plus, at a lower weight, on words without marks."""
    exact = bm25(docs, terms, id_col, text_col)
    spark = docs.sparkSession
    plain = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(fold_diacritics(F.col("t"))).collect()]
    folded = bm25(docs.withColumn("__folded", fold_diacritics(F.col(text_col))), plain, id_col, "__folded").withColumn("score", F.col("score") * boost)
    return exact.unionByName(folded).groupBy("id").agg(F.sum("score").alias("score"))


def top(rows: DataFrame, k: int, score: str = "score", id_col: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(score), id_col).limit(k)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for zero vectors or other lengths."""
    d = lambda x: x.cast("double")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: d(p) * d(q)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def vector_top(vectors: DataFrame, query: list[float], k: int, keep: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows by cosine among those that pass the filter, which the scan takes first; exact."""
    rows = vectors if keep is None else vectors.filter(keep)
    q = F.array(*(F.lit(float(x)) for x in query))
    return top(rows.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("score")).filter("score is not null"), k)


def ranked(rows: DataFrame, name: str, score: str = "score") -> DataFrame:
    """Ranks from 1 of a bounded result list, by score and id."""
    return rows.select("id", F.row_number().over(Window.orderBy(F.desc(score), "id")).alias(name))


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of bounded top lists (id, score): the sum of 1 / (k + rank)."""
    parts = None
    for rows in lists:
        part = ranked(rows, "rank").select("id", (1.0 / (F.lit(k) + F.col("rank"))).alias("s"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("id").agg(F.sum("s").alias("score"))
