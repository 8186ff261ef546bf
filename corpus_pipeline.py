"""From raw documents to packed training sequences, in five stages.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, filters, packing, quality, simhash, toxicity
from lexmill.llm.labelled import labelled_sample
from lexmill.scratch import written

SCORE = "__score"


def _sample(spark: SparkSession, sf_dir: str, label: str, limit: int) -> tuple:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return labelled_sample(docs, labels, label, F.lit(True), limit)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; without labels of both classes all stay."""
    model = toxicity.train(*_sample(spark, sf_dir, "toxic", toxicity.SAMPLE))
    return toxicity.rate(docs, model, name=SCORE).filter(F.col(SCORE) < 0.5).drop(SCORE)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more; without labels of both classes all stay."""
    model = quality.train(*_sample(spark, sf_dir, "quality", quality.SAMPLE))
    return quality.rate(docs, model, name=SCORE).filter(F.col(SCORE) >= 0.5).drop(SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id. Rows are told apart by id and text, so
    neither null ids nor different texts of one id are mixed up; a row that repeats both stays once."""
    groups = simhash.near_duplicates(docs)
    return filters.once(filters.without(docs, groups.filter("not kept")), groups.filter("kept"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; each row is judged by its own text."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can express none of the classifiers; each stage is tested against its operator's brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
