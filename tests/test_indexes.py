import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.operators import inverted_file, postings, retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    texts = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(200)], k=rng.randrange(60)))) for i in range(600)]
    return spark.createDataFrame([*texts, (600, None), (601, ""), (602, texts[3][1]), (603, "W3, w7! É é")], "id long, text string").repartition(3).cache()


def test_many_queries_equal_one_by_one(spark, corpus, tmp_path):
    """Blocks of 16 documents, so bounds do leave blocks out; every query's result is that of the whole scan."""
    index = postings.build(corpus, f"file://{tmp_path}/index", block=16, buckets=8)
    asked = [(0, "w0"), (1, "w3 W7 w3"), (2, "é w199"), (3, "w0 w1 w2 w150"), (4, "nowhere"), (5, None), (6, "w5 nowhere w80")]
    rows = postings.search(index, spark.createDataFrame(asked, "query_id long, text string"), 7, first=2).collect()
    for q, text in asked:
        terms = [t.lower() for t in (text or "").split()]
        want = retrieval.bm25(corpus, terms).select("id", F.round("score", 9).alias("s")).orderBy(F.desc("s"), "id").limit(7).collect() if q in (1, 3) else None
        got = [(r["rank"], r["id"], r["score"]) for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])]
        if want is not None:
            assert got == [(n, r["id"], pytest.approx(r["s"], abs=2e-9)) for n, r in enumerate(want, 1)]
        assert bool(got) == (q not in (4, 5)) and [g[0] for g in got] == list(range(1, len(got) + 1))


def test_a_thousand_queries_in_one_job(spark, corpus, tmp_path):
    """By brute force in Python, with ties by id."""
    index = postings.build(corpus, f"file://{tmp_path}/index", block=32)
    docs = {r["id"]: (r["text"] or "").lower().replace(",", "").replace("!", "").split() for r in corpus.collect()}
    rng = random.Random(2)
    asked = [(q, " ".join(rng.sample([f"w{i}" for i in range(200)], 3))) for q in range(1000)]
    got = {}
    for r in postings.search(index, spark.createDataFrame(asked, "query_id long, text string"), 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"], r["score"]
    n, size = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {f"w{i}": sum(f"w{i}" in d for d in docs.values()) for i in range(200)}
    for q, text in asked:
        score = {}
        for i, words in docs.items():
            s = sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (tf := words.count(t)) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / size)) for t in text.split() if t in words)
            if s:
                score[i] = round(float(s), 8)
        want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [round(s, 8) for _, (_, s) in sorted(got.get(q, {}).items())] == [pytest.approx(s, abs=2e-8) for _, s in want]
        assert {i for i, s in want if s > want[-1][1]} <= {i for i, _ in got.get(q, {}).values()}


def test_search_reads_bounds_first(spark, corpus, tmp_path):
    index = postings.build(corpus, f"file://{tmp_path}/index", block=16)
    sizes = index.postings.select("term", "block", "top", F.expr("aggregate(postings, 0D, (s, p) -> greatest(s, p.w))").alias("m")).filter("top <> m").count()
    assert sizes == 0 and index.postings.groupBy("term", "block").count().filter("count > 1").isEmpty()
    empty = postings.build(corpus.filter("id < 0"), f"file://{tmp_path}/empty")
    assert postings.search(empty, spark.createDataFrame([(1, "w0")], "query_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((40, 16)) * 2
    x = middles[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 16)) * 0.6
    rows = [(i, [float(v) for v in x[i]], i % 5) for i in range(3000)] + [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [], 1), (5004, [float(v) for v in x[7]], 2), (5005, [1.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4).cache()


def test_lists_find_neighbours(spark, cloud, tmp_path):
    index = inverted_file.build(cloud, f"file://{tmp_path}/index", lists=40)
    assert index.vectors.count() == 3001
    asked = cloud.filter("vec_id % 60 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    asked = asked.unionByName(spark.createDataFrame([(-1, [0.0] * 16), (-2, None), (-3, [1.0])], "query_id long, vector array<double>"))
    keep = F.col("label").isin(1, 2)
    pairs = asked.crossJoin(cloud.filter(keep).filter("size(embedding) = 16")).select("query_id", F.col("vec_id").alias("id"), retrieval.cosine(F.col("embedding"), F.col("vector")).alias("score")).filter("score is not null and not isnan(score)")
    truth = inverted_file.F.row_number().over(inverted_file.Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    truth = pairs.withColumn("rank", truth).filter("rank <= 10").select("query_id", "rank", "id", "score").cache()
    exact = inverted_file.search(index, asked, 10, probes=2, exact=True, keep=keep)
    shape = lambda rows: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in rows.collect())
    assert shape(exact) == shape(truth)
    assert inverted_file.recall(inverted_file.search(index, asked, 10, probes=4, keep=keep), truth).first()[0] >= 0.95


def test_one_query_opens_its_lists_alone(spark, cloud, tmp_path):
    index = inverted_file.build(cloud, f"file://{tmp_path}/index", lists=40)
    query = cloud.filter("vec_id = 7").first()["embedding"]
    rows = inverted_file.search_one(index, query, 3, probes=3, keep=F.col("label") == 2)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and "label" in plan.split("PushedFilters")[1][:120]
    assert [r["id"] for r in rows.collect()][:2] == [7, 5004]
    with pytest.raises(ValueError, match="no vector"):
        inverted_file.build(cloud.filter("vec_id in (5000, 5001)"), f"file://{tmp_path}/none")


def test_lists_are_compared_in_blocks(spark, cloud, tmp_path, monkeypatch):
    """Pairs were rows, each scored by itself. Many copies of one vector, blocks of 100 rows: ties by id, as a scan gives."""
    monkeypatch.setattr(inverted_file, "BLOCK", 100)
    copies = spark.range(10_000, 10_500).select(F.col("id").alias("vec_id")).crossJoin(cloud.filter("vec_id = 7").select("embedding", "label"))
    both = cloud.filter("vec_id < 3000").unionByName(copies)
    index = inverted_file.build(both, f"file://{tmp_path}/index", lists=8)
    asked = both.filter("vec_id % 100 = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = inverted_file.search(index, asked, 10, probes=2, exact=True)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    pairs = asked.crossJoin(both).select("query_id", F.col("vec_id").alias("id"), retrieval.cosine(F.col("embedding"), F.col("vector")).alias("score"))
    rank = F.row_number().over(inverted_file.Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    want = {tuple(r) for r in pairs.withColumn("rank", rank).filter("rank <= 10").select("query_id", "rank", "id", "score").collect()}
    assert {tuple(r) for r in got.collect()} == want and {r[2] for r in want if r[0] == 7} == {7, *range(10_000, 10_009)}


def test_blocks_are_scored_at_once(spark, tmp_path, monkeypatch):
    """Each pair of a query and a document was a row. Many equal texts, queries in portions of three, an index of asked words alone: ties by id, as a scan gives."""
    monkeypatch.setattr(postings, "QUERIES", 3)
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(60)]
    docs = {i: texts[i * 7 % 60] for i in range(300)} | {-4: "", -3: "z z z"}
    corpus = spark.createDataFrame([*docs.items(), (-5, None)], "id long, text string").repartition(3)
    asked = {q: " ".join(rng.sample("abcdefghy", 4)) for q in range(10)} | {10: "Y", 11: "a A a"}
    queries = spark.createDataFrame([*asked.items(), (12, None)], "query_id long, text string")
    small, whole = (postings.build(corpus, f"file://{tmp_path}/{only is None}", block=16, only=only) for only in (queries, None))
    assert {r[0] for r in small.postings.select("term").distinct().collect()} == set("abcdefgh") and small.terms.count() == 8 and whole.terms.count() == 9
    n, size = len(docs) + 1, sum(len(t.split()) for t in docs.values()) / (len(docs) + 1)
    df = {t: sum(t in d.split() for d in docs.values()) for t in "abcdefgh"}
    want = []
    for q, text in asked.items():
        score = {}
        for i, d in docs.items():
            d = d.split()
            found = [np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / size)) for t in sorted(set(text.lower().split())) if t in d]
            if found:
                score[i] = round(float(sum(found)), 9)
        want += [(q, rank, i, pytest.approx(s, abs=2e-9)) for rank, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:7], 1)]
    for index in (small, whole):
        rows = postings.search(index, queries, 7, first=2)
        assert "FlatMapGroupsInArrow" in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in rows.collect()) == want


def test_blocks_are_whole_across_batches(monkeypatch):
    """Batches end within blocks, portions hold seven words at most or one block."""
    monkeypatch.setattr(postings, "WORDS", 7)
    rng = random.Random(6)
    rows = [(n, n * 3 if n % 11 else None, rng.choices("abcé", k=rng.randrange(5))) for n in [*range(40), *range(1 << 33, (1 << 33) + 9)]]
    columns = lambda some: [pa.array(c, kind) for c, kind in zip(zip(*some), (pa.int64(), pa.int64(), pa.list_(pa.string())))]
    batches = [pa.RecordBatch.from_arrays(columns(rows[i : i + 5]), names=["number", "id", "words"]) for i in range(0, len(rows), 5)]
    got = {(r["term"], r["block"]): r for b in postings._inverted(iter(batches), 8, 2.0, 1.2, 0.75) for r in b.to_pylist()}
    want = {}
    for n, i, words in rows:
        for t in sorted(set(words)):
            want.setdefault((t, n // 8), []).append((i, words.count(t) * 2.2 / (words.count(t) + 1.2 * (0.25 + 0.75 * len(words) / 2))))
    assert {k: list(zip(r["ids"], r["weights"])) for k, r in got.items()} == {k: [(i, pytest.approx(w)) for i, w in v] for k, v in want.items()}
    assert all(r["top"] == max(r["weights"]) for r in got.values()) and sum(b.num_rows for b in postings._inverted(iter(batches), 8, 2.0, 1.2, 0.75)) == len(want)
    assert [b.num_rows for b in postings._inverted(iter([]), 8, 2.0, 1.2, 0.75)] == []
