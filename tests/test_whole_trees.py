"""Queries over whole clause trees: one row per text, against the flat forms; what they shuffle, told from plans."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexmill.operators import body, chunks, tree

DATA = "/root/testdata/sf0.001"
FORMS = ["Phần I\nMột", "Chương II\nHai", "Mục 1. M", "Tiểu mục 2\nT", "Điều {}. A", "Điều {}\nB", "1. Một", "2. Hai\nthêm", "1. Lại", "a) x", "đ) y", "chữ", "Điều 3. Lại"]
ENDS = ["", "\nNơi nhận:\n- Lưu\nPhụ lục I\nMẫu số 1\nbảng", "\nPhụ lục II\n(Kèm theo)\nnội dung\nPhụ lục III\nC\nd"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(FORMS).format(rng.randrange(1, 9)) for _ in range(rng.randrange(60))) + rng.choice(ENDS) for _ in range(60)]
    return spark.createDataFrame([*enumerate(texts), (60, None), (61, ""), (62, "không có gì")], "document_id int, full_text string").repartition(5)


def rows(df):
    return sorted(map(str, df.collect()))


def test_pruned_texts(spark, docs):
    flat = body.with_paths(body.clause_nodes(docs))
    for kind, ordinal in (("khoan", "1"), ("dieu", None), (None, "2"), ("muc", None)):
        want = tree.full_texts(tree.pruned(flat, tree.node_filter(kind, ordinal), order="seq")).select("document_id", "path", "full_text")
        got = tree.matched_texts(body.clause_trees(docs), lambda x: tree.node_filter(kind, ordinal, x.getField))
        assert rows(got) == rows(want) and got.count()


def test_chunks_of_whole_trees(spark, docs):
    got, want = chunks.tree_chunks(body.clause_trees(docs)), chunks.chunks(body.with_paths(body.clause_nodes(docs)))
    assert rows(got.select(want.columns)) == rows(want) and got.count()


def test_search_documents_of_whole_trees(spark, docs):
    got, want = chunks.tree_search_documents(body.clause_trees(docs)), chunks.search_documents(body.with_paths(body.clause_nodes(docs)))
    assert rows(got.select(want.columns)) == rows(want) and got.count()


def test_spans():
    lines, stops = body._spans([None, 0, 1, 1, 0, None])
    assert lines == [[0], [0, 1], [0, 1, 2], [0, 1, 3], [0, 4], [5]] and stops == [4, 3, 2, 3, 4, 5]
    assert body._spans([]) == ([], [])


@pytest.mark.parametrize("name", ["node_filter", "clause_chunks", "search_documents"])
def test_nodes_are_not_shuffled(spark, name):
    """Orders and lines are shuffled to make the texts; nodes, several times as large, were shuffled once more."""
    p = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange hashpartitioning") == 2 and "Exchange hashpartitioning(document_id" not in p
