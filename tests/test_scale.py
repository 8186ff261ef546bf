"""What queries cost as their tables grow, told from plans, and the forms that this needs against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexmill.operators import body, chunks, edges, relations, titles, tree

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["tree_parents", "node_filter", "clause_chunks", "search_documents"])
def test_trees_are_parsed_and_shuffled_once(spark, name):
    """Two shuffles make the texts, one places the nodes; there were up to seven parses, and joins of nodes with nodes."""
    p = plan(entry.queries()[name](spark, DATA))
    assert p.count("MapInArrow") == 1 and p.count("Exchange hashpartitioning") <= 3 and "BroadcastExchange" not in p


def test_materialised_nodes_parse_once(spark):
    assert "MapInArrow" not in plan(entry.queries()["materialised_nodes"](spark, DATA))


def test_lines_are_tried_by_their_first_character():
    assert [kind for kind, _ in body._forms_at("x", False)] == ["diem"] and [kind for kind, _ in body._forms_at("Đ", False)] == ["dieu", "diem"]
    assert body._forms_at("-", False) == [] and [kind for kind, _ in body._forms_at("٣", False)] == ["khoan"]


def test_one_pass_over_trees(spark):
    """Random trees: parents, pruned subtrees and texts as ancestors tell them."""
    rng = random.Random(3)
    rows = []
    for d in range(6):
        paths = {""}
        while len(paths) < 25:
            up = rng.choice(sorted(paths))
            if up.count(".") < 6:
                paths.add(f"{up}.{rng.choice('abc')}" if up else rng.choice("abc"))
        gone = rng.sample(sorted(paths - {""}), 3)  # their children have no parent
        kept = sorted((p.split(".") for p in paths - {"", *gone}))
        rows += [(d, i, ".".join(p), f"{d}-{'.'.join(p)}", rng.random() < 0.3, f"L{i}", None, "t") for i, p in enumerate(kept)]
    n = spark.createDataFrame(rows, "document_id int, seq int, path string, id string, hit boolean, label string, heading string, text_content string").repartition(5)
    known = {r[3]: r for r in rows}
    above = lambda r: [known[k] for k in (f"{r[0]}-{'.'.join(r[2].split('.')[:i])}" for i in range(1, r[2].count(".") + 2)) if k in known]
    got = {r["id"]: (r["parent_id"], r["parent_label"]) for r in tree.parents(n, parent_label=F.col("label")).collect()}
    want = {r[3]: next(((u[3], u[5]) for u in above(r) if u[2] == r[2].rpartition(".")[0]), (None, None)) for r in rows}
    assert got == want
    assert sorted(r["id"] for r in tree.pruned(n, F.col("hit"), order="seq").collect()) == sorted(r["id"] for r in tree.pruned(n, F.col("hit")).collect()) == sorted(r[3] for r in rows if any(u[4] for u in above(r)))
    texts = {r["id"]: r["full_text"] for r in tree.full_texts(n).collect()}
    assert texts == {r[3]: "\n".join(f"{x[5]}\nt" for x in rows if r in above(x)) for r in rows}
    with pytest.raises(Exception, match="more than 2 labels"):
        n.select(tree.lineage(levels=2)).collect()


def test_ids_of_any_form_are_edges_ends(spark):
    n = spark.createDataFrame([("d", "p", "khoan", None, i) for i in ("ab", "AB", "", "x", "\x01")], "document_id string, path string, node_type string, content_class string, id string")
    ends = spark.createDataFrame([("ab", None), ("\x01", "«"), ("", "q")], "source_node_id string, target_node_id string")
    assert sorted(r["id"] for r in chunks.materialised(n, ends).collect()) == ["", "\x01", "ab"]


@pytest.mark.parametrize("name", ["page_attributes", "page_relations", "document_pages", "detail_pages"])
def test_pages_are_dealt_out(spark, name):
    """A table in one small file was one task's."""
    assert "Exchange hashpartitioning(" in (p := plan(entry.queries()[name](spark, DATA))) and "REPARTITION_BY_NUM" in p


def test_values_are_computed_once(spark):
    """A filter on them would be pushed below, with a copy of what computes them."""
    df = relations.once(spark.createDataFrame([(" a ",), (None,)], "x string"), "y", F.trim("x"))
    p = plan(df.filter("y = 'a'").select("y", F.length("y")))
    assert p.count("trim(") == 1 and [r["y"] for r in df.collect()] == ["a", None]


def test_equal_titles_are_scored_once(spark):
    """2,000 titles and 50 queries of two texts each; ids that repeat give their best score once."""
    t = spark.createDataFrame([(i, ["Luật đất đai", "LUẬT đất ĐAI", "Bộ luật hình sự"][i % 3]) for i in range(2000)] + [(0, "xyz")], "id long, title string")
    q = spark.createDataFrame([(i, ["luat dat dai", "bo luat hinh su x"][i % 2]) for i in range(50)] + [(1, "luat dat dai")], "query_id long, query string")
    assert titles.scored_texts(t.select(titles.folded(F.col("title")).alias("t")).distinct(), q.select(titles.folded(F.col("query")).alias("q")).distinct(), 0.4).filter("score = 0").count() == 1
    got = titles.title_matches(t, q).collect()
    assert len(got) == len({(r["query_id"], r["id"]) for r in got})
    zero = {(r["query_id"], r["id"]) for r in got if r["score"] == 0}
    assert zero == {(k, i) for k in range(50) if k % 2 == 0 or k == 1 for i in range(2000) if i % 3 < 2}


def test_basis_and_body_are_read_apart(spark):
    assert plan(entry.queries()["preamble_refs"](spark, DATA)).count("Scan parquet") == plan(entry.queries()["body_refs"](spark, DATA)).count("Scan parquet") == 1


@pytest.mark.parametrize("direction", ["incoming", "all", "outgoing"])
def test_edges_are_shuffled_by_either_end_alone(spark, direction):
    """Edges of all documents were joined with their ids first: a shuffle more, two and one of all rows for both directions."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert plan(entry.queries()[f"edge_{direction}"](spark, DATA)).count("Exchange hashpartitioning") == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_edges_of_the_documents_themselves(spark):
    """As with their ids apart, with ends that are unknown or null, an edge that comes twice and one from a document to itself."""
    kind = "id string, source_document_id string, target_document_id string, reference_type string"
    rows = [("1", "a", "b", "x"), ("2", "a", "z", "x"), ("3", "z", "b", "x"), ("4", "z", "y", "x"), ("5", None, "a", "x"), ("6", "a", None, "x"), ("7", "a", "a", "x"), ("1", "a", "b", "x"), ("8", None, None, "x"), ("9", "b", "a", "o")]
    e, d = spark.createDataFrame(rows, kind), spark.createDataFrame([(x, f"C{x}", f"T{x}") for x in "abc"], "id string, citation_id string, title string")
    for direction in (edges.OUTGOING, edges.INCOMING, edges.ALL):
        got, want = (edges.references(e, d, ids, direction, "x") for ids in (d, d.select("id")))
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and sorted(got.columns) == sorted(want.columns)


def test_stored_edges_stay_where_they_are(spark):
    """Joins with the hashes that come twice were planned before their number was known, and shuffled all edges twice."""
    p = plan(entry.queries()["dedup_edges_nullsafe"](spark, DATA))
    assert "Exchange hashpartitioning(__hash" not in p and p.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in p
