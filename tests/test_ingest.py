import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexmill import schemas
from lexmill.operators import edges, ingest, relations, upsert

NOW = dt.datetime(2026, 1, 2, 3, 4, 5)


def page(citation, text="", cards=(), scope="trung-uong", status="Còn hiệu lực", issued="1/2/2024", body="Quốc hội", title="T", url=None):
    labels = {"Số hiệu": citation, "Loại văn bản": "Luật", "Cơ quan ban hành": body, "Ngày ban hành": issued, "Ngày có hiệu lực": "--"} | ({"Tình trạng hiệu lực": status} if status else {})
    return (url or f"https://e.org/{citation}", scope, title, text, [(k, v) for k, v in labels.items() if v is not None], [(k, list(v)) for k, v in cards])


def frame(spark, *pages):
    return spark.createDataFrame(list(pages), schemas.RAW_PAGE)


LAW = "LUẬT\nCăn cứ Hiến pháp;\nCăn cứ Luật số 9/2019/QH14;\nChương I. A\nĐiều 1. Một\n1. Theo 78/2025/NĐ-CP\nĐiều 2. Hai"


def snapshot(t):
    pick = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    return (pick(t.issuing_body, "id", "name", "authority_rank"), pick(t.document, "id", "citation_id", "content_version", "status"), pick(t.document_node, "id", "document_id", "path", "parent_id"), pick(t.document_reference, "source_document_id", "target_document_id", "reference_type", "change_type", "raw_citation_text"))


@pytest.fixture(scope="module")
def synced(spark):
    pages = frame(spark, page("Luật số 51/2024/QH15", LAW, [("Văn bản được sửa đổi bổ sung (2)", ["Nghị định số 78/2025/NĐ-CP", "--"]), ("Văn bản hướng dẫn áp dụng", ["Thông tư số 1/2025/TT-BYT"])]), page("1/2020/ĐP", scope="dia-phuong"))
    return pages, *ingest.sync(ingest.Tables.empty(spark), pages, NOW)


def test_sync(spark, synced):
    pages, t, outcomes, errors = synced
    assert errors.count() == 0
    assert [tuple(r) for r in outcomes.collect()] == [("51/2024/QH15", "inserted")]
    d = t.document.first()
    assert (d["citation_id"], d["status"], d["enacted_date"], d["effective_date"]) == ("51/2024/QH15", "con_hieu_luc", dt.date(2024, 2, 1), None)
    assert t.issuing_body.first()["authority_rank"] == 2
    assert [r["path"] for r in t.document_node.orderBy("seq").collect()] == ["chuong1", "chuong1.dieu1", "chuong1.dieu1.khoan1", "chuong1.dieu2"]
    got = {(r["reference_type"], r["citation"], r["target_document_id"]) for r in t.document_reference.collect()}
    assert got == {("guides", "1/2025/TT-BYT", None), ("has_basis", "9/2019/QH14", None), ("cites", "78/2025/NĐ-CP", None)}  # an inbound edge from an unknown document is left out
    assert [tuple(r) for r in ingest.skipped(pages).collect()] == [("https://e.org/1/2020/ĐP", "scope is dia-phuong")]


def test_twice_changes_nothing_and_late_targets_are_bound(spark, synced):
    pages, t, _, _ = synced
    again, outcomes, _ = ingest.sync(t, pages, NOW)
    assert [r["outcome"] for r in outcomes.collect()] == ["unchanged"]
    assert snapshot(again) == snapshot(t)
    late = frame(spark, page("78/2025/NĐ-CP", "NGHỊ ĐỊNH\nĐiều 1. X", [("Văn bản sửa đổi bổ sung", ["Luật số 51/2024/QH15"])]))
    t2, out2, bad = ingest.sync(t, late, NOW)
    ids = {r["citation_id"]: r["id"] for r in t2.document.collect()}
    bound = {(r["source_document_id"], r["reference_type"]) for r in t2.document_reference.filter("target_document_id is not null").collect()}
    assert bound == {(ids["51/2024/QH15"], "cites"), (ids["78/2025/NĐ-CP"], "amends")}
    row = ingest.report(out2, ingest.skipped(late), bad, t.document_reference, t2.document_reference).first()
    assert (row["inserted"], row["healed"], row["skipped"], row["errors"]) == (1, 1, 0, 0)
    assert ingest.re_extract(t2, t2.document.select("id"), NOW).count() == 0


def test_update_only(spark, synced):
    _, t, *_ = synced
    pages = frame(spark, page("51/2024/QH15", LAW + "\nĐiều 3. Ba"), page("2/2024/QH15"))
    t2, outcomes, _ = ingest.sync(t, pages, NOW, insert=False)
    assert {tuple(r) for r in outcomes.collect()} == {("51/2024/QH15", "changed"), ("2/2024/QH15", "notFound")}
    assert t2.document.count() == 1 and t2.document_node.count() == 5


def test_bad_pages(spark):
    with pytest.raises(Exception, match="no citation among"):
        ingest.parsed_documents(frame(spark, page(None)), NOW).collect()
    with pytest.raises(Exception, match="no issue date"):
        ingest.parsed_documents(frame(spark, page("1/2", issued="--")), NOW).collect()
    with pytest.raises(Exception, match="unknown relation heading"):
        relations.parse_relations(frame(spark, page("1/2", cards=[("Lạ (1)", ["x"])])), "sourceUrl").collect()
    assert ingest.parsed_documents(frame(spark, page("1/2", status=None)), NOW).first()["status"] is None


def test_broken_pages_dont_stop_a_batch(spark):
    pages = frame(spark, page("1/2024/QH15", LAW), page(None, url="a"), page("2/2", issued="31/31/2024", url="b"), page("3/2", cards=[("Lạ (1)", ["x"])], url="c"), (None, "trung-uong", None, None, None, None))
    t, outcomes, errors = ingest.sync(ingest.Tables.empty(spark), pages, NOW)
    assert [r["outcome"] for r in outcomes.collect()] == ["inserted"] and t.document.count() == 1
    assert {r["sourceUrl"]: r["message"].partition(":")[0] for r in errors.collect()} == {"a": "no citation among", "b": "no issue date", "c": "unknown relation heading", None: "no citation among"}


def test_delete_by_filters(spark):
    from lexmill.operators.search import Filters

    docs = spark.createDataFrame([("a", "1", "Luật", "x"), ("b", "2", "Nghị định", "x")], "id string, citation_id string, document_type string, issuing_body_id string")
    bodies = spark.createDataFrame([("x", "X")], "id string, name string")
    nodes = spark.createDataFrame([("a",), ("b",)], "document_id string")
    e = spark.createDataFrame([("1", "a", "b", "cites", None, "r", None, 1), ("2", "b", None, "cites", None, "r", None, 1)], EDGE)
    d, n, left, counts = edges.delete_matching(docs, bodies, nodes, e, Filters(document_types=["Luật"]))
    assert ([r["id"] for r in d.collect()], n.count(), [r["id"] for r in left.collect()], tuple(counts.first())) == (["b"], 1, ["2"], (1, 1, 0))
    assert tuple(edges.delete_matching(docs, bodies, nodes, e, Filters(document_types=["Không"]))[3].first()) == (0, 0, 0)
    with pytest.raises(ValueError, match="no filters"):
        edges.delete_matching(docs, bodies, nodes, e, Filters())


def test_relations(spark):
    cards = [("Văn bản liên quan cùng nội dung (3)", ["x"]), ("Văn bản hợp nhất", ["Luật số 3/2020/QH14", " "]), ("Văn bản được hợp nhất (1)", ["--"]), ("Văn bản thay thế", ["Luật số 4/2020/QH14"]), ("Căn cứ ban hành", ["Hiến pháp"])]
    p = frame(spark, page("1/2", cards=cards))
    got = {(r["reference_type"], r["change_type"], r["this_is_source"], r["citation"]) for r in relations.parse_relations(p, "sourceUrl").collect()}
    assert got == {("amends", "replace", True, "4/2020/QH14"), ("has_basis", None, True, None)}
    c = relations.consolidation(p).first()
    assert c["consolidates_raw_titles"] == ["Luật số 3/2020/QH14"] and c["consolidated_into_raw_titles"] == []


EDGE = "id string, source_document_id string, target_document_id string, reference_type string, change_type string, raw_citation_text string, citation string, created_at int"


def test_null_safe_edges(spark):
    rows = [("1", "a", "b", "cites", None, "r1", None, 1), ("2", "a", "b", "cites", None, "r2", None, 2), ("3", "a", None, "cites", None, "r1", None, 3), ("4", "a", None, "cites", None, "r2", None, 4), ("5", "a", None, "cites", None, "r2", None, 5)]
    e = spark.createDataFrame(rows, EDGE)
    assert sorted(r["id"] for r in edges.dedup_edges(e).collect()) == ["1", "3", "4"]
    assert edges.insert_edges(e, e).count() == 0
    new = spark.createDataFrame([("9", None, "b", "cites", None, "r", None, 9), ("8", None, "b", "cites", None, "s", None, 8)], EDGE)
    assert [r["id"] for r in edges.insert_edges(e, new).collect()] == ["8"]


def test_heal_is_idempotent_and_dedups(spark):
    rows = [("1", "a", None, "cites", None, "theo số 1/2020/QH14", None, 1), ("2", "a", None, "cites", None, "tại số 1/2020/QH14", None, 2), ("3", "a", None, "cites", None, "số 7/2020/QH14", None, 3)]
    e = spark.createDataFrame(rows, EDGE)
    docs = spark.createDataFrame([("d", "1/2020/QH14", "t")], "id string, citation_id string, title string")
    once = edges.heal(e, docs)
    assert sorted((r["id"], r["target_document_id"], r["healed"]) for r in once.collect()) == [("1", "d", True), ("3", None, False)]
    assert sorted(r["id"] for r in edges.heal(once.drop("healed"), docs).filter("not healed").collect()) == ["1", "3"]
    assert edges.heal(e, docs, citations=["7/2020/QH14"]).filter("healed").count() == 0


def test_delete(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, citation_id string")
    nodes = spark.createDataFrame([("a",), ("a",), ("b",)], "document_id string")
    e = spark.createDataFrame([("1", "a", "b", "cites", None, "r", None, 1), ("2", "b", None, "cites", None, "r", None, 1)], EDGE)
    with pytest.raises(ValueError, match="allow_all"):
        edges.delete_documents(docs, nodes, e, None)
    d, n, left, report = edges.delete_documents(docs, nodes, e, spark.createDataFrame([("a",), ("x",)], "id string"))
    assert [r["id"] for r in d.collect()] == ["b"] and n.count() == 1 and [r["id"] for r in left.collect()] == ["2"]
    assert {tuple(r) for r in report.collect()} == {("a", "deleted", 2, 1), ("x", "notFound", 0, 0)}


def test_manifest_upsert_and_collisions(spark):
    m = spark.createDataFrame([("s", "f", "n", 1, "old"), ("s", "f", "m", 1, "x")], "subdir string, folder string, filename string, version int, v string")
    new = spark.createDataFrame([("s", "f", "n", 2, "new")], m.schema)
    assert sorted(r["v"] for r in upsert.upsert_manifest(m, new).collect()) == ["new", "x"]
    assert upsert.move_entry(m, "s", "f", "t").filter("subdir = 't'").count() == 2
    d = spark.createDataFrame([("Không số", "1"), ("Không số", "2"), ("1/2", "3")], "citation_id string, content_version string")
    assert [r["citation_id"] for r in upsert.collisions(d).collect()] == ["Không số"]


def test_stored_edges_are_told_apart_by_their_whole_keys(spark):
    rows = [(str(i), "a" if i % 3 else None, None if i % 2 else "t", "cites", None, f"r{i % 4}", None) for i in range(40)]
    e = spark.createDataFrame(rows, "id string, source_document_id string, target_document_id string, reference_type string, change_type string, raw_citation_text string, created_at date")
    ids = [sorted(r["id"] for r in edges.dedup_edges(e, stored=s).collect()) for s in (False, True)]
    assert ids[0] == ids[1] and len(ids[0]) == len({(s, t, None if t else raw) for _, s, t, _, _, raw, _ in rows})
