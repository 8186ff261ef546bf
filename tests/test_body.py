from pyspark.sql import functions as F

from lexmill.operators import body, chunks, tree


def shape(text, legacy=False):
    return [(n["node_type"], n["ordinal"], n["heading"], n["text_content"], n["parent_seq"]) for n in body.parse_body(text, legacy)]


def test_nesting():
    t = "Điều 1. Phạm vi\n1. Một\na) A\nb) B\n2. Hai\nĐiều 2. Khác\nchữ"
    assert shape(t) == [("dieu", "1", "Phạm vi", None, None), ("khoan", "1", None, "Một", 0), ("diem", "a", None, "A", 1), ("diem", "b", None, "B", 1), ("khoan", "2", None, "Hai", 0), ("dieu", "2", "Khác", "chữ", None)]


def test_headings():
    assert shape("Chương II\nQUY ĐỊNH CHUNG\nMục 1. M\nTiểu mục 2\nĐiều 3\nTên") == [("chuong", "2", "QUY ĐỊNH CHUNG", None, None), ("muc", "1", "M", None, 0), ("tieu_muc", "2", None, None, 1), ("dieu", "3", "Tên", None, 2)]
    assert [x[:3] for x in shape("Điều 1\nĐiều 2: Hai\nĐiều 3 Ba\nĐiều 5a. X")] == [("dieu", "1", None), ("dieu", "2", "Hai"), ("dieu", "3", "Ba"), ("dieu", "5a", "X")]
    assert shape("Điều 5\n1. Khoản") == [("dieu", "5", None, None, None), ("khoan", "1", None, "Khoản", 0)]
    assert shape("Điều 5\n1. Khoản", legacy=True) == [("dieu", "5", "1. Khoản", None, None)]
    assert shape("Phần còn lại\n") == []
    assert shape("Phần còn lại", legacy=True) == []or shape("Phần còn lại", legacy=True)[0][0] == "phan"


def test_annex_and_footer():
    t = "lời đầu\nĐiều 1. A\nchữ\nNơi nhận:\n- Lưu\nPhụ lục I\n(Kèm theo)\nnội dung\nPhụ lục II\nMẫu số 01\nbảng"
    got = body.parse_body(t)
    assert [(n["node_type"], n["ordinal"], n["heading"], n["text_content"], n["content_class"]) for n in got] == [
        ("dieu", "1", "A", "chữ", None), ("phu_luc", "1", None, "(Kèm theo)\nnội dung", "normative"), ("phu_luc", "2", "Mẫu số 01", "bảng", "template")]
    assert [n["node_type"] for n in body.parse_body("Điều 1. A\nTM. CHÍNH PHỦ\nQCVN 01:2026/BXD\nx\nQCVN 01 do Viện")] == ["dieu", "phu_luc"]
    assert body.parse_body("Điều 1. A\nKT. X\nQCVN 01:2026 do Viện lập") == body.parse_body("Điều 1. A")
    assert body.parse_body("Điều 1. A\nTM. X\nCỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\ny")[1]["text_content"].endswith("\ny")
    assert body.parse_body(None) == [] and body.parse_body("") == []


def test_references(spark):
    t = "Luật\nChương I. A\nTheo Nghị định 78/2025/NĐ-CP và 03/2009/TT-BKHĐT; sửa đổi 104/2016/QH13. Lại 78/2025/NĐ-CP, 1104/2016/QH13."
    docs = spark.createDataFrame([(1, t, None), (2, t, "104/2016/QH13"), (3, "78/2025/NĐ-CP", None), (4, None, None)], "document_id int, full_text string, citation_id string")
    found = lambda legacy=False: [(r["document_id"], r["citation"]) for r in body.text_references(docs, legacy=legacy).collect() if r["reference_type"] != "has_basis"]
    three = ["78/2025/NĐ-CP", "03/2009/TT-BKHĐT", "104/2016/QH13"]
    assert found() == [(1, c) for c in three] + [(2, c) for c in three[:2]]
    assert found(legacy=True) == [(1, "03/2009/TT-BKH"), (1, "104/2016/QH13"), (2, "03/2009/TT-BKH")]
    near = {r["citation"]: r for r in body.text_references(docs.filter("document_id = 1")).collect()}
    assert near["104/2016/QH13"]["raw_citation_text"] == t.split("Chương I.")[1].lower().strip()[-106:] or "sửa đổi 104/2016/qh13. lại" in near["104/2016/QH13"]["raw_citation_text"]
    assert near["104/2016/QH13"]["reference_type"] == "amends"
    body.register(spark)
    docs.createOrReplaceTempView("refs")
    assert [r["citation"] for r in spark.sql("select r.citation from refs, lateral extract_body_references(full_text, citation_id) r where document_id = 2").collect()] == three[:2]


def test_more_line_forms():
    assert [x[1] for x in shape("Chương XIV\nA\nChương 3\nB\nChương IX. C")] == ["14", "3", "9"]
    assert shape("Điều 1. A\n1. x\na) y\n2. z\nb) w")[-1] == ("diem", "b", None, "w", 3)
    assert shape("1. lạc\na) lạc\nĐiều 1. A\na) chưa có khoản") == [("dieu", "1", "A", "a) chưa có khoản", None)]
    assert shape("Phần I\nMột\nĐiều 1. A\nChương II\nHai\nĐiều 2. B") == [("phan", "1", "Một", None, None), ("dieu", "1", "A", None, 0), ("chuong", "2", "Hai", None, 0), ("dieu", "2", "B", None, 2)]
    assert shape("Điều 1. A\nPhụ lục\nPhụ lục II. B\nx\nĐiều 9. y\nNơi nhận:") == [("dieu", "1", "A", None, None), ("phu_luc", "1", None, None, None), ("phu_luc", "2", "B", "x\nĐiều 9. y\nNơi nhận:", None)]
    assert [n["label"] for n in body.parse_body("CHƯƠNG I\nA\nĐIỀU 1. B\nPHỤ LỤC III\nx")] == ["CHƯƠNG I", "Điều 1", "PHỤ LỤC III"]
    assert shape("Điều 1. A\nThay mặt nhân dân\nx") == [("dieu", "1", "A", None, None)]
    assert shape("Điều 1\nNơi nhận:\nx") == [("dieu", "1", None, None, None)] and shape("Điều 1\nNơi nhận:\nx", legacy=True) == [("dieu", "1", "Nơi nhận:", "x", None)]


TEXT = "Chương I\nCHUNG\nĐiều 1. A\n1. Một\nd) D\nđ) Đ\n2. Hai\n10. Mười\nĐiều 2. B\nchữ\nĐiều 2. B lại\nPhụ lục\nMẫu số 1\nz"


def nodes(spark):
    docs = spark.createDataFrame([("x", TEXT), ("y", None), ("z", "Điều 1. Z")], "document_id string, full_text string")
    return body.with_paths(body.clause_nodes(docs))


def test_paths(spark):
    got = {r["seq"]: r for r in nodes(spark).filter("document_id = 'x'").collect()}
    assert [got[i]["path"] for i in range(10)] == ["chuong1", "chuong1.dieu1", "chuong1.dieu1.khoan1", "chuong1.dieu1.khoan1.diemd", "chuong1.dieu1.khoan1.diemdd", "chuong1.dieu1.khoan2", "chuong1.dieu1.khoan10", "chuong1.dieu2", "chuong1.dieu2_2", "phu_luc1"]
    assert got[3]["parent_id"] == got[2]["id"] and got[0]["parent_id"] is None
    assert len({r["id"] for r in got.values()}) == 10


def test_full_text_prune_and_order(spark):
    n = nodes(spark).filter("document_id = 'x'")
    one = tree.full_texts(n).filter("path = 'chuong1.dieu1'").first()["full_text"]
    assert one == "Điều 1 A\nKhoản 1\nMột\nĐiểm d\nD\nĐiểm đ\nĐ\nKhoản 2\nHai\nKhoản 10\nMười"
    by_path = tree.full_texts(n, order="path").filter("path = 'chuong1.dieu1'").first()["full_text"]
    assert by_path.index("Mười") < by_path.index("Hai")
    tops = [r["path"] for r in tree.matched_tops(n, F.col("node_type").isin("khoan", "diem")).orderBy("seq").collect()]
    assert tops == ["chuong1.dieu1.khoan1", "chuong1.dieu1.khoan2", "chuong1.dieu1.khoan10"]
    assert tree.pruned(n, F.col("node_type") == "khoan").count() == 5
    assert tree.retrieve_nodes(nodes(spark), "x", node_type="dieu", ordinal="1").count() == 6
    own = n.filter("path = 'chuong1.dieu2'").first()["id"]
    assert [r["text_content"] for r in tree.retrieve_nodes(nodes(spark), "x", node_id=own).collect()] == ["chữ"]
    import pytest

    with pytest.raises(LookupError):
        tree.retrieve_nodes(nodes(spark), "z", node_id=own)


def test_chunks(spark):
    got = {r["path"]: r["text"] for r in chunks.chunks(nodes(spark)).filter("document_id = 'x'").collect()}
    assert set(got) == {"chuong1.dieu1.khoan1", "chuong1.dieu1.khoan2", "chuong1.dieu1.khoan10", "chuong1.dieu2", "chuong1.dieu2_2"}
    assert got["chuong1.dieu1.khoan1"] == "Chương I CHUNG\nĐiều 1 A\nKhoản 1\nMột\nĐiểm d\nD\nĐiểm đ\nĐ"
    docs = {r["id"]: r for r in chunks.search_documents(nodes(spark)).collect()}
    assert [k["ordinal"] for k in docs["x:chuong1.dieu1"]["khoan"]] == ["1", "2", "10"]
    edges = spark.createDataFrame([(None, "none")], "source_node_id string, target_node_id string")
    assert chunks.materialised(nodes(spark), edges).count() == 4


def test_table_functions(spark):
    body.register(spark)
    df = spark.createDataFrame([("x", "Điều 1. A\n1. B")], "k string, t string")
    df.createOrReplaceTempView("laws")
    rows = spark.sql("select k, n.node_type, n.ordinal from laws, lateral parse_document_body(t) n order by n.seq").collect()
    assert [tuple(r) for r in rows] == [("x", "dieu", "1"), ("x", "khoan", "1")]


def test_long_numbers_after_the_number_word(spark):
    """Numbers of more than three digits were found nowhere."""
    t = "Luật\nChương I. A\nTheo Luật số 1000/2020/QH15, SỐ  900001/2020/QH15, dân số 12/2020/QH14 và mã 2000/2020/QH15; số 1104/2016/QH13."
    docs = spark.createDataFrame([(1, t, "1104/2016/QH13")], "document_id int, full_text string, citation_id string")
    assert [r["citation"] for r in body.text_references(docs).collect()] == ["1000/2020/QH15", "900001/2020/QH15", "12/2020/QH14"]
