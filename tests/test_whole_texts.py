"""Whole texts written out, beside the queries' texts that are made from tables."""

from lexmill.functions import citations
from lexmill.operators import body
from pyspark.sql import functions as F

FILLER = " ".join(["lời văn không nói gì thêm"] * 8)
LAW = """LUẬT
Căn cứ Hiến pháp;
Căn cứ Luật số 9/2019/QH14;
Chương I. NHỮNG QUY ĐỊNH CHUNG
Điều 1. Phạm vi
1. Theo Nghị định 78/2025/NĐ-CP.
a) Điểm một;
đ) Điểm hai.
2. Khoản hai
tiếp theo
Điều 2
Đối tượng
Chữ
Mục 1. Riêng
Điều 3a. Ba
Nơi nhận:
- Lưu
Phụ lục I
Mẫu số 01
bảng"""
DECREE = f"""NGHỊ ĐỊNH
Căn cứ Luật số 76/2015/QH13;
Chương I. A
Điều 1. Sửa đổi Nghị định 15/2020/NĐ-CP
{FILLER}
Điều 2. Bãi bỏ Thông tư 03/2009/TT-BKHĐT
{FILLER}
Điều 3. Theo 78/2025/NĐ-CP và 15/2020/NĐ-CP
KT. BỘ TRƯỞNG
QCVN 01:2026/BXD
nội dung quy chuẩn"""
TEXTS = [("law", LAW, "51/2024/QH15"), ("decree", DECREE, "1/2026/NĐ-CP"), ("bare", "không có cấu trúc", None), ("none", None, None)]



_TREE_ROWS = [
    ("law", 0, "chuong", "1", "Chương I", "NHỮNG QUY ĐỊNH CHUNG", None, None, "chuong1"),
    ("law", 1, "dieu", "1", "Điều 1", "Phạm vi", None, None, "chuong1.dieu1"),
    ("law", 2, "khoan", "1", "Khoản 1", None, "Theo Nghị định 78/2025/NĐ-CP.", None, "chuong1.dieu1.khoan1"),
    ("law", 3, "diem", "a", "Điểm a", None, "Điểm một;", None, "chuong1.dieu1.khoan1.diema"),
    ("law", 4, "diem", "đ", "Điểm đ", None, "Điểm hai.", None, "chuong1.dieu1.khoan1.diemdd"),
    ("law", 5, "khoan", "2", "Khoản 2", None, "Khoản hai\ntiếp theo", None, "chuong1.dieu1.khoan2"),
    ("law", 6, "dieu", "2", "Điều 2", "Đối tượng", "Chữ", None, "chuong1.dieu2"),
    ("law", 7, "muc", "1", "Mục 1", "Riêng", None, None, "chuong1.muc1"),
    ("law", 8, "dieu", "3a", "Điều 3a", "Ba", None, None, "chuong1.muc1.dieu3a"),
    ("law", 9, "phu_luc", "1", "Phụ lục I", "Mẫu số 01", "bảng", "template", "phu_luc1"),
    ("decree", 0, "chuong", "1", "Chương I", "A", None, None, "chuong1"),
    ("decree", 1, "dieu", "1", "Điều 1", "Sửa đổi Nghị định 15/2020/NĐ-CP", FILLER, None, "chuong1.dieu1"),
    ("decree", 2, "dieu", "2", "Điều 2", "Bãi bỏ Thông tư 03/2009/TT-BKHĐT", FILLER, None, "chuong1.dieu2"),
    ("decree", 3, "dieu", "3", "Điều 3", "Theo 78/2025/NĐ-CP và 15/2020/NĐ-CP", None, None, "chuong1.dieu3"),
    ("decree", 4, "phu_luc", "1", "Phụ lục 1", None, "QCVN 01:2026/BXD\nnội dung quy chuẩn", "normative", "phu_luc1"),
]




def _texts(spark):
    return spark.createDataFrame(TEXTS, "document_id string, full_text string, citation_id string")


def test_trees_of_whole_texts(spark):
    rows = body.with_paths(body.clause_nodes(_texts(spark))).select("document_id", "seq", "node_type", "ordinal", "label", "heading", "text_content", "content_class", "path")
    assert sorted(map(tuple, rows.collect())) == sorted(_TREE_ROWS)


def test_references_of_whole_texts(spark):
    rows = {(r["document_id"], r["reference_type"], r["citation"]) for r in body.text_references(_texts(spark)).collect()}
    assert rows == {
        ("law", "cites", "78/2025/NĐ-CP"), ("decree", "amends", "15/2020/NĐ-CP"), ("decree", "repeals", "03/2009/TT-BKHĐT"), ("decree", "cites", "78/2025/NĐ-CP"),
        ("law", "has_basis", "9/2019/QH14"), ("decree", "has_basis", "76/2015/QH13"),
    }


def test_forms_of_citations(spark):
    """Joint circulars with several issuers, codes with a term, and what the parity form knows of them."""
    text = "LUẬT\nChương I. A\n07/2010/TTLT-BTC-BTNMT, 12/2015/TTLT/BTC-BTP; 5/2014/UBTVQH13 và 216/1999/NQ-QHK4 hay 9/2020/QH14, 8/2021/NQ-HĐND (x-7/2019/QĐ-UBND) 3/2008/TTg, 4/2008/ABC"
    docs = spark.createDataFrame([(1, text, None)], "document_id int, full_text string, citation_id string")
    found = lambda legacy: [r["citation"] for r in body.text_references(docs, legacy=legacy).collect()]
    assert found(False) == ["07/2010/TTLT-BTC-BTNMT", "12/2015/TTLT/BTC-BTP", "5/2014/UBTVQH13", "216/1999/NQ-QHK4", "9/2020/QH14", "8/2021/NQ-HĐND", "7/2019/QĐ-UBND"]
    assert found(True) == ["216/1999/NQ-QHK4", "9/2020/QH14", "7/2019/QĐ-UBND"]
    assert spark.range(1).select(citations.citation_in_text(F.lit("theo 07/2010/TTLT-BTC-BTNMT"))).first()[0] == "07/2010/TTLT-BTC-BTNMT"


def windows_by_hand(text, own):
    """Every place found by the pattern, the words around it cut out of the whole text."""
    import regex

    b, seen, out = text.split("Chương I.", 1)[1], set(), []
    for m in regex.finditer(citations.BODY_CITATION, b):
        if m[0] not in seen and m[0] != own:
            out.append((m[0], (b[max(0, m.start() - 80) : m.start()] + m[0] + b[m.end() : m.end() + 80]).lower().strip()))
        seen.add(m[0])
    return out


def test_windows_over_dense_and_sparse_citations(spark):
    import random

    rng = random.Random(2)
    docs = []
    for i in range(40):
        gap = rng.choice([0, 1, 5, 60, 300])
        parts = [f"{rng.randrange(1, 30)}/20{rng.randrange(10, 13)}/{rng.choice(['QH13', 'NĐ-CP', 'TTLT-BTC-BTP'])} " + "".join(rng.choice("aăđ ,") for _ in range(rng.randrange(gap + 1))) for _ in range(rng.randrange(60))]
        docs.append((i, "LUẬT\nChương I. " + " ".join(parts), "5/2010/QH13"))
    rows = body.text_references(spark.createDataFrame(docs, "document_id int, full_text string, citation_id string")).collect()
    got = {i: [(r["citation"], r["raw_citation_text"]) for r in rows if r["document_id"] == i] for i, *_ in docs}
    assert got == {i: windows_by_hand(text, own) for i, text, own in docs}


def test_references_grow_with_the_text(spark):
    """The expression cuts a body once: 20,000 citations in one text are no trouble."""
    text = "LUẬT\nChương I. A\n" + " ".join(f"sửa đổi {i % 900 + 1}/{2000 + i // 900}/NĐ-CP và các văn bản" for i in range(20_000))
    docs = spark.createDataFrame([(1, text, None)], "document_id int, full_text string, citation_id string")
    assert body.text_references(docs).filter("reference_type = 'amends'").count() == 20_000
