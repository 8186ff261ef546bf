import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexmill.functions import authority, citations, dates, files, hashing, text
from lexmill.functions import sql as sql_functions


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_citation_from_title(spark):
    rows = ["Nghị định số 78/2025/NĐ-CP của Chính phủ", "Luật sửa đổi một số điều của Luật số 51/2024/QH15", "không có", "Quyết định SỐ 12/qđ-ttg", "số  5", None]
    assert values(spark, citations.citation_from_title, rows) == ["78/2025/NĐ-CP", "51/2024/QH15", None, "12/qđ-ttg", None, None]
    assert values(spark, citations.legacy_citation_from_title, rows[1:2]) == ["đi"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("51/2024/QH15", "51/2024/QH15"), ("Luật số 51/2024/QH15", "51/2024/QH15"), ("số: 51/2024/QH15", "51/2024/QH15"), ("Số hiệu: 1/2", "1/2"), ("số số 9/2020", "9/2020"), ("Bộ luật số  45/2019/QH14 ", "45/2019/QH14"), ("Không số", "Không số"), ("số", "số")],
)
def test_normalize_citation(spark, raw, want):
    assert values(spark, citations.normalize_citation, [raw]) == [want]


def test_preamble_and_body(spark):
    t = "CHÍNH PHỦ\nNGHỊ ĐỊNH\nVề việc\nCăn cứ Luật số 1/2020/QH14;\nChương I. QUY ĐỊNH\nĐiều 1. A"
    assert values(spark, citations.preamble, [t, "không"]) == ["NGHỊ ĐỊNH\nVề việc\nCăn cứ Luật số 1/2020/QH14;", None]
    assert values(spark, citations.body, [t, "không"]) == [" QUY ĐỊNH\nĐiều 1. A", None]
    assert values(spark, citations.body_start, [t, "không"]) == [t.index("QUY") - 1, -1]


def test_classify_reference(spark):
    rows = ["được sửa đổi tại", "bị bãi bỏ bởi", "thay thế", "đính chính", "Hướng  dẫn", "theo", "bãi bỏ và bổ sung", None]
    assert values(spark, citations.classify_reference, rows) == ["amends", "repeals", "amends", "corrects", "guides", "cites", "amends", "cites"]


def test_roman(spark):
    rows = ["I", "II", "IV", "IX", "XIV", "xl", "5", "", "ABC", None]
    want = ["1", "2", "4", "9", "14", "40", "5", "", "ABC", None]
    assert values(spark, text.roman_to_arabic, rows) == want
    assert [text.roman_value(r) for r in rows[:-1]] == want[:-1]


def test_fold_and_slug(spark):
    assert values(spark, text.fold_diacritics, ["Điều khoản đặc biệt", "e\u0301", "ấẦ"]) == ["dieu khoan dac biet".replace("dieu", "dieu", 1), "e", "aA"]
    assert values(spark, text.slugify, ["Luật Đất đai (sửa đổi) ", "--", "a" * 79 + " b" * 9]) == ["luat-dat-dai-sua-doi", "", "a" * 79]
    assert values(spark, text.trim_all, ["\u00a0 a\u2003b \t"]) == ["a\u2003b"]


def test_file_names(spark):
    f = lambda i, n, u: (lambda x: text.file_name(x, F.lit("Tiêu đề"), F.lit(u), F.lit(i), F.lit(n)))
    assert values(spark, f(0, 1, "https://a.b/x/y.docx?z=1"), ["1/2020/NĐ-CP"]) == ["1-2020-NĐ-CP_tieu-de.docx"]
    assert values(spark, f(1, 2, "https://a.b/x"), ["1/2 3"]) == ["1-23_tieu-de-2.pdf"]
    assert values(spark, files.media_type, ["a.PDF", "b.docx", "c"]) == ["application/pdf", files.MEDIA_TYPES[".docx"], "application/octet-stream"]
    assert values(spark, files.content_disposition, ["luật 1.pdf"]) == ["attachment; filename=\"lu_t 1.pdf\"; filename*=UTF-8''lu%E1%BA%ADt%201.pdf"]


def test_dates(spark):
    rows = ["1/2/2024", "01/12/2024", "--", "", None, "31/02/2024", "2024", " 3/4/2020 "]
    assert values(spark, dates.iso_text, rows) == ["2024-02-01", "2024-12-01", None, None, None, "2024-02-31", None, "2020-04-03"]
    assert values(spark, dates.source_date, rows)[5] is None
    assert values(spark, dates.listed_date, ["1-2-2024", "x", " ", None]) == ["01/02/2024", "x", None, None]
    assert values(spark, dates.manifest_date, ["01/02/2024", "1/2/2024", "31/02/2024"]) == [dt.date(2024, 2, 1), None, None]
    assert values(spark, dates.date_of_timestamp, ["2024-01-18T00:00:00", "", None]) == ["2024-01-18", None, None]


TIERS = [
    ("Hiến pháp", "Quốc hội", 1), ("Bộ luật", "Quốc hội", 2), ("Luật", None, 2), ("Nghị quyết", "Ủy ban Thường vụ Quốc hội", 3), ("Nghị quyết", "Quốc hội", 2), ("Pháp lệnh", "x", 3),
    ("Lệnh", "Chủ tịch nước", 4), ("Quyết định", "Chủ tịch nước", 4), ("Nghị định", "Chính phủ", 5), ("Nghị quyết", "Chính phủ", 5), ("Quyết định", "Thủ tướng Chính phủ", 6),
    ("Nghị quyết", "Hội đồng Thẩm phán", 7), ("Thông tư", "Bộ Y tế", 8), ("Thông tư liên tịch", "Bộ Y tế", 9), ("Nghị quyết", "Hội đồng nhân dân tỉnh A", 10), ("Quyết định", "Ủy ban nhân dân tỉnh A", 11),
    ("Quyết định", "Ủy ban nhân dân thành phố Hà Nội", 11), ("Nghị quyết", "Hội đồng nhân dân huyện B", 13), ("Quyết định", "Ủy ban nhân dân quận C", 14), ("Quyết định", "Bộ Y tế", None), (None, "x", None), ("", None, None), ("Chỉ thị", "x", None),
]


def test_tiers(spark):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(TIERS)], "i int, d string, b string, want int")
    bad = df.select("*", authority.classify_tier(F.col("d"), F.col("b")).alias("t")).filter("not (t.tier <=> want)").collect()
    assert bad == []
    two = df.filter("i in (2, 4)").orderBy("i").select(authority.classify_tier(F.col("d"), F.col("b"))["subdir"]).collect()
    assert [r[0] for r in two] == ["02-luat-nghi-quyet-quoc-hoi/luat-bo-luat", "02-luat-nghi-quyet-quoc-hoi/nghi-quyet-quoc-hoi"]


def test_rank_and_status(spark):
    assert values(spark, authority.authority_rank, ["Ủy ban Thường vụ Quốc hội", "Quốc hội", "Chủ tịch nước", "Thủ tướng Chính phủ", "Chính phủ", "Hội đồng Thẩm phán", "Bộ Y tế"]) == [3, 2, 4, 6, 5, 7, 8]
    assert values(spark, authority.status_code, ["Còn hiệu lực", " hết hiệu lực toàn bộ ", None]) == ["con_hieu_luc", "het_hieu_luc", None]
    assert values(spark, authority.status_label, ["con_hieu_luc", None]) == ["Còn hiệu lực", "Chưa xác định"]
    with pytest.raises(Exception, match="unknown validity status"):
        values(spark, authority.status_code, ["lạ"])


def test_hashes(spark):
    import hashlib

    got = values(spark, lambda x: hashing.joined_sha256(x, F.lit(None), F.lit("b")), ["a"])
    assert got == [hashlib.sha256(b"ab").hexdigest()]
    a, b = (values(spark, lambda x, o=o: hashing.stable_id(x, F.lit(o).cast("string")), ["a"]) for o in (None, ""))
    assert a != b


def test_sql_functions(spark):
    sql_functions.register(spark)
    r = spark.sql("select citation_from_title('Luật số 1/2020/QH14'), normalize_citation('Luật số: 1/2'), fold_diacritics('Đất'), slugify('Luật Đất đai'), roman_to_arabic('XIV'), roman_to_arabic('5')").first()
    assert list(r) == ["1/2020/QH14", "1/2", "dat".capitalize().replace("D", "d"), "luat-dat-dai", "14", "5"]
