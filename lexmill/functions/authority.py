"""Ranks, tiers and validity labels, by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import trim_all

#: fixed values: names in an issuing body's name, in order, with its rank; others have 8
RANK_RULES = [("ủy ban thường vụ quốc hội", 3), ("quốc hội", 2), ("chủ tịch nước", 4), ("thủ tướng", 6), ("chính phủ", 5), ("hội đồng thẩm phán", 7)]
OTHER_RANK = 8

#: fixed values: folders of the 14 tiers
TIER_FOLDERS = {
    1: "01-hien-phap",
    2: "02-luat-nghi-quyet-quoc-hoi",
    3: "03-phap-lenh-nghi-quyet-ubtvqh",
    4: "04-lenh-quyet-dinh-chu-tich-nuoc",
    5: "05-nghi-dinh-nghi-quyet-chinh-phu",
    6: "06-quyet-dinh-thu-tuong-chinh-phu",
    7: "07-nghi-quyet-hoi-dong-tham-phan-tandtc",
    8: "08-thong-tu-bo-nganh",
    9: "09-thong-tu-lien-tich",
    10: "10-nghi-quyet-hdnd-cap-tinh",
    11: "11-quyet-dinh-ubnd-cap-tinh",
    12: "12-vbqppl-don-vi-hanh-chinh-kinh-te-dac-biet",
    13: "13-nghi-quyet-hdnd-cap-huyen",
    14: "14-quyet-dinh-ubnd-cap-huyen",
}
#: fixed values: the folders within tier 2
LAWS, ASSEMBLY_RESOLUTIONS = "luat-bo-luat", "nghi-quyet-quoc-hoi"
DISTRICT_WORDS = ["huyện", "quận", "thị xã", "thành phố thuộc tỉnh", "thành phố thuộc thành phố"]

#: fixed values: labels of validity, in lower case, with their codes, and the codes' labels
STATUS_CODES = {
    "chưa có hiệu lực": "chua_co_hieu_luc",
    "còn hiệu lực": "con_hieu_luc",
    "hết hiệu lực toàn bộ": "het_hieu_luc",
    "hết hiệu lực": "het_hieu_luc",
    "hết hiệu lực một phần": "het_hieu_luc_mot_phan",
    "ngưng hiệu lực": "ngung_hieu_luc",
    "tạm ngưng hiệu lực": "ngung_hieu_luc",
}
STATUS_LABELS = {
    "chua_co_hieu_luc": "Chưa có hiệu lực",
    "con_hieu_luc": "Còn hiệu lực",
    "het_hieu_luc": "Hết hiệu lực",
    "het_hieu_luc_mot_phan": "Hết hiệu lực một phần",
    "ngung_hieu_luc": "Ngưng hiệu lực",
}
UNKNOWN_STATUS = "Chưa xác định"


def first_rule(rules: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def authority_rank(name: Column) -> Column:
    low = F.lower(name)
    return first_rule([(low.contains(words), rank) for words, rank in RANK_RULES], OTHER_RANK)


def classify_tier(doc_type: Column, body: Column) -> Column:
    """struct<tier:int, subdir:string>, or null where no rule holds; longer names before those that they hold."""
    kind, by = F.lower(F.coalesce(doc_type, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    none = F.lit(None).cast("struct<tier:int,subdir:string>")

    def to(tier: int, *below: str) -> Column:
        return F.struct(F.lit(tier).alias("tier"), F.lit("/".join([TIER_FOLDERS[tier], *below])).alias("subdir"))

    district = F.exists(F.array(*map(F.lit, DISTRICT_WORDS)), lambda w: by.contains(w))
    city = by.contains("thành phố")
    province = by.contains("tỉnh") | by.contains("thành phố trực thuộc trung ương") | (city & ~by.contains("thuộc tỉnh"))
    council, committee = by.contains("hội đồng nhân dân"), by.contains("ủy ban nhân dân")
    resolution = first_rule(
        [
            (by.contains("ủy ban thường vụ quốc hội"), to(3)),
            (by.contains("quốc hội"), to(2, ASSEMBLY_RESOLUTIONS)),
            (by.contains("hội đồng thẩm phán"), to(7)),
            (council & district, to(13)),
            (council & province, to(10)),
            (by.contains("chính phủ"), to(5)),
        ],
        none,
    )
    decision = first_rule([(by.contains("chủ tịch nước"), to(4)), (by.contains("thủ tướng"), to(6)), (committee & district, to(14)), (committee & province, to(11))], none)
    return first_rule(
        [
            (kind == "", none),
            (kind.contains("hiến pháp"), to(1)),
            (kind.contains("luật"), to(2, LAWS)),
            (kind.contains("nghị quyết"), resolution),
            (kind.contains("pháp lệnh"), to(3)),
            (kind.contains("lệnh"), to(4)),
            (kind.contains("nghị định"), to(5)),
            (kind.contains("quyết định"), decision),
            (kind.contains("thông tư liên tịch"), to(9)),
            (kind.contains("thông tư"), to(8)),
        ],
        none,
    )


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def unknown_status(label: Column) -> Column:
    """Whether a label is there but has no code."""
    return label.isNotNull() & F.try_element_at(_map(STATUS_CODES), F.lower(trim_all(label))).isNull()


def status_code(label: Column) -> Column:
    """The code of a label; null stays null, an unknown label fails the query."""
    code = F.try_element_at(_map(STATUS_CODES), F.lower(trim_all(label)))
    return F.when(~unknown_status(label), code).otherwise(F.raise_error(F.concat(F.lit("unknown validity status: "), label)))


def status_label(code: Column) -> Column:
    return F.when(code.isNull(), UNKNOWN_STATUS).otherwise(F.coalesce(F.try_element_at(_map(STATUS_LABELS), code), code))


def annex_class(heading: Column) -> Column:
    return F.when(F.lower(heading).rlike(r"(?U)mẫu\s+số"), "template").otherwise("normative")
