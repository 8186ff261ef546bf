"""Scraped attribute pairs and relation cards to columns and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.authority import unknown_status
from lexmill.functions.citations import citation_in_text, normalize_citation
from lexmill.functions.dates import source_date
from lexmill.functions.text import blank_to_null, trim_all

EMPTY = "--"
#: fixed values: attribute labels; the first three are required
ATTRIBUTES = {
    "citation": "Số hiệu",
    "document_type": "Loại văn bản",
    "issuing_body": "Cơ quan ban hành",
    "industry": "Ngành",
    "field": "Lĩnh vực",
    "signer_title": "Chức danh",
    "signer_name": "Người ký",
    "issued_date_raw": "Ngày ban hành",
    "effective_date_raw": "Ngày có hiệu lực",
    "expiry_date_raw": "Ngày hết hiệu lực",
    "validity_status_raw": "Tình trạng hiệu lực",
}
REQUIRED = ("citation", "document_type", "issuing_body")
#: fixed values: headings of relation cards (this document is the target, this document is the source), type and change
RELATIONS = [
    ("Văn bản được hướng dẫn áp dụng", "Văn bản hướng dẫn áp dụng", "guides", None),
    ("Văn bản được quy định chi tiết, hướng dẫn thi hành", "Văn bản quy định chi tiết, hướng dẫn thi hành", "implements", None),
    ("Văn bản được sửa đổi bổ sung", "Văn bản sửa đổi bổ sung", "amends", None),
    ("Văn bản được đính chính", "Văn bản đính chính", "corrects", None),
    ("Văn bản được thay thế", "Văn bản thay thế", "amends", "replace"),
    ("Văn bản bị bãi bỏ", "Văn bản bãi bỏ", "repeals", None),
    ("Văn bản được dẫn chiếu", "Văn bản dẫn chiếu", "cites", None),
    ("Văn bản áp dụng", "Căn cứ ban hành", "has_basis", None),
    ("Văn bản được giải thích", "Văn bản giải thích", "explains", None),
    ("Văn bản bị đình chỉ thi hành", "Văn bản đình chỉ thi hành", "amends", "suspend_execution"),
    ("Văn bản bị tạm ngưng hiệu lực", "Văn bản tạm ngưng hiệu lực", "amends", "suspend_effect"),
    ("Văn bản được công bố", "Văn bản công bố", "promulgates", None),
]
#: fixed values: the heading that tells no relation, and those of consolidation
IGNORED, CONSOLIDATED_INTO, CONSOLIDATES = "Văn bản liên quan cùng nội dung", "Văn bản được hợp nhất", "Văn bản hợp nhất"


def strip_count(label: Column) -> Column:
    """A card's heading without the number of its entries."""
    return trim_all(F.regexp_replace(label, r"(?U)\s*\(\d+\)\s*$", ""))


def trimmed(pairs: Column) -> Column:
    """The pairs with trimmed labels and values, for ``attribute``."""
    return F.transform(pairs, lambda p: F.struct(trim_all(p["label"]).alias("label"), trim_all(p["value"]).alias("value")))


def attribute(pairs: Column, label: str) -> Column:
    """The last value with that label; null without one. The pairs are trimmed."""
    return F.try_element_at(F.filter(pairs, lambda p: p["label"] == label), F.lit(-1))["value"]


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once, however often it is read: no filter on it goes below, where it would be computed again."""
    return rows.withColumn(name, F.explode(F.array(value)))


def parse_attributes(pages: DataFrame, pairs: str = "attributes") -> DataFrame:
    """pages with a column per attribute; a page without a required one fails the query. The citation is normalised.
    A page whose pairs are null has null in all of them."""
    pages = once(pages, "__pairs", trimmed(F.col(pairs)))
    got = {name: attribute(F.col("__pairs"), label) for name, label in ATTRIBUTES.items()}
    labels = F.array_join(F.transform(pairs, lambda p: p["label"]), ", ")
    for name in REQUIRED:
        refused = F.raise_error(F.concat(F.lit(f"no {name} among: "), labels)).cast("string")
        got[name] = F.coalesce(blank_to_null(got[name]), F.when(F.col(pairs).isNotNull(), refused))
    got["citation"] = normalize_citation(got["citation"])
    return pages.withColumns(got).drop("__pairs")


def page_problem(pairs: str = "attributes", cards: str = "relations", plain: str | None = None) -> Column:
    """What keeps a page from being taken: a missing required attribute, an unreadable issue date, an unknown status or heading; else null.
    What the parsers refuse is refused here, so pages without a problem never fail a query. plain: a column of the trimmed pairs."""
    own = trimmed(F.col(pairs)) if plain is None else F.col(plain)
    labels = F.coalesce(F.array_join(F.transform(pairs, lambda p: p["label"]), ", "), F.lit(""))
    got = {name: blank_to_null(attribute(own, ATTRIBUTES[name])) for name in (*REQUIRED, "issued_date_raw")}
    status = attribute(own, ATTRIBUTES["validity_status_raw"])
    found = [F.when(got[name].isNull(), F.concat(F.lit(f"no {name} among: "), labels)) for name in REQUIRED]
    found.append(F.when(source_date(got["issued_date_raw"]).isNull(), F.concat(F.lit("no issue date: "), normalize_citation(got["citation"]))))
    found.append(F.when(unknown_status(status), F.concat(F.lit("unknown validity status: "), status)))
    bad = unknown_headings(F.col(cards))
    found.append(F.when(F.size(bad) > 0, F.concat(F.lit("unknown relation heading: "), F.array_join(bad, ", "))))
    return F.coalesce(*found)


def unknown_headings(cards: Column) -> Column:
    names = [lab for passive, active, *_ in RELATIONS for lab in (passive, active)] + [IGNORED, CONSOLIDATED_INTO, CONSOLIDATES]
    return F.filter(F.transform(cards, lambda c: strip_count(c["categoryLabel"])), lambda x: ~x.isin(names))


def relation_rows(pages: DataFrame, key: str, cards: str = "relations") -> DataFrame:
    """(key, label, entry): each entry of each card; placeholders and blanks are left out."""
    rows = pages.select(key, F.explode(cards).alias("c")).select(key, strip_count(F.col("c.categoryLabel")).alias("label"), F.explode("c.entries").alias("entry"))
    return rows.withColumn("entry", trim_all(F.col("entry"))).filter(F.col("entry").isNotNull() & ~F.col("entry").isin("", EMPTY))


def parse_relations(pages: DataFrame, key: str, cards: str = "relations") -> DataFrame:
    """(key, reference_type, change_type, this_is_source, raw_citation_text, citation); an unknown heading fails the query, even without entries."""
    spark = pages.sparkSession
    table = [(lab, kind, change, source) for passive, active, kind, change in RELATIONS for lab, source in ((passive, False), (active, True))]
    known = spark.createDataFrame(table, "label string, reference_type string, change_type string, this_is_source boolean")
    bad = unknown_headings(F.col(cards))
    sure = pages.withColumn(cards, F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("unknown relation heading: "), F.array_join(bad, ", ")))).otherwise(F.col(cards)))
    rows = relation_rows(sure, key, cards).join(F.broadcast(known), "label")  # 24 rows
    return rows.select(key, "reference_type", "change_type", "this_is_source", F.col("entry").alias("raw_citation_text"), citation_in_text(F.col("entry")).alias("citation"))


def _entries(cards: Column, heading: str) -> Column:
    own = F.filter(cards, lambda c: strip_count(c["categoryLabel"]) == heading)
    return F.filter(F.transform(F.flatten(F.transform(own, lambda c: c["entries"])), trim_all), lambda e: ~e.isin("", EMPTY))


def consolidation(pages: DataFrame, cards: str = "relations") -> DataFrame:
    """pages with the titles that a document consolidates, and into which it is consolidated."""
    return pages.withColumns({"consolidates_raw_titles": _entries(F.col(cards), CONSOLIDATES), "consolidated_into_raw_titles": _entries(F.col(cards), CONSOLIDATED_INTO)})
