"""Filtered, paged document search."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.authority import STATUS_CODES, status_label
from lexmill.functions.dates import display_date

#: fixed values: where a keyword is looked for
TITLE, NUMBER, CONTENT = "tieu-de", "so-hieu", "noi-dung"
PAGE_SIZE, MOST_RESULTS, MOST_ITEMS = 10, 500, 100


def parse_day(text: str | None) -> date | None:
    """dd/mm/yyyy; anything else is no bound."""
    m = re.fullmatch(r"\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*", text or "")
    try:
        return date(int(m[3]), int(m[2]), int(m[1])) if m else None
    except ValueError:
        return None


def flag(value: object) -> bool:
    """A truth value as requests carry it: the words false, 0, no and off are false."""
    return value.strip().lower() not in ("", "false", "0", "no", "off") if isinstance(value, str) else bool(value)


@dataclass(frozen=True)
class Filters:
    """Optional constraints; what isn't given doesn't constrain. Unknown status labels and bad dates are no constraint."""

    keyword: str | None = None
    scope: str = TITLE
    exact: bool = False
    issuing_bodies: list[str] = field(default_factory=list)
    document_types: list[str] = field(default_factory=list)
    validity_status: str | None = None
    issued_from: str | None = None
    issued_to: str | None = None
    effective_from: str | None = None
    effective_to: str | None = None
    page: int = 1
    page_size: int = PAGE_SIZE

    def __post_init__(self) -> None:
        if self.scope not in (TITLE, NUMBER, CONTENT):
            raise ValueError(f"unknown search scope {self.scope!r}")
        if self.page < 1 or not 1 <= self.page_size <= MOST_RESULTS:
            raise ValueError(f"page from 1, page size from 1 to {MOST_RESULTS}")

    def empty(self) -> bool:
        return self == Filters(page=self.page, page_size=self.page_size)


def keyword_predicate(keyword: str, scope: str = TITLE, exact: bool = False, text: Column | None = None) -> Column:
    """Case-insensitive LIKE, in which % and _ keep their meaning; exact takes the whole value."""
    pattern = keyword if exact else f"%{keyword}%"
    like = lambda c: c.ilike(pattern)
    if scope == CONTENT:
        return like(F.col("raw_source.fullText") if text is None else text)
    return like(F.col("citation_id")) if scope == NUMBER else like(F.col("title")) | like(F.col("citation_id"))


def between(c: Column, low: date | None, high: date | None) -> list[Column]:
    return ([c >= F.lit(low)] if low else []) + ([c <= F.lit(high)] if high else [])


def predicates(f: Filters, body_name: str = "issuing_body") -> Column:
    """All constraints of a document row joined with its issuing body."""
    out = []
    if f.keyword:
        out.append(keyword_predicate(f.keyword, f.scope, f.exact))
    if f.document_types:
        out.append(F.col("document_type").isin(f.document_types))
    if f.issuing_bodies:
        out.append(F.col(body_name).isin(f.issuing_bodies))
    if code := STATUS_CODES.get((f.validity_status or "").lower()):
        out.append(F.col("status") == code)
    out += between(F.col("enacted_date"), parse_day(f.issued_from), parse_day(f.issued_to))
    out += between(F.col("effective_date"), parse_day(f.effective_from), parse_day(f.effective_to))
    return reduce(and_, out, F.lit(True))


def matching(document: DataFrame, issuing_body: DataFrame, f: Filters) -> DataFrame:
    """Documents with their issuing body's name that meet the filters. Adaptive execution broadcasts the bodies if they are small."""
    bodies = issuing_body.select(F.col("id").alias("issuing_body_id"), F.col("name").alias("issuing_body"))
    return document.join(bodies, "issuing_body_id").filter(predicates(f))


def search_page(document: DataFrame, issuing_body: DataFrame, f: Filters = Filters()) -> DataFrame:
    """One page, newest first, ties by citation: a top-k plan, not a full sort."""
    rows = matching(document, issuing_body, f).orderBy(F.desc("enacted_date"), "citation_id")
    return rows.offset((f.page - 1) * f.page_size).limit(f.page_size)


def search_total(document: DataFrame, issuing_body: DataFrame, f: Filters = Filters()) -> DataFrame:
    return matching(document, issuing_body, f).agg(F.count("*").alias("total"))


def shown(rows: DataFrame) -> DataFrame:
    """Search rows as they are displayed; a row without a source address has null there."""
    dates = {c: display_date(F.col(c)) for c in ("enacted_date", "effective_date", "expiry_date") if c in rows.columns}
    return rows.withColumns(dates | {"status": status_label(F.col("status")), "source_url": F.col("raw_source.sourceUrl")})


def point_lookup(table: DataFrame, key: str, value: object, *columns: str) -> DataFrame:
    return table.filter(F.col(key) == F.lit(value)).select(*columns or ["*"]).limit(1)


def lookup_many(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Many point lookups as one join; keys without a row stay, with nulls."""
    return keys.join(table, key, "left")


def issuing_bodies(issuing_body: DataFrame, document: DataFrame, keyword: str | None = None, scope: str | None = None) -> DataFrame:
    """Bodies with their document counts, zero included, by rank and name. Documents are counted before the join."""
    keep = reduce(and_, ([F.col("name").ilike(f"%{keyword}%")] if keyword else []) + ([F.col("scope") == scope] if scope else []), F.lit(True))
    counts = document.groupBy("issuing_body_id").agg(F.count("*").alias("n"))
    rows = issuing_body.filter(keep).join(counts, F.col("id") == F.col("issuing_body_id"), "left")
    return rows.select("id", "name", "authority_rank", "scope", F.coalesce("n", F.lit(0)).alias("document_count")).orderBy("authority_rank", "name", "id")


def document_detail(document: DataFrame, issuing_body: DataFrame, document_id: str) -> DataFrame:
    return shown(matching(document.filter(F.col("id") == document_id), issuing_body, Filters()).limit(1))
