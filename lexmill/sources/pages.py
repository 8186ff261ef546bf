"""Web pages as sources: allow-lists, links, document pages, listing pages and detail pages.

Pages are tables of already fetched HTML. Parsers run once per row on Arrow batches; links and filters are Columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lexmill import schemas
from lexmill.sources.dom import Element, classed, parse, tagged

#: fixed values: marks in document pages
CENTRAL, LOCAL = "trung-uong", "dia-phuong"
CRUMBS, CRUMB_ITEM, PANE = "ant-breadcrumb", "ant-breadcrumb-item", "ant-tabs-tabpane-active"
ITEM, ITEM_LABEL, ITEM_VALUE, CARD, CARD_HEADING = "ant-descriptions-item-container", "ant-descriptions-item-label", "ant-descriptions-item-content", "ant-card", "font-bold"
#: fixed values: ids' ends of the listing form's controls, and marks in listing and detail pages
CONTROLS = {"category": "_drdDocCategory", "org": "_drdDocOrg", "year": "_drdDocYear", "recordsPerPage": "_drdRecordPerPage", "keyword": "_txtSearchKeyword", "searchButton": "_btnSearch"}
GRID, CODE, ISSUED, ABSTRACT, FILES, COUNTER, VIEW = "_grvDocument", "code", "issued-date", "substract", "bl-doc-file", "document_page_info", "view-file"
DETAIL_LABELS = {"citation": "Số ký hiệu", "title": "Trích yếu", "date": "Ngày ban hành", "docType": "Loại văn bản", "issuingBody": "Cơ quan ban hành"}

LISTING = schemas.struct("hiddenFields map<string,string>, controls map<string,string>, rows array<struct<citation:string, title:string, date:string, docUrl:string, fileUrls:array<string>>>, shownCount int, totalCount int")
DETAIL = schemas.struct("citation string, title string, date string, docType string, issuingBody string, sourceUrl string, fileUrls array<string>")


def allowed(url: Column, suffixes: list[str] | None = None, hosts: list[str] | None = None, forbidden: list[str] | None = None, scheme: str = "https") -> Column:
    """Whether a URL has the scheme, one of the hosts (exactly) or host suffixes (itself or below it) and no forbidden path prefix; malformed URLs don't."""
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    names = [host == h.lower() for h in hosts or []] + [(host == s.lower()) | host.endswith(f".{s.lower()}") for s in suffixes or []]
    cond = (F.try_parse_url(url, F.lit("PROTOCOL")) == scheme) & reduce(or_, names, F.lit(False))
    cond = reduce(and_, [~path.startswith(p) for p in forbidden or []], cond)
    return F.coalesce(cond, F.lit(False))


def link_list(html: Column) -> Column:
    """The values of all href attributes, in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row per href attribute."""
    return pages.withColumn("link", F.explode(link_list(F.col(html))))


def _rows(df: DataFrame, schema: schemas.Schema, make: Callable[[str, str], dict | None]) -> DataFrame:
    """One dictionary per row of (url, html); None leaves the row out."""

    struct = schema.struct()
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = (make(u.as_py(), h.as_py()) for u, h in zip(*batch.columns))
            yield pa.RecordBatch.from_pylist([r for r in made if r is not None], schema=arrow)

    return df.mapInArrow(run, struct)


def document_page(url: str, html: str | None) -> dict:
    root = parse(html)
    nav = root.first(tagged("nav", CRUMBS))
    scope, title = "unknown", ""
    if nav:
        for name in (CENTRAL, LOCAL):
            if nav.first(tagged("a", href=f"/van-ban/{name}")):
                scope = name
                break
        items = nav.find(tagged("li", CRUMB_ITEM))
        title = items[-1].text() if items else ""
    pane = root.first(classed(PANE))
    words = lambda e: e.text() if e else ""
    attributes = [{"label": words(c.first(classed(ITEM_LABEL))), "value": words(c.first(classed(ITEM_VALUE)))} for c in root.find(classed(ITEM))]
    relations = []
    for card in root.find(classed(CARD)):
        entries = [a.text() for ul in card.find(tagged("ul")) for li in ul.find(tagged("li")) for a in li.find(tagged("a"))]
        relations.append({"categoryLabel": words(card.first(tagged("span", CARD_HEADING))), "entries": [x for x in entries if x]})
    return {"sourceUrl": url, "scope": scope, "title": title, "fullText": pane.text(lines=True) if pane else "", "attributes": [a for a in attributes if a["label"]], "relations": [r for r in relations if r["categoryLabel"]]}


def _listed(raw: str | None) -> str | None:
    t = (raw or "").strip()
    m = re.fullmatch(r"(\d{1,2})[-/](\d{1,2})[-/](\d{4})", t)
    return f"{m[1]:0>2}/{m[2]:0>2}/{m[3]}" if m else t or None


def listing_page(url: str, html: str | None) -> dict:
    root = parse(html)
    hidden = {e.attrs["name"]: e.attrs.get("value", "") for e in root.find(tagged("input", type="hidden")) if e.attrs.get("name")}
    known = [(i, e) for e in root.below() if (i := e.attrs.get("id"))]
    ending = lambda suffix: next((e for i, e in known if i.endswith(suffix)), None)
    names = {k: e.attrs.get("name") if (e := ending(s)) else None for k, s in CONTROLS.items()}
    grid = next((e for i, e in known if e.tag == "table" and i.endswith(GRID)), None)
    names["gridView"] = re.sub(f"{GRID}$", f"${GRID[1:]}", grid.attrs["id"]) if grid else None
    rows = []
    for tr in grid.find(tagged("tr"))[1:] if grid else []:
        cells = tr.find(tagged("td"))
        code = cells[0].first(tagged("span", CODE)) if len(cells) >= 3 else None
        if not code or not code.text():
            continue
        a, day, abstract = cells[0].first(tagged("a")), cells[1].first(tagged("span", ISSUED)), cells[2].first(tagged("span", ABSTRACT))
        href = a.attrs.get("href") if a else None
        files = [x.attrs["href"] for d in cells[2].find(tagged("div", FILES)) for x in d.find(tagged("a")) if x.attrs.get("href")]
        rows.append({"citation": code.text(), "title": abstract.text() if abstract else "", "date": _listed(day.text() if day else None), "docUrl": urljoin(url or "", href) if href else None, "fileUrls": files})
    info = next((e for i, e in known if i == COUNTER), None)
    m = re.search(r"(\d+)\s*-\s*(\d+)\s*\|\s*(\d+)", info.text() if info else "")
    return {"hiddenFields": hidden, "controls": names if all(names.values()) else None, "rows": rows, "shownCount": int(m[2]) if m else None, "totalCount": int(m[3]) if m else None}


def detail_page(url: str, html: str | None) -> dict | None:
    """None for a page without a citation."""
    meta: dict[str, str] = {}
    files: list[str] = []
    for box in parse(html).find(tagged("div", "Content")):
        for td in box.find(tagged("td", "col1")):
            value: Element | None = td.following("td")
            if label := td.text():
                meta[label] = value.text() if value else ""
        files += [a.attrs["href"] for a in box.find(tagged("a", VIEW)) if a.attrs.get("href")]
    got = {k: meta.get(label) for k, label in DETAIL_LABELS.items()}
    if not got["citation"]:
        return None
    return got | {"title": got["title"] or "", "date": _listed(got["date"]), "sourceUrl": url, "fileUrls": list(dict.fromkeys(files))}


def _parsed(pages: DataFrame, schema: schemas.Schema, make, url: str, html: str) -> DataFrame:
    return _rows(pages.select(F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h")), schema, make)


def parse_document_pages(pages: DataFrame, url: str = "sourceUrl", html: str = "html") -> DataFrame:
    return _parsed(pages, schemas.RAW_PAGE, document_page, url, html)


def parse_listing_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    return _parsed(pages, LISTING, listing_page, url, html)


def listed_rows(listings: DataFrame, limit: int | None = None) -> DataFrame:
    """The documents of listing pages, a row each."""
    rows = listings.select(F.explode("rows").alias("r")).select("r.*")
    return rows if limit is None else rows.limit(limit)


def parse_detail_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    return _parsed(pages, DETAIL, detail_page, url, html)


def pages_needed(most: int, page_size: int, cap: int = 50) -> range:
    """Numbers of the pages after the first that a listing of so many rows may need."""
    return range(2, min(-(-most // page_size) + 1, cap) + 1)
