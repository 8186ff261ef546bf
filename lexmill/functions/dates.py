"""Dates in the sources' forms. Bad dates become null and never fail a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import trim_all

_DMY = r"^(\d{1,2})([/-])(\d{1,2})[/-](\d{4})$"


def _part(c: Column, group: int, width: int = 2) -> Column:
    return F.lpad(F.regexp_extract(c, _DMY, group), width, "0")


def iso_text(c: Column) -> Column:
    """d/m/yyyy -> yyyy-MM-dd as text, without a look at the calendar; other text, "--" and empty text: null."""
    t = trim_all(c)
    return F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.concat_ws("-", _part(t, 4, 4), _part(t, 3), _part(t, 1)))


def source_date(c: Column) -> Column:
    return F.try_to_date(iso_text(c), "yyyy-MM-dd")


def listed_date(c: Column) -> Column:
    """d-m-yyyy or d/m/yyyy -> dd/MM/yyyy; other text trimmed, as it is; empty text: null."""
    t = trim_all(c)
    fixed = F.concat_ws("/", _part(t, 1), _part(t, 3), _part(t, 4, 4))
    return F.when(t.rlike(_DMY), fixed).otherwise(F.nullif(t, F.lit("")))


def manifest_date(c: Column) -> Column:
    """dd/MM/yyyy, two digits, two digits, four; else null. Days that a month doesn't have: null."""
    return F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(c, "dd/MM/yyyy"))


def display_date(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def date_of_timestamp(c: Column) -> Column:
    """The date part of an ISO timestamp's text; empty text: null."""
    return F.nullif(F.substring(c, 1, 10), F.lit(""))


def valid_from(effective: Column, enacted: Column) -> Column:
    return F.coalesce(effective, enacted)


def valid_at(as_of: Column, start: Column, end: Column) -> Column:
    """Half-open: start <= as_of < end; no end means open."""
    return (start <= as_of) & (end.isNull() | (end > as_of))
