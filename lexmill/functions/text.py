"""Unicode text: trimming, folding, slugs, roman numerals. All are Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_all(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _fold_table() -> tuple[str, str]:
    """Precomposed Latin letters and their bases; made from the Unicode data, not listed."""
    pairs = {"đ": "d", "Đ": "d"}
    for code in range(0xC0, 0x1F00):
        base = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(x))
        if len(base) == 1 and base.isascii() and base.isalpha():
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _fold_table()


def fold_diacritics(c: Column) -> Column:
    """Letters without marks, composed or combining; both cases of the barred d become d."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), _FROM, _TO)


def slugify(c: Column, size: int = 80) -> Column:
    """Folded, lower case, runs of other characters as one hyphen, none at the ends, at most ``size`` long."""
    runs = F.regexp_replace(F.regexp_replace(F.lower(fold_diacritics(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(runs, 1, size), "-+$", "")


def citation_slug(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("/"), F.lit("-")), r"(?U)\s+", "")


def folder_name(citation: Column, title: Column) -> Column:
    return F.concat(citation_slug(citation), F.lit("_"), slugify(title))


def file_name(citation: Column, title: Column, url: Column, index: Column, count: Column) -> Column:
    """A file's name; index from 0. Several files of a document get a number; the ending is the URL's, else .pdf."""
    path = F.try_parse_url(url, F.lit("PATH"))
    ending = blank_to_null(F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1))
    number = F.when(count > 1, F.concat(F.lit("-"), (index + 1).cast("string"))).otherwise("")
    return F.concat(folder_name(citation, title), number, F.coalesce(ending, F.lit(".pdf")))


#: fixed values: roman digits
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_value(text: str) -> str:
    """The number of a roman numeral as text; other text as it is."""
    up = text.upper()
    if not up or any(ch not in ROMAN for ch in up):
        return text
    values = [ROMAN[ch] for ch in up]
    return str(sum(-v if v < after else v for v, after in zip(values, [*values[1:], 0])))


def roman_to_arabic(c: Column) -> Column:
    """roman_value as a Column: digits are summed, and those before a larger one count twice negatively."""
    up = F.upper(c)
    table = F.create_map(*(x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v))))
    digits = F.transform(F.filter(F.split(up, ""), lambda ch: ch != ""), lambda ch: F.coalesce(F.try_element_at(table, ch), F.lit(0)))
    nexts = F.concat(F.slice(digits, 2, 1 << 20), F.array(F.lit(0)))
    total = F.aggregate(F.zip_with(digits, nexts, lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0), lambda s, x: s + x)
    return F.when(up.rlike("^[IVXLCDM]+$"), total.cast("string")).otherwise(c)


def node_header(label: Column, heading: Column) -> Column:
    """The label and, unless null or empty, the heading after a space."""
    return F.concat_ws(" ", label, blank_to_null(heading))


def path_segment(node_type: Column, ordinal: Column) -> Column:
    """One label of a node path; a barred d is kept as dd, so inserted points stay apart from their neighbours."""
    plain = F.regexp_replace(F.regexp_replace(ordinal, "[đĐ]", "dd"), "[^A-Za-z0-9_]", "")
    return F.concat(node_type, plain)


def legacy_path_segment(node_type: Column, ordinal: Column) -> Column:
    """Parity form of path_segment: all characters outside A-Z, a-z, 0-9 and _ are left out."""
    return F.concat(node_type, F.regexp_replace(ordinal, "[^A-Za-z0-9_]", ""))
