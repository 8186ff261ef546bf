"""Citations in titles, attribute values and running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import blank_to_null, trim_all

#: fixed values: words of a citation's source language
NUMBER_WORD = "số"
TYPE_WORDS = ["bộ luật", "luật", "nghị định", "nghị quyết", "thông tư liên tịch", "thông tư", "pháp lệnh", "quyết định", "chỉ thị", "lệnh"]
BASIS_WORDS = "căn cứ"
CHAPTER_WORD = "CHƯƠNG"
PREAMBLE_MARKERS = ["NGHỊ ĐỊNH", "LUẬT", "THÔNG TƯ", "QUYẾT ĐỊNH", "LỆNH", "PHÁP LỆNH", "NGHỊ QUYẾT"]
#: fixed values: words around a citation, in order, with the type of reference that they tell
CONTEXT_RULES = [
    (r"sửa\s+đổi|bổ\s*sung", "amends"),
    (r"bãi\s+bỏ|hết\s+hiệu\s+lực", "repeals"),
    (r"thay\s+thế", "amends"),
    (r"đính\s+chính", "corrects"),
    (r"hướng\s+dẫn", "guides"),
]
#: fixed value: the parity form of citations in running text; it knows five issuer forms
LEGACY_FORM = r"\d{1,3}/\d{4}/(?:[A-Z]{2,5}(?:-\d+)?-CP|TT-[A-Z]{2,5}|QH\d+|NQ-[A-ZĐ]{1,3}\d+|QĐ-[A-Z]{2,5})"
#: fixed values: codes of document types, and of bodies whose laws are numbered by their term
TYPE_CODES = ["CT", "HD", "KH", "L", "LCT", "ND", "NĐ", "NQ", "NQLT", "PL", "QD", "QĐ", "QC", "SL", "TB", "TT", "TTLB", "TTLT", "VBHN"]
TERM_CODES = ["HĐNN", "NQ/QH", "QH", "UBTVQH"]
#: what may not stand before and after a citation; the parity form knows ASCII words alone
EDGES = {False: (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"), True: ("(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])")}


def _form() -> str:
    """Number, year and code: a body with its term, or a document type with one or more issuers (joint circulars have several).
    A number of more than three digits counts where the number word introduces it."""
    issuer = r"[-/](?:[A-ZĐƯ]{1,12}\d{0,2}|\d{1,2})"
    word = "".join(f"[{c}{c.upper()}]" for c in NUMBER_WORD)  # spelt out, since flags within a pattern aren't the same in all engines
    number = rf"(?:\d{{1,3}}|(?<=(?<![\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]){word}\s{{1,4}})\d{{4,}})"
    return rf"{number}/\d{{4}}/(?:(?:{'|'.join(TERM_CODES)})\d{{1,2}}|(?:{'|'.join(TYPE_CODES)})(?:{issuer})+)"


BODY_CITATION, LEGACY_BODY_CITATION = (form.join(EDGES[legacy]) for legacy, form in ((False, _form()), (True, LEGACY_FORM)))
#: letters of the shortest citation, at most
SHORTEST = len("1/2000/QH1")
CHAPTER_START = rf"(?iuU)[\n\r]\s*{CHAPTER_WORD}\s*[\dIVXLC]+[.\s]"
WINDOW = 80


def citation_from_title(c: Column) -> Column:
    """The first number after the number word that holds a digit; else null."""
    return blank_to_null(F.regexp_extract(c, rf"(?iuU){NUMBER_WORD}\s+((?=[A-ZĐ/-]*\d)[0-9A-ZĐ][0-9A-ZĐ/-]*[0-9A-ZĐ])", 1))


def legacy_citation_from_title(c: Column) -> Column:
    """Parity form: the first run of capitals, digits, / and - after the number word, digits or not."""
    return blank_to_null(F.regexp_extract(c, rf"(?iuU){NUMBER_WORD}\s+([0-9A-ZĐ][0-9A-ZĐ/-]*[0-9A-ZĐ])", 1))


def normalize_citation(c: Column) -> Column:
    """Without any number of leading type words and number words; never empty unless the value is."""
    types = "|".join(w.replace(" ", r"\s+") for w in TYPE_WORDS)
    value = trim_all(c)
    bare = trim_all(F.regexp_replace(value, rf"(?iuU)^(?:(?:{types})?\s*{NUMBER_WORD}(?:\s+hiệu)?\s*:?\s*)+", ""))
    return F.coalesce(blank_to_null(bare), value)


def citation_in_text(c: Column, pattern: str = BODY_CITATION) -> Column:
    """A title's citation or, without one, the first in the forms of running text; else null."""
    return F.coalesce(citation_from_title(c), blank_to_null(F.regexp_extract(c, pattern, 0)))


def classify_reference(context: Column) -> Column:
    """The type of reference that the words around a citation tell; never null."""
    low, out = F.lower(context), None
    for words, kind in CONTEXT_RULES:
        hit = low.rlike(f"(?U){words}")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return F.when(context.isNull(), "cites").otherwise(out.otherwise("cites"))


def preamble(text: Column) -> Column:
    """From the first document-type marker to the first chapter heading after it, or to the end; null without a marker."""
    up = F.upper(text)
    found = F.array_min(F.filter(F.array(*(F.locate(m, up) for m in PREAMBLE_MARKERS)), lambda p: p > 0))
    return trim_all(F.split(F.substring(text, found, F.length(text)), CHAPTER_START, 2)[0])


def body_start(text: Column) -> Column:
    """Characters before the body, which follows the first chapter heading's number; -1 without one."""
    head = F.regexp_substr(text, F.lit(CHAPTER_START))
    return F.when(head.isNull(), -1).otherwise(F.instr(text, head) - 1 + F.length(head))


def body(text: Column) -> Column:
    """The text after the first chapter heading's number; null without one."""
    parts = F.split(text, CHAPTER_START, 2)
    return F.when(F.size(parts) > 1, parts[1])
