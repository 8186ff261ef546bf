"""The scalar library as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexmill.functions import text
from lexmill.functions.citations import NUMBER_WORD, TYPE_WORDS


def register(spark: SparkSession) -> None:
    """Temporary SQL functions: citation_from_title, normalize_citation, fold_diacritics, slugify, roman_to_arabic.

    They are SQL expressions, so plans see through them."""
    types = "|".join(w.replace(" ", r"\s+") for w in TYPE_WORDS)
    prefix = rf"(?iuU)^(?:(?:{types})?\s*{NUMBER_WORD}(?:\s+hiệu)?\s*:?\s*)+"
    trim = lambda x: rf"regexp_replace({x}, r'(?U)^\s+|\s+$', '')"
    fold = lambda x: rf"translate(regexp_replace({x}, r'\p{{Mn}}+', ''), '{text._FROM}', '{text._TO}')"
    digits = "filter(split(upper(x), ''), ch -> ch <> '')"
    table = "map(" + ", ".join(f"'{k}', {v}" for k, v in text.ROMAN.items()) + ")"
    bodies = {
        "citation_from_title": rf"nullif(regexp_extract(x, r'(?iuU){NUMBER_WORD}\s+((?=[A-ZĐ/-]*\d)[0-9A-ZĐ][0-9A-ZĐ/-]*[0-9A-ZĐ])', 1), '')",
        "normalize_citation": f"coalesce(nullif({trim(f'''regexp_replace({trim('x')}, r'{prefix}', '')''')}, ''), {trim('x')})",
        "fold_diacritics": fold("x"),
        "slugify": f"regexp_replace(substring(regexp_replace(regexp_replace(lower({fold('x')}), '[^a-z0-9]+', '-'), '^-+|-+$', ''), 1, 80), '-+$', '')",
        "roman_to_arabic": f"case when upper(x) rlike '^[IVXLCDM]+$' then cast(aggregate(zip_with(transform({digits}, c -> try_element_at({table}, c)), concat(slice(transform({digits}, c -> try_element_at({table}, c)), 2, 1000000), array(0)), (a, b) -> if(a < b, -a, a)), 0, (s, v) -> s + v) as string) else x end",
    }
    for name, sql in bodies.items():
        spark.sql(f"create or replace temporary function {name}(x string) returns string return {sql}")
