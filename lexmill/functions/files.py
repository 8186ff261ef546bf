"""Media types and download headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: media types by ending
MEDIA_TYPES = {".pdf": "application/pdf", ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
OTHER_MEDIA = "application/octet-stream"


def media_type(name: Column) -> Column:
    ending = F.lower(F.regexp_extract(name, r"[^/.](\.[^./]*)$", 1))
    table = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, ending), F.lit(OTHER_MEDIA))


def content_disposition(name: Column) -> Column:
    """RFC 5987: an ASCII stand-in and the name in UTF-8."""
    plain = F.regexp_replace(name, r"[^\x20-\x7E]", "_")
    coded = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit('attachment; filename="'), plain, F.lit("\"; filename*=UTF-8''"), coded)
