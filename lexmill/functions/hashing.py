"""Content hashes and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined_sha256(*parts: Column) -> Column:
    """SHA-256 of the parts one after another without separators; null counts as empty."""
    return F.sha2(F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def content_version(full_text: Column, citation: Column, title: Column, status: Column, effective: Column, expiry: Column) -> Column:
    """Of a document, from its raw strings."""
    return joined_sha256(full_text, citation, title, status, effective, expiry)


def node_hash(label: Column, heading: Column, text: Column) -> Column:
    return joined_sha256(label, heading, text)


def stable_id(*parts: Column) -> Column:
    """An id from a natural key. Parts are kept apart, and null differs from empty."""
    marked = (F.coalesce(F.concat(F.lit("v"), p.cast("string")), F.lit("n")) for p in parts)
    return F.sha2(F.concat_ws("\x1f", *marked), 256)
