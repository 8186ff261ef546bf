"""Fixed schemas and closed value domains of the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: the closed domains
VALIDITY_STATUS = ("con_hieu_luc", "het_hieu_luc", "het_hieu_luc_mot_phan", "chua_co_hieu_luc", "ngung_hieu_luc")
INDEX_SCOPE = ("full", "metadata_only")
ISSUING_SCOPE = ("national", "local")
NODE_TYPE = ("phan", "chuong", "muc", "tieu_muc", "dieu", "khoan", "diem", "phu_luc")
CONTENT_CLASS = ("normative", "template")
REFERENCE_TYPE = ("cites", "amends", "repeals", "corrects", "implements", "guides", "has_basis", "explains", "promulgates", "defines_term")
CHANGE_TYPE = ("replace", "suspend_execution", "suspend_effect")
EXTRACTION_METHOD = ("deterministic", "llm")


class Schema(str):
    """A schema as DDL text, which needs no session to be written down."""

    @property
    def names(self) -> list[str]:
        """The names of its columns."""
        flat, depth = [], 0
        for ch in self:
            depth += (ch == "<") - (ch == ">")
            flat.append(" " if depth and ch == "," else ch)
        return [part.split()[0] for part in "".join(flat).split(",")]

    def struct(self) -> T.StructType:
        return T.StructType.fromDDL(self)


struct = Schema


ISSUING_BODY = struct("id string, name string, name_en string, authority_rank int, scope string, parent_body_id string")
RAW_SOURCE = "struct<fullText:string, scrapedAt:string, sourceUrl:string, consolidatesRawTitles:array<string>, consolidatedIntoRawTitles:array<string>>"
DOCUMENT = struct(f"id string, citation_id string, title string, document_type string, issuing_body_id string, industry string, field string, signer_name string, signer_title string, enacted_date date, effective_date date, expiry_date date, gazette_published_date date, status string, index_scope string, is_consolidated boolean, consolidates_document_id string, raw_source {RAW_SOURCE}, content_version string, created_at timestamp, updated_at timestamp")
DOCUMENT_NODE = struct("id string, document_id string, parent_id string, node_type string, content_class string, path string, ordinal string, label string, heading string, text_content string, content_hash string, status string, valid_from date, valid_to date, superseded_by_node_id string, seq int")
DOCUMENT_REFERENCE = struct("id string, source_document_id string, target_document_id string, source_node_id string, target_node_id string, reference_type string, change_type string, raw_citation_text string, citation string, extraction_method string, confidence float, created_at timestamp")
DOCUMENT_SYNC_STATE = struct("document_id string, target string, synced_version string, status string, last_error string, updated_at timestamp")
RAW_PAGE = struct("sourceUrl string, scope string, title string, fullText string, attributes array<struct<label:string, value:string>>, relations array<struct<categoryLabel:string, entries:array<string>>>")
MANIFEST = struct("citation string, title string, date string, docUrl string, fileUrls array<string>, subdir string, folder string, filename string")
DOWNLOAD_LOG = struct("citation string, subdir string, filename string, http_code int, bytes long")
TREE_NODE = struct("seq int, parent_seq int, node_type string, ordinal string, label string, heading string, text_content string, content_class string")


def in_domain(column: Column, domain: tuple[str, ...], nullable: bool = False) -> Column:
    """True where the value is allowed."""
    ok = column.isin(*domain)
    return F.coalesce(ok, F.lit(nullable))


def checked(column: Column, domain: tuple[str, ...], what: str) -> Column:
    """The value; a value outside the domain fails the query. Null passes."""
    bad = F.raise_error(F.concat(F.lit(f"unknown {what}: "), column))
    return F.when(column.isNull() | column.isin(*domain), column).otherwise(bad)
