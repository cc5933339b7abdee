"""Deterministic ids as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltworks.functions.text import strip

URL, DNS = uuid.NAMESPACE_URL.hex, uuid.NAMESPACE_DNS.hex

# The metadata that make up the scope of a chunk id, in this order.
SCOPE = (
    "knowledge_base_id", "kb_id", "job_id", "source_mapping_id", "source_type_name", "provider_name", "source", "file_id", "storage_path",
    "s3_key", "gcs_blob", "azure_blob", "folder_path", "zip_archive", "zip_entry_name", "archive_chain", "filename",
)


def uuid5(name: Column, namespace: str = URL) -> Column:
    """UUID version 5 of a name; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def scope(columns: dict[str, Column]) -> Column:
    """The given metadata in the order of SCOPE, blank ones skipped."""
    parts = [F.nullif(columns[k].cast("string"), F.lit("")) for k in SCOPE if k in columns]
    return F.concat_ws("|", *parts) if parts else F.lit("")


def chunk_id(text: Column, index: Column, kind: Column, scope_text: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of scope, start of the text, its length, index and kind."""
    seed = F.concat_ws("|", scope_text, strip(F.substring(text, 1, 100)), F.length(text).cast("string"), index.cast("string"), kind)
    return F.substring(F.sha2(seed, 256), 1, 16)


def point_id(chunk: Column) -> Column:
    """The key of a stored point."""
    return uuid5(chunk, URL)


def row_id(*parts: Column) -> Column:
    """The id of a table row: file, sheet or table, and number joined by ``::``."""
    return uuid5(F.concat_ws("::", *(p.cast("string") for p in parts)), DNS)


def seeded_id(*parts: Column) -> Column:
    """The id of a file or site made of its non-blank parts."""
    return uuid5(F.concat_ws("|", *(F.nullif(strip(p.cast("string")), F.lit("")) for p in parts)), DNS)
