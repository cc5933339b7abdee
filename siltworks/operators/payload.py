"""Payloads of stored points and their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltworks.functions.text import optional, strip, truth

# Parts of names whose values are never stored; chunking settings that are.
SECRET = "password|secret|token|api_key|apikey|private_key|access_key|credential|dsn"
SETTINGS = ("chunking_type", "chunkSize", "chunkOverlap", "delimiter", "max_buffer_size", "breakpoint_threshold")


def redacted(m: Column) -> Column:
    """A map with the values of secret keys replaced."""
    return F.transform_values(m, lambda k, v: F.when(F.lower(strip(k)).rlike(SECRET), F.lit("[REDACTED]")).otherwise(v))


def kept(m: Column, keys: tuple[str, ...] = SETTINGS) -> Column:
    """A map with the named keys only."""
    return F.map_filter(m, lambda k, v: k.isin(*keys))


def first_of(*options: Column) -> Column:
    """The first option that is not blank."""
    return F.coalesce(*(optional(o.cast("string")) for o in options))


def source_type(explicit: Column, url: Column, path: Column) -> Column:
    """The kind of a source: as said, else by its URL, cloud prefix or path."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.coalesce(
        optional(explicit),
        F.when(low.rlike(r"^\s*https?://"), F.lit("website")),
        F.when(low.rlike(r"^\s*(?:jdbc:|postgres|mysql|mssql|oracle|mongodb)"), F.lit("database")),
        F.when(low.rlike(r"^\s*(?:s3|gs|azure|abfss?|wasbs?)://"), F.lit("cloud")),
        F.when(optional(path).isNotNull(), F.lit("file")),
        F.lit("unknown"),
    )


def point_payload(chunk_id: Column, index: Column, text: Column, file_id: Column, active: Column, details: Column, settings: Column) -> Column:
    """The payload of a stored point."""
    return F.struct(
        chunk_id.alias("chunk_id"),
        F.coalesce(index, F.lit(0)).alias("chunk_index"),
        F.length(F.coalesce(text, F.lit(""))).alias("char_count"),
        F.coalesce(text, F.lit("")).alias("text"),
        optional(file_id).alias("file_id"),
        truth(active).alias("isActive"),
        kept(settings).alias("chunking_details"),
        redacted(details).alias("source_details"),
    )
