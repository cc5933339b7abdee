"""Files as seen from stored points and from the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import optional
from siltworks.operators.store import latest

# Registry states.
BUSY, GONE = ("queued", "processing", "failed", "deleting", "delete_failed"), ("deleted",)


def by_file(points: DataFrame, key: str, order: str, at: str, carry: list[str], active: str | None = None) -> DataFrame:
    """One row for each file: key, rows, first-seen values of ``carry`` by ``order``, last ``at``.

    ``key``, ``order`` and ``at`` are columns; ``active``: a boolean column, whose false rows do not count. Rows with a
    blank key are left out. Aggregated before the shuffle, so a file of any size costs one row a task.
    """
    rows = points.withColumn("_key", optional(F.col(key).cast("string"))).where("_key is not null")
    rows = rows.where(F.col(active)) if active else rows
    first = [F.min_by(c, order).alias(c) for c in carry]
    return rows.groupBy(F.col("_key").alias("file_key")).agg(F.count("*").alias("chunk_count"), *first, F.max(at).alias("completed_at"))


def newest_first(files: DataFrame, *times: str, key: str = "file_key") -> DataFrame:
    """Sorted by the first known time, latest first, then by key."""
    return files.orderBy(F.coalesce(*(F.nullif(F.col(t).cast("string"), F.lit("")) for t in times), F.lit("")).desc(), key)


def in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """(``key``, first): the distinct values of ``key`` that are not blank with the ``order`` at which each first stands."""
    rows = df.select(optional(F.col(key).cast("string")).alias(key), F.col(order).alias("first")).where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.min("first").alias("first"))


def registry_state(registry: DataFrame, key: str = "file_id", time: str = "updated_at", tie: str = "registry_id") -> DataFrame:
    """The last state of each registered file; rows without a key are left out."""
    return latest(registry.where(F.col(key).isNotNull()), key, time, tie)


def merged_listing(files: DataFrame, state: DataFrame) -> DataFrame:
    """(file_key, origin, status, chunk_count): files of the store and of the registry, the registry first.

    A registered file is listed by its registry row, unless that says it is deleted or active; active ones, and files the
    registry does not know, are listed by their points.
    """
    reg = state.select(F.col("file_id").alias("file_key"), "status").where(~F.col("status").isin("active", *GONE))
    a = reg.join(files.select("file_key", "chunk_count"), "file_key", "left").select("file_key", F.lit("registry").alias("origin"), "status", "chunk_count")
    b = files.join(reg, "file_key", "left_anti").select("file_key", F.lit("points").alias("origin"), F.lit("active").alias("status"), "chunk_count")
    return a.unionByName(b)


def status(files: DataFrame, state: DataFrame) -> DataFrame:
    """(file_key, status, chunk_count): the registry decides while a file is busy, else the points do."""
    reg = state.select(F.col("file_id").alias("file_key"), F.col("status").alias("said"))
    both = files.select("file_key", "chunk_count").join(reg, "file_key", "full_outer")
    out = F.when(F.col("said").isin(*BUSY), F.col("said")).when(F.col("chunk_count") > 0, "active").otherwise(F.coalesce("said", F.lit("unknown")))
    return both.select("file_key", out.alias("status"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
