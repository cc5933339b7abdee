"""Lines and figures of pages: placeholders, zones, guards, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Media types by suffix.
MEDIA = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp"}


def media_type(suffix: Column) -> Column:
    """The media type of an image suffix; JPEG for others."""
    out = F.lit("image/jpeg")
    for s, m in MEDIA.items():
        out = F.when(F.lower(suffix) == s, m).otherwise(out)
    return out


def filled(rows: DataFrame, by: str, order: str, text: str, is_gap: Column, fillers: DataFrame, filler: str, filler_order: str) -> DataFrame:
    """``rows`` with the n-th gap of each ``by`` replaced by its n-th filler; gaps without one are dropped.

    Only gaps are numbered and shuffled; the other rows, with their texts, stay where they are. Gaps of a null ``by`` are dropped.
    """
    n = F.row_number().over(Window.partitionBy(by).orderBy(filler_order))
    f = fillers.select(by, F.col(filler).alias("_f"), n.alias("_n"))
    gap = F.coalesce(is_gap, F.lit(False))
    own = rows.where(gap).withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    met = own.join(f.where("_f is not null"), [by, "_n"]).withColumn(text, F.col("_f"))
    return rows.where(~gap).unionByName(met.select(*rows.columns))


def in_zone(y: Column, header_below: Column, footer_above: Column) -> Column:
    """``header``, ``footer`` or ``body`` by the zones' edges; an edge that is not known bounds nothing."""
    return F.when(y <= header_below, "header").when(y >= footer_above, "footer").otherwise("body")


def guarded(docs: DataFrame, size: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows within a size and those beyond it, with the reason."""
    over = F.coalesce(size > most, F.lit(False))
    return docs.where(~over), docs.where(over).withColumn("error", F.concat(F.lit("too large: "), size.cast("string")))


def cache_stats(asked: DataFrame, known: DataFrame, key: Column) -> DataFrame:
    """One row (hits, misses, hit_rate): how many rows asked for have a key that is known. Null keys are misses."""
    k = known.select(key.alias("_k")).where("_k is not null").distinct().withColumn("_hit", F.lit(1))
    one = asked.select(key.alias("_k")).join(k, "_k", "left").agg(F.count("_hit").alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"))
    return one.withColumn("hit_rate", F.round(F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)), 3))


def empty_reason(points: DataFrame, by: str, active: Column) -> DataFrame:
    """(by, active, total, reason): why a search over each group may have found nothing."""
    one = points.groupBy(by).agg(F.count_if(active).alias("active"), F.count("*").alias("total"))
    return one.withColumn("reason", F.when(F.col("active") > 0, "no match").otherwise("all inactive"))


def summary(results: Column, keep: tuple[str, ...], most: int = 5) -> Column:
    """A struct cut to its named fields; arrays among them to their first ``most`` values."""
    return F.struct(*(F.slice(results[k], 1, most).alias(k) if k in ("errors", "warnings") else results[k].alias(k) for k in keep))


def header_map(entries: Column) -> Column:
    """array<struct<key, value>> as a map without blank keys and values; of a repeated key the last stays."""
    ok = F.filter(entries, lambda e: (F.trim(F.coalesce(e["key"], F.lit(""))) != "") & (F.trim(F.coalesce(e["value"], F.lit(""))) != ""))
    last = F.filter(ok, lambda e, i: ~F.exists(F.slice(ok, i + 2, F.size(ok)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)
