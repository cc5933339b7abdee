"""JSON, JSON lines and HTML files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import jsonops, markup


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw, record, error) of the lines that are not blank of JSON lines files; a line that is no JSON has an error and no record.

    Files are split like any text file, so one large file is read by many tasks.
    """
    return checked(spark.read.text(path).where(F.col("value").rlike(r"(?U)\S")).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")))


def checked(raw: DataFrame) -> DataFrame:
    """(path, raw, record, error) of (path, raw): what is no JSON, null too, has an error and no record."""
    good = F.try_parse_json("raw").isNotNull()
    return raw.select("path", "raw", F.when(good, F.col("raw")).alias("record"), F.when(~good, "no JSON").alias("error"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, entry, name, record, error): the records of whole JSON files, unwrapped from a known envelope, numbered from 1 in each file.

    A file that is no JSON gives one row with an error; an empty one or an empty list gives none.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("raw")).where("raw <> ''")
    good = raw.where(F.try_parse_json("raw").isNotNull())
    own = good.select("path", F.posexplode(jsonops.records(F.col("raw"))).alias("at", "record"))
    own = own.select("path", (F.col("at") + 1).alias("entry"), jsonops.display_name(F.col("record"), F.col("at") + 1).alias("name"), "record", F.lit(None).cast("string").alias("error"))
    bad = raw.where(F.try_parse_json("raw").isNull()).select("path", F.lit(None).cast("int").alias("entry"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("record"), F.lit("no JSON").alias("error"))
    return own.unionByName(bad)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, headings, links, markdown) of HTML files; blank files have an empty title and no headings or links."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    html = F.col("html")
    return raw.select("path", markup.title(html).alias("title"), markup.headings(html).alias("headings"), markup.links(html).alias("links"), markup.to_markdown(html).alias("markdown"))


def stats(entries: DataFrame, by: str = "path") -> DataFrame:
    """(``by``, entries, errors, rate): the entries of each file, those that could not be read, and the share in percent that could."""
    one = entries.groupBy(by).agg(F.count("*").alias("entries"), F.count("error").alias("errors"))
    return one.withColumn("rate", F.round((F.col("entries") - F.col("errors")) * 100 / F.col("entries"), 1))
