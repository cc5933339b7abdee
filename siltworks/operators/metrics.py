"""Counts of jobs and of extractors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def job(chunks: DataFrame, file: str, text: str, failed: Column) -> DataFrame:
    """One row: files, chunks, characters, bytes, failures and the status that follows: success if anything was stored."""
    ok = ~failed
    one = chunks.agg(
        F.count_distinct(file).alias("files"),
        F.count_if(ok).alias("chunks"),
        F.coalesce(F.sum(F.when(ok, F.length(text))), F.lit(0)).alias("chars"),
        F.coalesce(F.sum(F.when(ok, F.octet_length(text))), F.lit(0)).alias("bytes"),
        F.count_if(failed).alias("failures"),
    )
    return one.withColumn("status", F.when(F.col("chunks") > 0, "success").otherwise("FAILED"))


def batches(items: DataFrame, batch: str, failed: Column) -> DataFrame:
    """(batch, succeeded, failed, status) of each batch."""
    one = items.groupBy(batch).agg(F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"))
    return one.withColumn("status", F.when(F.col("failed") == 0, "success").when(F.col("succeeded") > 0, "partial_success").otherwise("FAILED"))


def shares(df: DataFrame, by: str, digits: int = 1) -> DataFrame:
    """(by, n, rate): how often each value stands and its share in percent."""
    one = df.groupBy(by).agg(F.count("*").alias("n"))
    # the window runs over one row a value
    return one.select(by, "n", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(0))), digits).alias("rate"))


def sheets(df: DataFrame, sheet: str, value: str) -> DataFrame:
    """Rows and non-blank values of each sheet and, with a null name, of all."""
    return df.rollup(sheet).agg(F.count("*").alias("rows"), F.count(value).alias("values"))
