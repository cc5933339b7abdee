"""Rows and the rows before them, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, key: str, order: list[str], cols: list[str], bucket: Column, name: str = "previous") -> DataFrame:
    """``df`` with a struct of ``cols`` of the row before in the same ``key``, null for the first.

    ``bucket`` cuts a key into pieces and must grow with the order (nulls first). Only a piece is sorted in one task, and one
    row of each piece is handed on to the next, so a key that holds a third of all rows is spread over its pieces.
    """
    rows = df.withColumn("_b", F.coalesce(bucket.cast("long"), F.lit(-1)))
    at = Window.partitionBy(key, "_b").orderBy(*order)
    own = rows.withColumn("_p", F.lag(F.struct(*cols)).over(at)).withColumn("_r", F.row_number().over(at))
    last = rows.groupBy(key, "_b").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    carry = last.select(key, "_b", F.lag("_last").over(Window.partitionBy(key).orderBy("_b")).alias("_carry"))
    out = own.join(carry, [key, "_b"], "left")
    return out.withColumn(name, F.when(F.col("_r") == 1, F.col("_carry")).otherwise(F.col("_p"))).drop("_b", "_p", "_r", "_carry")
