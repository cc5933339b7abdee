"""Rows of tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions import ids
from siltworks.functions.text import strip, word_tokens

# What stands for no value in a sheet.
NOTHING = ("", "nan", "none", "nat", "<na>", "n/a", "null", "na")


def cell(c: Column) -> Column:
    """A sheet's cell, stripped; null if it stands for no value."""
    s = strip(c.cast("string"))
    return F.when(~F.lower(s).isin(*NOTHING), s)


def cleaned(df: DataFrame, columns: list[str], least: int = 2) -> DataFrame:
    """Cells cleaned; rows with fewer than ``least`` values dropped."""
    out = df.withColumns({c: cell(F.col(c)) for c in columns})
    return out.where(sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) >= least)


def as_text(columns: list[str], number: Column, sheet: str | None = None) -> Column:
    """``Row n: a: x | b: y`` without blank cells; with a sheet its name first and without unnamed columns."""
    named = [c for c in columns if not (sheet and c.startswith("Unnamed:"))]
    value = lambda c: cell(F.col(c)) if sheet else F.nullif(strip(F.col(c).cast("string")), F.lit(""))
    parts = F.concat_ws(" | ", *(F.concat(F.lit(f"{c}: "), value(c)) for c in named))
    body = F.when(parts == "", "(empty row)").otherwise(parts)
    head = F.concat(F.lit(f"Sheet: {sheet} | Row " if sheet else "Row "), number.cast("string"), F.lit(": "))
    return F.concat(head, body)


def numbered(df: DataFrame, order: str, by: str) -> DataFrame:
    """1-based ``row_number`` within ``by`` in the given order."""
    return df.withColumn("row_number", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def from_table(df: DataFrame, columns: list[str], key: str, source: str) -> DataFrame:
    """(row_id, text, tokens) of the rows of any table, one read over JDBC too; tokens are the words between white space."""
    body = as_text(columns, F.col(key))
    return df.select(ids.row_id(F.lit(source), F.lit("row"), F.col(key)).alias("row_id"), body.alias("text"), word_tokens(body).cast("int").alias("tokens"))
