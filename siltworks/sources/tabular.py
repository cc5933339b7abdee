"""CSV files, spreadsheets and Word documents.

CSV goes through Spark's reader. Office files are archives of XML and are read with the standard library, one file a row,
inside tasks.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import rows
from siltworks.session import stored

DELIMITERS = ",\t;|"


def sniffed(sample: str) -> str:
    """The delimiter of a CSV text's beginning; a comma if none is clear."""
    try:
        return csv.Sniffer().sniff(sample, DELIMITERS).delimiter
    except csv.Error:
        first = sample.split("\n", 1)[0]
        return max(DELIMITERS, key=first.count) if any(d in first for d in DELIMITERS) else ","


def read_csv(spark: SparkSession, path: str | list[str], delimiter: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """All columns as strings under the header row; quoted cells may hold line ends; missing cells are null.

    Without ``delimiter`` a tab for ``.tsv``, else what the first 4 KB of each file look like; files of several delimiters
    are read by delimiter and united by column name. Files without any content have no delimiter and no rows.
    """
    if delimiter is None:
        head = spark.read.format("binaryFile").load(path).where("length > 0").select("path", F.substring("content", 1, 4096).alias("head"))

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                kinds = ["\t" if p.lower().endswith(".tsv") else sniffed(bytes(h).decode(encoding, "ignore")) for p, h in zip(b["path"], b["head"], strict=True)]
                yield pd.DataFrame({"path": b["path"], "kind": kinds})

        kinds = stored(head.mapInPandas(look, "path string, kind string"), "delimiters")
        found = sorted(r.kind for r in kinds.select("kind").distinct().collect())  # at most one a delimiter
        if len(found) > 1:
            parts = [read_csv(spark, [r.path for r in kinds.where(F.col("kind") == k).select("path").toLocalIterator()], k, encoding) for k in found]
            return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
        delimiter = found[0] if found else ","
    return spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)


def rows_as_chunks(df: DataFrame, columns: list[str], number: str, file: str) -> DataFrame:
    """(row_id, chunk_index, text, chunk_type) of the rows of a table that has its row numbers."""
    from siltworks.functions import ids

    return df.select(ids.row_id(F.lit(file), F.lit("row"), F.col(number)).alias("row_id"), (F.col(number) - 1).cast("int").alias("chunk_index"), rows.as_text(columns, F.col(number)).alias("text"), F.lit("csv_row").alias("chunk_type"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(x.text or "" for x in si.iter() if _local(x.tag) == "t"))
        sheets = [x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"]
        parts = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2])[0]))
        target = {}
        if "xl/_rels/workbook.xml.rels" in z.namelist():
            for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
                t = x.get("Target", "")
                target[x.get("Id")] = t.lstrip("/") if t.startswith("/") else "xl/" + t
        for k, sheet in enumerate(sheets):
            # by the relationship that the sheet names; files without any have their sheets in order
            rel = next((v for a, v in sheet.attrib.items() if _local(a) == "id"), None)
            name, part = sheet.get("name", ""), target.get(rel) or (parts[k] if k < len(parts) else None)
            if part is None or part not in z.namelist():
                raise KeyError(f"sheet {name} has no part")
            table: list[list[str]] = []
            for row in (x for x in ElementTree.fromstring(z.read(part)).iter() if _local(x.tag) == "row"):
                cells: dict[int, str] = {}
                for k, c in enumerate(x for x in row if _local(x.tag) == "c"):
                    text = "".join(x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t"))
                    at = _column(c.get("r")) if c.get("r") else k
                    cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
                table.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            yield name, table


def read_sheets(files: DataFrame, least: int = 2) -> DataFrame:
    """(path, sheet, row_number, cells, error) of spreadsheet files (path, content): rows under the header as maps, cleaned.

    Rows with fewer than ``least`` values are dropped before they are numbered; a file that cannot be read gives one error row.
    """

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                out = []
                try:
                    for name, table in _sheets(bytes(c or b"")):
                        head = [h.strip() or f"Unnamed: {i}" for i, h in enumerate(table[0])] if table else []
                        n = 0
                        for r in table[1:]:
                            cells = {h: v.strip() for h, v in zip(head, r, strict=False) if v.strip().lower() not in rows.NOTHING}
                            if len(cells) >= least:
                                n += 1
                                out.append((p, name, n, cells, None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                    out = [(p, None, None, None, f"unreadable: {e}")]
                yield pd.DataFrame(out, columns=["path", "sheet", "row_number", "cells", "error"]).astype({"row_number": "Int64"})

    return files.select("path", "content").mapInPandas(over, "path string, sheet string, row_number long, cells map<string,string>, error string")


def sheet_text(sheets: DataFrame) -> DataFrame:
    """(path, sheet, row_number, text) of the rows of ``read_sheets``."""
    named = F.filter(F.array_sort(F.map_entries("cells")), lambda e: ~F.startswith(e["key"], F.lit("Unnamed:")))
    body = F.array_join(F.transform(named, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")
    head = F.concat(F.lit("Sheet: "), F.col("sheet"), F.lit(" | Row "), F.col("row_number").cast("string"), F.lit(": "))
    return sheets.where("error is null").select("path", "sheet", "row_number", F.concat(head, F.when(body == "", "(empty row)").otherwise(body)).alias("text"))


def _docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(x for x in ElementTree.fromstring(z.read("word/document.xml")) if _local(x.tag) == "body")
    text = lambda e: "".join(x.text or "" for x in e.iter() if _local(x.tag) == "t")
    paragraphs, tables = [], []
    for e in body:
        if _local(e.tag) == "p" and text(e).strip():
            style = next((v for x in e.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
            level = re.search(r"[Hh]eading\s*(\d*)", style)
            n = int(level[1]) if level and level[1] and 1 <= int(level[1]) <= 6 else 2
            paragraphs.append(f"{'#' * n} {text(e).strip()}" if level else text(e).strip())
        elif _local(e.tag) == "tbl":
            grid = [[" ".join(text(c).split()) for c in r if _local(c.tag) == "tc"] for r in e if _local(r.tag) == "tr"]
            width = max(map(len, grid), default=0)
            grid = [r + [""] * (width - len(r)) for r in grid]
            if width:
                lines = ["| " + " | ".join(r) + " |" for r in grid]
                tables.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
    return "\n\n".join(paragraphs + tables)


def _xml(data: bytes) -> str:
    out: list[str] = []

    def walk(e: ElementTree.Element, depth: int) -> None:
        text = " ".join((e.text or "").split())
        marks = "".join(f" {_local(k)}={v}" for k, v in e.attrib.items())
        out.append(f"{'  ' * depth}[{_local(e.tag)}{marks}]{' ' + text if text else ''}")
        for c in e:
            walk(c, depth + 1)
            if c.tail and c.tail.strip():
                out.append("  " * (depth + 1) + " ".join(c.tail.split()))

    walk(ElementTree.fromstring(data), 0)
    return "\n".join(out)


def _plain(data: bytes) -> str:
    for e in ("utf-8-sig", "utf-16"):
        if e == "utf-16" and data[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue
        try:
            return data.decode(e)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


READERS = {".docx": _docx, ".xml": _xml}


def read_texts(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """(path, text, error) of files (path, suffix, content) by a reader for each suffix, bytes to text; others as plain text.

    Blank results are null; a reader that fails gives an error, never a failed job. Readers for further kinds (PDF, images)
    are passed in.
    """
    by = READERS | (readers or {})

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, s, c in zip(b["path"], b["suffix"], b["content"], strict=True):
                try:
                    text = by.get(s, _plain)(bytes(c or b""))
                    out.append((p, text if text.strip() else None, None))
                except Exception as e:  # noqa: BLE001
                    out.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return files.select("path", "suffix", "content").mapInPandas(over, "path string, text string, error string")


def xml_counts(xml: Column) -> Column:
    """(elements, attributes) of an XML text; null for null."""
    n = lambda p: F.xpath_number(xml, F.lit(p)).cast("int")
    return F.when(xml.isNotNull(), F.struct(n("count(//*)").alias("elements"), n("count(//@*)").alias("attributes")))
