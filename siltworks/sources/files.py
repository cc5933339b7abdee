"""Files and archives as rows, and where each kind of file goes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import ids
from siltworks.functions.text import safe_path

# File kinds by suffix.
ROWS = (".csv", ".tsv", ".xlsx", ".xls", ".xlsm")
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")
PARSED = (".pdf", ".docx", ".html", ".htm", ".xml", ".json")
TEXTS = (".txt", ".md", ".log", ".jsonl", ".ndjson", ".yaml", ".yml", ".rst")
DEPTH = 5
MEMBER = "path string, member string, depth int, chain array<string>, content binary, error string"


def suffix(name: Column) -> Column:
    """The suffix in lower case with its dot; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1), F.lit("")))


def route(name: Column) -> Column:
    """The extractor of a file by its suffix; plain text for unknown ones."""
    x = suffix(name)
    return F.when(x.isin(*ROWS), "rows").when(x.isin(*IMAGES), "ocr").when(x == ".zip", "archive").when(x.isin(*PARSED), F.substring(x, 2, 9)).otherwise("text")


def junk(name: Column) -> Column:
    """Whether an archive member is a hidden file or made by a system."""
    return F.coalesce(name.rlike(r"(^|/)(__MACOSX|\.[^./])"), F.lit(False))


def fault(name: Column, size: Column, suffixes: tuple[str, ...]) -> Column:
    """Why a file cannot be read: no name, another suffix or no content; null if it can."""
    x = suffix(name)
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", "no name").when(~x.isin(*suffixes), F.concat(F.lit("unsupported: "), x)).when(F.coalesce(size, F.lit(0)) <= 0, "empty")


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, filename, suffix, route, size, modified, content, file_id) of the files below a path with a known suffix.

    Content is read only if it is used. The id is made of path, name, size and time, so a changed file is a new one.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    known = (*ROWS, *IMAGES, *PARSED, *TEXTS, ".zip")
    df = df.withColumn("filename", name).withColumn("suffix", suffix(F.col("filename"))).where(F.col("suffix").isin(*known))
    fid = ids.seeded_id(F.col("path"), F.col("filename"), F.col("length"), F.unix_micros("modificationTime"))
    return df.select("path", "filename", "suffix", route(F.col("filename")).alias("route"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content", fid.alias("file_id"))


def union(sources: dict[str, Callable[[], DataFrame]], spark: SparkSession) -> DataFrame:
    """All rows of several sources with ``source`` and ``error``, columns by name, missing ones null.

    A source that cannot be opened gives one row with its error; the others are read all the same.
    """
    out = None
    for name, opened in sources.items():
        try:
            own = opened()
            own = own.withColumn("source", F.lit(name))
            own = own if "error" in own.columns else own.withColumn("error", F.lit(None).cast("string"))
        except (PySparkException, ValueError, OSError) as e:
            own = spark.range(1).select(F.lit(name).alias("source"), F.lit(f"{type(e).__name__}: {str(e)[:200]}").alias("error"))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return spark.createDataFrame([], "source string, error string") if out is None else out


def _members(path: str, data: bytes, depth: int, chain: list[str]) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in sorted(z.infolist(), key=lambda i: i.filename):
                if info.is_dir():
                    continue
                if info.flag_bits & 1:
                    yield path, info.filename, depth, chain, None, "encrypted"
                    continue
                body = z.read(info)
                if info.filename.lower().endswith(".zip"):
                    if depth < DEPTH:
                        yield from _members(path, body, depth + 1, [*chain, info.filename])
                    else:
                        yield path, info.filename, depth, chain, None, "too deep"
                else:
                    yield path, info.filename, depth, chain, body, None
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
        yield path, None, depth, chain, None, f"no archive: {e}"


def members(archives: DataFrame) -> DataFrame:
    """The files in archives (path, content), nested ones too: member, depth, chain, content, error and a derived file_id.

    Junk and images are left out; a broken archive gives one row with an error. One archive is opened by one task.
    """

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                for row in _members(p, bytes(c or b""), 0, []):
                    yield pd.DataFrame([row], columns=["path", "member", "depth", "chain", "content", "error"])

    out = archives.select("path", "content").mapInPandas(over, MEMBER)
    out = out.where(F.col("member").isNull() | (~junk(F.col("member")) & ~suffix(F.col("member")).isin(*IMAGES)))
    scope = F.concat_ws("::", F.col("path"), F.array_join("chain", "/"), F.col("member"))
    return out.withColumn("member", safe_path(F.col("member"))).withColumn("file_id", ids.uuid5(scope, ids.DNS))


def archive_totals(found: DataFrame) -> DataFrame:
    """(path, members, bytes, supported, errors) of each archive."""
    known = suffix(F.col("member")).isin(*ROWS, *PARSED, *TEXTS)
    return found.groupBy("path").agg(F.count("member").alias("members"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("bytes"), F.count_if(known).alias("supported"), F.count("error").alias("errors"))
