"""Structure-aware chunking of documents.

A document is read into units (headings, code blocks, lists, paragraphs), units are folded into chunks by token budget
and word overlap, oversized ones are cut at sentences, and tiny chunks join their successor. The fold carries state from
unit to unit, so it runs as one Arrow-batched function over documents; one document is one row, so it is spread by rows.
Everything around it (ids, counts, numbering) is columns.

Null, empty and blank texts have no chunks. Tokens are counted by the offline estimate, four characters each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions import ids, text

HEADING = re.compile(r"#{1,6}\s+.+")
LIST_LINE = re.compile(r"\s*(?:[-*+]|\d+\.)\s+.+")
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
WORD = re.compile(r"\b\w{4,}\b")
SCHEMA = "array<struct<chunk_index: int, chunk_type: string, id_index: int, text: string>>"


@dataclass(frozen=True)
class Settings:
    """Sizes in tokens. ``most_parts`` counts the parts of a chunk; ``alike`` is the word overlap that keeps parts together."""

    target: int = 1024
    overlap: int = 50
    most_parts: int = 3
    alike: float = 0.5

    @property
    def least(self) -> int:
        return max(10, self.target // 6)


def tokens(s: str) -> int:
    return max(1, len(s) // 4) if s else 0


def alike(a: str, b: str, share: float) -> bool:
    x, y = set(WORD.findall(a.lower())), set(WORD.findall(b.lower()))
    return bool(x and y) and len(x & y) / len(x | y) >= share


def units(s: str) -> list[tuple[str, str]]:
    """(kind, text) of a text's headings, code blocks, lists and paragraphs."""
    out: list[tuple[str, str]] = []
    kind, held = "paragraph", ""

    def close() -> None:
        nonlocal held
        if held.strip():
            out.append((kind, held.strip()))
        held = ""

    lines = iter(s.split("\n"))
    for raw in lines:
        line = raw.rstrip()
        if HEADING.fullmatch(line):
            close()
            out.append(("heading", line.strip()))
            kind = "paragraph"
        elif line.strip().startswith("```"):
            close()
            block = [line]
            for inner in lines:
                block.append(inner)
                if inner.strip().startswith("```"):
                    break
            out.append(("code_block", "\n".join(block).strip()))
        elif LIST_LINE.fullmatch(line):
            if kind != "list":
                close()
            kind, held = "list", held + line + "\n"
        elif not line.strip():
            close()
            kind = "paragraph"
        else:
            if kind != "paragraph":
                close()
                kind = "paragraph"
            held += line + " "
    close()
    return out


def cut(s: str, most: int, overlap: int) -> list[str]:
    """Pieces of at most ``most`` tokens: whole sentences packed greedily, windows of a sentence that is too long."""
    if tokens(s) <= most:
        return [s]
    parts = [p for p in (x.strip() for x in SENTENCE.split(s)) if p]
    if len(parts) < 2:
        return windows(s, most, overlap)
    out: list[str] = []
    held: list[str] = []
    count = 0
    for p in parts:
        n = tokens(p)
        if held and (n > most or count + n > most):
            out.append(" ".join(held))
            held, count = [], 0
        if n > most:
            out += windows(p, most, overlap)
        else:
            held.append(p)
            count += n
    return [*out, " ".join(held)] if held else out


def windows(s: str, most: int, overlap: int) -> list[str]:
    """Windows of ``most`` tokens that overlap; a last one that is tiny joins the one before."""
    size, least = 4 * most, 4 * max(10, most // 6)
    at = list(range(0, len(s), max(1, size - 4 * min(overlap, most - 1))))
    ends = [p + size for p in at]
    if len(at) > 1 and len(s) - at[-1] < least:
        at.pop()
        ends.pop()
        ends[-1] = len(s)
    return [x for x in (s[p:e].strip() for p, e in zip(at, ends, strict=True)) if x]


def tail(s: str, most: int) -> str:
    """The last words whose tokens add up to at most ``most``."""
    kept: list[str] = []
    for w in reversed(s.split()):
        most -= tokens(w)
        if most < 0:
            break
        kept.append(w)
    return " ".join(reversed(kept))


@dataclass
class Fold:
    """The state between units: parts of the chunk in hand, a short heading waiting for its paragraph, the last overlap."""

    set: Settings
    done: list[tuple[str, str]] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    waiting: str = ""
    overlap: str = ""

    def emit(self, s: str, kind: str) -> None:
        pieces = cut(s.strip(), self.set.target, self.set.overlap) if s.strip() else []
        self.done += [(kind, p) for p in pieces]
        if pieces:
            self.overlap = tail(pieces[-1], self.set.overlap)

    def flush(self) -> None:
        if self.parts:
            self.emit(" ".join(self.parts), "semantic")
        self.parts = []

    def with_waiting(self, s: str) -> str:
        out, self.waiting = f"{self.waiting} {s}".strip(), ""
        return out

    def structure(self, kind: str, s: str) -> None:
        self.flush()
        if tokens(s) >= self.set.least:
            self.emit(self.with_waiting(s), kind)
        else:
            self.waiting = f"{self.waiting} {s}".strip()

    def paragraph(self, s: str) -> None:
        n = tokens(s)
        if n > self.set.target:
            self.flush()
            self.emit(self.with_waiting(s), "semantic")
            return
        if not self.parts:
            start = self.with_waiting(self.overlap) if self.waiting else self.overlap
            self.parts = [start] if start else []
        held = " ".join(self.parts)
        fits = sum(map(tokens, self.parts)) + n <= self.set.target and len(self.parts) < self.set.most_parts
        if not (fits and (not self.parts or alike(held, s, self.set.alike))):
            self.flush()
            self.parts = [self.overlap] if self.overlap else []
        self.parts.append(s)

    def close(self) -> list[tuple[str, str]]:
        if self.waiting:
            self.parts.append(self.with_waiting(""))
        self.flush()
        return self.done


def merged(chunks: list[tuple[int, str, str]], least: int, most: int) -> list[tuple[int, str, str]]:
    """(id_index, kind, text): a tiny chunk joins the next one if both fit, once; a tiny last one joins the one before."""
    join = lambda a, b: f"{a[2]} {b[2]}"
    fits = lambda a, b: tokens(a[2]) + tokens(b[2]) <= most
    out: list[tuple[int, str, str]] = []
    k = 0
    while k < len(chunks):
        a, b = chunks[k], chunks[k + 1] if k + 1 < len(chunks) else None
        if b and tokens(a[2]) < least and fits(a, b):
            out.append((len(out) + 1, "semantic_merged", join(a, b)))
            k += 2
        else:
            out.append(a)
            k += 1
    if len(out) > 1 and tokens(out[-1][2]) < least and fits(out[-2], out[-1]):
        out[-2:] = [(len(out) - 1, "semantic_merged", join(out[-2], out[-1]))]
    return out


def chunk_text(s: str | None, conf: Settings) -> list[dict]:
    """The chunks of one text. ``id_index`` is the place a chunk had before tiny ones were joined; ids are made of it."""
    if not s or not s.strip():
        return []
    fold = Fold(conf)
    for kind, u in units(s):
        if kind == "paragraph":
            fold.paragraph(u)
        else:
            fold.structure(kind, u)
    numbered = [(i, k, t) for i, (k, t) in enumerate(fold.close(), 1)]
    return [{"chunk_index": n, "chunk_type": k, "id_index": i, "text": t} for n, (i, k, t) in enumerate(merged(numbered, conf.least, conf.target), 1)]


def chunk(docs: DataFrame, key: str, body: str = "text", conf: Settings | None = None, delimiter: str | None = None, scope: dict | None = None) -> DataFrame:
    """One row for each chunk: ``key``, chunk_index, chunk_type, chunk_id, text, char_count, token_count, page_number.

    ``delimiter`` cuts a document into segments first; numbers run on over them. ``scope``: metadata columns for the ids.
    """
    conf = conf or Settings()

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, c["chunk_index"], c["chunk_type"], c["id_index"], c["text"], sc, seg) for i, t, sc, seg in zip(b["k"], b["t"], b["scope"], b["seg"], strict=True) for c in chunk_text(t, conf)]
            yield pd.DataFrame(rows, columns=["k", "chunk_index", "chunk_type", "id_index", "text", "scope", "seg"])

    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("k"), F.col(body).alias("t"), ids.scope(scope or {}).alias("scope"))
    src = src.select("k", "scope", F.posexplode(text.delimited(F.col("t"), delimiter)).alias("seg", "t")) if delimiter else src.withColumn("seg", F.lit(0))
    out = src.select("k", "t", "scope", "seg").mapInPandas(over, f"k {kind}, chunk_index int, chunk_type string, id_index int, text string, scope string, seg int")
    out = out.withColumn("chunk_id", ids.chunk_id(F.col("text"), F.col("id_index"), F.col("chunk_type"), F.col("scope")))
    if delimiter:
        out = out.withColumn("chunk_index", F.row_number().over(Window.partitionBy("k").orderBy("seg", "chunk_index")))
    return out.select(
        F.col("k").alias(key), "chunk_index", "chunk_type", "chunk_id", "text", F.length("text").alias("char_count"), text.token_count(F.col("text")).alias("token_count"), text.page_number(F.col("text")).alias("page_number")
    )


def packed_sentences(docs: DataFrame, key: str, body: str, most: int) -> DataFrame:
    """(``key``, piece, tokens): sentences packed greedily into pieces of at most ``most`` tokens, as a fold in the JVM."""
    zero = F.struct(F.array().cast("array<struct<piece: int, tokens: int>>").alias("out"), F.lit(0).alias("piece"), F.lit(0).alias("n"))

    def step(acc, s):  # noqa: ANN001, ANN202
        n = text.token_count(s)
        fits = (acc["n"] == 0) | (acc["n"] + n <= most)
        return F.struct(
            F.when(fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["piece"].alias("piece"), acc["n"].alias("tokens"))))).alias("out"),
            F.when(fits, acc["piece"]).otherwise(acc["piece"] + 1).alias("piece"),
            F.when(fits, acc["n"] + n).otherwise(n).alias("n"),
        )

    done = F.aggregate(text.sentences(F.col(body)), zero, step, lambda a: F.when(a["n"] > 0, F.concat(a["out"], F.array(F.struct(a["piece"].alias("piece"), a["n"].alias("tokens"))))).otherwise(a["out"]))
    return docs.select(F.col(key), F.explode(done).alias("p")).select(key, "p.piece", "p.tokens")


def globally_numbered(chunks: DataFrame, order: list[str], name: str = "global_index", parts: int | None = None) -> DataFrame:
    """0-based numbers over all rows in the given order, without sorting them in one task.

    Rows are range-partitioned by the order, numbered within their partition and moved on by the rows before it; only one
    count a partition goes through the driver.
    """
    from siltworks.session import stored

    spark = chunks.sparkSession
    ranged = chunks.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # sorted within partitions, so the id's low bits are the place in the partition and its high bits the partition
    flat = stored(ranged.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    place = flat.withColumn("_p", F.shiftright("_id", 33)).withColumn("_k", F.col("_id").bitwiseAND((1 << 33) - 1))
    counts = sorted((r["_p"], r["n"]) for r in place.groupBy("_p").agg(F.count("*").alias("n")).collect())
    base, at = {}, 0
    for p, n in counts:
        base[p], at = at, at + n
    before = F.create_map(*(F.lit(x) for pair in base.items() for x in pair)) if base else F.create_map(F.lit(0), F.lit(0))
    return place.withColumn(name, (before[F.col("_p")] + F.col("_k")).cast("long")).drop("_id", "_p", "_k")
