"""Evaluation texts leaking into training text (problem 7).

Size-partitioned MinHash containment search. Items fall into partitions by their number of words (``run`` and more in
one). For each partition every document is read as overlapping windows of that many words, and each window is
described by the minima of two hash orders over its word shingles. A document that holds a whole run of an item holds a
window with the very same shingles, so their minima agree and no leak is missed; the agreeing pairs are then verified by
exact containment of the run.

Nulls and texts without words never leak and never contain anything. Repeated rows are each reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm import words as W
from siltworks.session import small, stored

SHINGLE = 3
SEED = 71


def _minima(h: np.ndarray, size: int) -> np.ndarray:
    """One key for each window of ``size`` words over the flat words of a batch: its size and its two shingle minima."""
    k = min(SHINGLE, size)
    s = W.shingles(h, k)
    span = size - k + 1
    n = max(0, len(s) - span + 1)
    keys = np.full(n, size, np.uint64)
    for m in W.multipliers(2, SEED):
        v = s * m
        low = v[:n].copy()
        for j in range(1, span):
            np.minimum(low, v[j : j + n], out=low)
        keys = W.mix(keys * np.uint64(31) + low)
    return keys


def _sketch(df: DataFrame, key: str, text: str, sizes: list[int], run: int | None) -> DataFrame:
    """(id, key) rows: the window keys of each text, of all sizes, or (``run`` given) of the text's own size up to ``run``."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, off = W.ragged(b.column(1))
            lens = np.diff(off)
            row = np.repeat(np.arange(len(lens)), lens)
            rows, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for size in sizes:
                k = _minima(h, size)
                first = row[: len(k)]
                whole = first == row[size - 1 : size - 1 + len(k)]  # windows that cross into the next text are none
                if run is not None:
                    whole &= np.minimum(lens, run)[first] == size
                rows.append(first[whole])
                keys.append(k[whole])
            r, k = np.concatenate(rows), np.concatenate(keys)
            order = np.lexsort((k, r))
            r, k = r[order], k[order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r[new])), pa.array(k[new].view(np.int64))], names=["id", "key"])

    src = df.select(F.col(key).cast("long").alias("id"), W.word_hashes(F.col(text)).alias("h"))
    return src.mapInArrow(over, "id long, key long")


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", run: int = 12) -> DataFrame:
    """Pairs (``doc_key``, ``item_key``): the document holds ``run`` words in a row of the item, or all words of a shorter item.

    The document side is scanned twice (windows, then verification of the candidates only) and its window keys meet the
    items' keys in a join that broadcasts the items only if their counted keys are small. Rows with a null id are left out.
    """
    it = items.where(F.col(item_key).isNotNull()).select(F.col(item_key), W.words(F.col(text)).alias("w")).where(F.size("w") > 0)
    sizes = sorted(r[0] for r in it.select(F.least(F.size("w"), F.lit(run))).distinct().collect())  # at most ``run`` numbers
    keys = stored(_sketch(items.where(F.col(item_key).isNotNull()), item_key, text, sizes, run), "item-keys")
    docs = docs.where(F.col(doc_key).isNotNull())
    found = _sketch(docs, doc_key, text, sizes, None).join(small(keys.withColumnRenamed("id", "item")), "key")
    cand = stored(found.select("id", "item").distinct(), "leak-candidates")

    size = F.least(F.size("w"), F.lit(run))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.concat(F.lit(" "), F.array_join(F.slice("w", i, size), " "), F.lit(" ")))
    runs = it.select(F.col(item_key).alias("item"), grams.alias("runs"))
    body = docs.select(F.col(doc_key).alias("id"), F.col(text).alias("t")).join(small(cand.select("id").distinct()), "id", "left_semi")
    body = body.select("id", F.concat(F.lit(" "), F.array_join(W.words(F.col("t")), " "), F.lit(" ")).alias("flat"))
    pairs = small(cand).join(body, "id").join(small(runs, 4096), "item")
    hit = pairs.where(F.exists("runs", lambda g: F.contains(F.col("flat"), g)))
    return hit.select(F.col("id").alias(doc_key), F.col("item").alias(item_key)).distinct()


def leaked_share(docs: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """For each item of each suite the number of documents that give it away; items without any are listed with 0."""
    n = leaks(docs, items, run=run).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "suite").join(n, "item_id", "left").fillna(0, ["documents"])
