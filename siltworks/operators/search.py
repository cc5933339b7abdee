"""Filtered vector search over stored points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.text import strip


def compiled(tree: dict | None) -> Column:
    """A filter tree (must, should, must_not lists of {key, match: {value}}) as a predicate; nested keys with dots.

    must: all; should: at least one, if given; must_not: none. A match of null values is no match.
    """
    if not tree:
        return F.lit(True)

    def group(name: str) -> list[Column]:
        conditions = tree.get(name) or []
        conditions = conditions if isinstance(conditions, list) else [conditions]
        return [F.coalesce(F.col(c["key"]) == F.lit(c["match"]["value"]), F.lit(False)) for c in conditions]

    out = F.lit(True)
    for c in group("must"):
        out = out & c
    for c in group("must_not"):
        out = out & ~c
    any_of = None
    for c in group("should"):
        any_of = c if any_of is None else any_of | c
    return out if any_of is None else out & any_of


def required(tree: dict | None, *conditions: dict) -> dict:
    """A filter tree with further must conditions; one on the same key takes the place of the old one."""
    keys = {c["key"] for c in conditions}
    old = (tree or {}).get("must") or []
    old = old if isinstance(old, list) else [old]
    return {**(tree or {}), "must": [c for c in old if c["key"] not in keys] + list(conditions)}


def of_model(tree: dict | None, model: str) -> dict:
    """A filter tree that lets only points embedded by ``model`` through."""
    return required(tree, {"key": "embedding_details.embedding_model_name", "match": {"value": model}})


def best_texts(hits: DataFrame, by: str, text: str = "text", rank: str = "rank", most: int = 3) -> DataFrame:
    """The hits of the first ``most`` ranks that have a text: blank ones are dropped after the cut, so fewer may be left."""
    return hits.where(F.col(rank) <= most).where(strip(F.coalesce(F.col(text), F.lit(""))) != "").select(by, rank, text)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null if a length differs or a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot, norm(a) * norm(b)))


def top_k(points: DataFrame, query: list[float], k: int = 5, threshold: float | None = 0.35, where: dict | None = None, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The ``k`` points most alike to one vector, best first, ties by id. The sort is a bounded heap in each task."""
    hit = points.where(compiled(where)).withColumn("score", cosine(F.col(vec), F.array(*map(F.lit, map(float, query)))))
    hit = hit.where(F.col("score") >= threshold) if threshold is not None else hit.where("score is not null")
    return hit.orderBy(F.desc("score"), id_col).limit(k)


def top_k_batch(points: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.35, id_col: str = "vec_id", vec: str = "embedding", block: int = 1024) -> DataFrame:
    """(query_id, ``id_col``, score, rank): the ``k`` best points of each query, exact.

    Queries and points are packed into rows of about ``block`` vectors by hash; every pack of points goes to every block of
    queries by its number, where the two meet in one matrix product that keeps the ``k`` best of a pack for each query. So
    neither side passes the driver, the plan is the same for any number of queries, and what is ranked is at most k rows a
    query and pack. Vectors of another length than the query's, null vectors and null ids are never hits. ``queries``:
    (query_id, vector).
    """
    asked = queries.where("vector is not null and query_id is not null")
    kept = points.where(F.col(vec).isNotNull() & F.col(id_col).isNotNull())
    blocks, parts = (max(1, -(-df.count() // block)) for df in (asked, kept))
    left = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("_b")).agg(F.collect_list(F.struct(F.col("query_id").cast("long").alias("i"), F.col("vector").cast("array<double>").alias("v"))).alias("qs"))
    packs = kept.groupBy(F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(parts)).alias("_p")).agg(F.collect_list(F.struct(F.col(id_col).cast("long").alias("i"), F.col(vec).cast("array<double>").alias("v"))).alias("ps"))
    both = packs.select("ps", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b")).join(left, "_b")

    def unit(rows: list[dict], width: int) -> tuple[np.ndarray, np.ndarray]:
        own = [r for r in rows if len(r["v"]) == width]
        m = np.array([r["v"] for r in own], dtype=np.float64).reshape(len(own), width)
        return np.array([r["i"] for r in own], dtype=np.int64), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                qs, ps = b.column(0)[at].as_py(), b.column(1)[at].as_py()
                rows: list[tuple[int, int, float]] = []
                for width in {len(q["v"]) for q in qs}:
                    (ids, m), (own, x) = unit(qs, width), unit(ps, width)
                    s = m @ x.T
                    rows += [(int(ids[q]), int(own[p]), float(s[q, p])) for q in range(len(ids)) for p in np.lexsort((own, -s[q]))[:k] if s[q, p] >= threshold]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "i", "score"])

    out = both.select("qs", "ps").mapInArrow(over, "query_id long, i long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "i")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("i").alias(id_col), "score", "rank")


def context_lines(hits: DataFrame, by: str, text: str = "text", rank: str = "rank") -> DataFrame:
    """(``by``, context): the numbered, scored lines of each query's hits, in order. ``hits`` holds at most k rows a query."""
    line = F.format_string("[%d] (score %.4f) %s", F.col(rank), F.col("score"), strip(F.coalesce(F.col(text), F.lit(""))))
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("l"))))
    return hits.groupBy(by).agg(F.array_join(F.transform(rows, lambda x: x["l"]), "\n").alias("context"))


def hashed_embedding(df: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """(``key``, dense, sparse): unit vectors of hashed words, the offline stand-in for a model; sparse is always empty.

    Each row is worked out on its own, without a shuffle; rows that repeat a key stay apart. Null and empty texts have the zero vector.
    """
    w = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    spots = F.array_sort(F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(size)) * 2 + F.pmod(F.xxhash64(x, F.lit(1)), F.lit(2))))
    n = lambda v: F.size(F.filter("_w", lambda x: x == v))
    own = df.select(F.col(key), spots.alias("_w")).select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (n(i * 2) - n(i * 2 + 1)).cast("double")).alias("_d"))
    norm = F.sqrt(F.aggregate("_d", F.lit(0.0), lambda s, x: s + x * x))
    own = own.select(key, "_d", norm.alias("_n"))
    dense = F.transform("_d", lambda x: F.coalesce(F.try_divide(x, F.col("_n")), F.lit(0.0)).cast("float"))
    return own.select(key, dense.alias("dense"), F.struct(F.array().cast("array<int>").alias("indices"), F.array().cast("array<float>").alias("values")).alias("sparse"))
