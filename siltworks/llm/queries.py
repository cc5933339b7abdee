"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import encoding, history, leakage, mainbody, ordermin, packing, scans, templates

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that the sources of chunk_results repeat excessively."""
    return templates.repeated_places(_t(spark, d, "chunk_results"), _t(spark, d, "uploaded_files"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's text without the lines its source repeats."""
    return templates.without_repeated(_t(spark, d, "chunk_results"), _t(spark, d, "uploaded_files")).select("chunk_key", "clean_text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunk_results rows whose words are alike beyond the limit."""
    return ordermin.all_pairs(*ordermin.near_pairs(_t(spark, d, "chunk_results"), "chunk_key", "text"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rows of chunk_results with near-duplicates, their group and their number of links."""
    return ordermin.groups(_t(spark, d, "chunk_results"), "chunk_key", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of page_chunks that belong to the page's own article."""
    return mainbody.body_places(_t(spark, d, "page_chunks"), _t(spark, d, "uploaded_files"))


def p3_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Each page's own article."""
    return mainbody.bodies(_t(spark, d, "page_chunks"), _t(spark, d, "uploaded_files")).select("page_id", "body")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of incoming_chunks that the history or an earlier accepted row holds already."""
    h = history.History(spark)
    h.begin(_t(spark, d, "chunk_results"), "chunk_key")
    out = history.refused(h, _t(spark, d, "incoming_chunks"), "incoming_id", "batch_no")
    h.drop()
    return out.select(F.col("id").alias("incoming_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Page furniture, broken words and misread words of scan_chunks."""
    return scans.Scans(_t(spark, d, "scan_chunks")).found()


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The repaired paragraphs of each scanned file."""
    return scans.Scans(_t(spark, d, "scan_chunks")).paragraphs()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """A container of each capacity for each document."""
    return packing.containers(_t(spark, d, "documents"), _t(spark, d, "container_sizes"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled."""
    caps = _t(spark, d, "container_sizes")
    return packing.fill(packing.containers(_t(spark, d, "documents"), caps), caps)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items they give away."""
    return leakage.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with the MD5 of their restored text."""
    r = encoding.repair(_t(spark, d, "documents"))
    return r.select("doc_id", F.when(F.col("lost"), F.lit("")).otherwise(F.md5(F.encode("restored", "UTF-8"))).alias("restored_md5"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents with their restored text and the characters in it that are lost for good."""
    r = encoding.repair(_t(spark, d, "documents"))
    return r.select("doc_id", "lost", (F.length("restored") - F.length(F.replace("restored", F.lit(encoding.LOST), F.lit("")))).alias("gaps"), "restored")


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_clean": p1_clean, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_bodies": p3_bodies, "p4_found": p4_found, "p5_found": p5_found, "p5_paragraphs": p5_paragraphs, "p6_containers": p6_containers, "p6_fill": p6_fill, "p7_found": p7_found, "p8_found": p8_found, "p8_restored": p8_restored}


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_HOST = r"regexp_replace(regexp_extract(lower(trim(source_url)), '^\s*(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@\s]*@)?([^/?#:\s]+)', 1), '^www\.', '')"
_PLAIN = r"trim(regexp_replace(regexp_replace(lower(line), '\p{Nd}+', '', 'g'), '[\s\x{000B}\x{0085}\p{Z}]+', ' ', 'g'))"


def _alike_sql(a: str, b: str, on: str) -> str:
    """Pairs (x, y) of the word counts ``a`` and ``b`` (k, w, c, n) that are alike."""
    return f"SELECT a.k AS x, b.k AS y FROM {a} a JOIN {b} b ON a.w = b.w AND {on} GROUP BY a.k, b.k, a.n, b.n HAVING 10 * sum(least(a.c, b.c)) >= 7 * (a.n + b.n - sum(least(a.c, b.c)))"


def _bags_sql(table: str, key: str) -> str:
    """(k, w, c, n): the words of each row of at least 20 words with their counts and the row's number of words."""
    one = f"SELECT {key} AS k, unnest({_WORDS}) AS w FROM {table} WHERE {key} IS NOT NULL"
    return f"SELECT k, w, count(*) AS c, n FROM (SELECT k, w, count(*) OVER (PARTITION BY k) AS n FROM ({one})) WHERE n >= 20 GROUP BY k, w, n"


def oracle_sql() -> dict[str, str]:
    p1 = f"""
        WITH source AS (SELECT DISTINCT file_id, {_HOST} AS host FROM uploaded_files WHERE file_id IS NOT NULL AND {_HOST} <> ''),
        chunk AS (SELECT chunk_key, host, string_split(text, chr(10)) AS lines FROM chunk_results JOIN source USING (file_id)),
        size AS (SELECT host, count(*) AS rows FROM chunk GROUP BY host),
        piece AS (SELECT chunk_key, host, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no FROM chunk WHERE lines IS NOT NULL),
        told AS (SELECT chunk_key, host, line_no, CASE WHEN {_PLAIN} = '' AND regexp_matches(line, '\\p{{Nd}}') THEN '<*>' ELSE {_PLAIN} END AS t FROM piece),
        often AS (SELECT host, t, count(DISTINCT chunk_key) AS n FROM told WHERE t <> '' GROUP BY host, t)
        SELECT DISTINCT chunk_key, line_no::INT AS line_no FROM told JOIN often USING (host, t) JOIN size USING (host) WHERE n >= 5 AND 10 * n >= rows"""
    p2 = f"WITH bag AS ({_bags_sql('chunk_results', 'chunk_key')}) SELECT x AS key_a, y AS key_b FROM ({_alike_sql('bag', 'bag', 'a.k < b.k')})"
    p4 = f"""
        WITH RECURSIVE old AS MATERIALIZED ({_bags_sql('chunk_results', 'chunk_key')}), new AS MATERIALIZED ({_bags_sql('incoming_chunks', 'incoming_id')}),
        place AS MATERIALIZED (SELECT incoming_id AS k, row_number() OVER (ORDER BY batch_no, incoming_id) AS i FROM incoming_chunks WHERE incoming_id IN (SELECT k FROM new)),
        known AS (SELECT DISTINCT x FROM ({_alike_sql('new', 'old', 'true')})),
        link AS MATERIALIZED (SELECT x, list(y) AS ys FROM ({_alike_sql('new', 'new', 'a.k <> b.k')}) JOIN place p ON p.k = x JOIN place q ON q.k = y AND q.i < p.i GROUP BY x),
        seq AS MATERIALIZED (SELECT i, k, known.x IS NOT NULL AS refused, coalesce(ys, []) AS ys FROM place LEFT JOIN known ON known.x = k LEFT JOIN link ON link.x = k),
        step AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS taken
            UNION ALL SELECT seq.i, CASE WHEN refused OR list_has_any(ys, taken) THEN taken ELSE list_append(taken, k) END FROM step JOIN seq ON seq.i = step.i + 1)
        SELECT k AS incoming_id FROM place WHERE NOT list_contains((SELECT taken FROM step ORDER BY i DESC LIMIT 1), k)"""
    p7 = f"""
        WITH item AS (SELECT item_id, w, least(len(w), 12) AS n FROM (SELECT item_id, {_WORDS} AS w FROM eval_items) WHERE len(w) > 0 AND item_id IS NOT NULL),
        run AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM item)),
        doc AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
        part AS (SELECT doc_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, (SELECT DISTINCT n FROM run) WHERE len(w) >= n))
        SELECT DISTINCT doc_id, item_id FROM part JOIN run USING (n, g)"""
    return {"p1_found": p1, "p2_found": p2, "p4_found": p4, "p7_found": p7}
