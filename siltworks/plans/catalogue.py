"""All registered queries of the core library, each with its SQL where SQL can say it.

A query takes the session and the folder of the tables and reads whole tables. The SQL is written for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import ids, jsonops, markup, text, urls
from siltworks.operators import chunking, conversation, listing, metrics, pages, payload, rows, search, store
from siltworks.operators.neighbours import with_previous
from siltworks.session import scratch, small, stored
from siltworks.sources import files, jsonfiles, tabular

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# SQL spellings of the text functions
_SP = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
strip_ = lambda x: f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"
squeeze_ = lambda x: strip_(f"regexp_replace(coalesce({x}, ''), '{_SP}+', ' ', 'g')")
tokens_ = lambda x: f"(CASE WHEN length(coalesce({x}, '')) = 0 THEN 0 ELSE greatest(1, length({x}) // 4) END)::INT"
words_ = lambda x: f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]{{4,}}'))"


def uuid5_(x: str, namespace: str) -> str:
    h = f"sha1(unhex('{namespace}') || encode({x}))"
    # the ninth byte keeps its low six bits under binary 10
    v = f"printf('%02x', ((('0x' || substr({h}, 17, 2))::INT & 63) | 128))"
    return f"substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || {v} || substr({h},19,2) || '-' || substr({h},21,12)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- text ------------------------------------------------------------------------------------------------------------


@query(f"SELECT chunk_key, {squeeze_('text')} AS clean FROM chunk_results")
def whitespace_normalise(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "chunk_results").select("chunk_key", text.squeeze(F.col("text")).alias("clean"))


@query(
    f"SELECT doc_id, length(text)::INT AS char_count, {tokens_('text')} AS token_count, CASE WHEN {squeeze_('text')} = '' THEN 0 ELSE len(string_split({squeeze_('text')}, ' ')) END::INT AS word_count,"
    " octet_length(encode(text))::INT AS byte_count, md5(text) AS digest FROM documents"
)
def token_char_counts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return t(spark, d, "documents").select(
        "doc_id", F.length(c).alias("char_count"), text.token_count(c).alias("token_count"), text.word_tokens(c).cast("int").alias("word_count"), F.octet_length(c).alias("byte_count"), F.md5(F.encode(c, "UTF-8")).alias("digest")
    )


_CUTS = f"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?]){_SP}+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {strip_('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, len(s)::INT AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::INT AS longest FROM (SELECT doc_id, {_CUTS} AS s FROM documents)")
def sentence_split_stats(spark: SparkSession, d: str) -> DataFrame:
    s = text.sentences(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.size(s).alias("sentences"), F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).alias("longest"))


@query(f"SELECT doc_id, len({words_('text')})::INT AS words FROM documents")
def word_set_sizes(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.size(text.word_set(F.col("text"))).alias("words"))


@query(f"SELECT chunk_key, len(list_filter(list_transform(string_split(text, '. '), lambda x: {strip_('x')}), lambda x: x <> ''))::INT AS parts FROM chunk_results")
def delimiter_split(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "chunk_results").select("chunk_key", F.size(text.delimited(F.col("text"), ". ")).alias("parts"))


@query("""
SELECT doc_id, i::INT AS place, substr(text, s + 1, CASE WHEN short AND i = k - 2 THEN n ELSE 1200 END) AS piece FROM (
  SELECT doc_id, text, n, k, short, unnest(range(0, CASE WHEN short THEN k - 1 ELSE k END)) AS i, i * 1000 AS s FROM (
    SELECT doc_id, text, length(text) AS n, len(range(0, length(text), 1000)) AS k, len(range(0, length(text), 1000)) > 1 AND length(text) - (len(range(0, length(text), 1000)) - 1) * 1000 < 200 AS short
    FROM documents WHERE length(text) > 0))
""")
def char_windows(spark: SparkSession, d: str) -> DataFrame:
    w = text.char_windows(F.col("text"), target=300, overlap=50, least=50)
    return t(spark, d, "documents").select("doc_id", F.posexplode(w).alias("place", "piece"))


@query("SELECT chunk_key, CASE WHEN n = '' THEN 1 ELSE n::INT END AS page FROM (SELECT chunk_key, regexp_extract('## page  ' || coalesce(metadata['page_number'], 'x') || text, '(?i)##\\s*Page\\s+(\\d+)', 1) AS n FROM chunk_results)")
def page_number(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat(F.lit("## page  "), F.coalesce(F.try_element_at("metadata", F.lit("page_number")), F.lit("x")), F.col("text"))
    return t(spark, d, "chunk_results").select("chunk_key", text.page_number(own).alias("page"))


@query(
    "SELECT listing_id, CASE WHEN f = '' THEN 'upload.pdf' ELSE f END AS safe, g AS slug FROM (SELECT listing_id, regexp_replace(regexp_replace(regexp_extract(regexp_replace(coalesce(filename, ''), '/+$', ''), '([^/]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS f,"
    f" regexp_replace(regexp_replace(lower({strip_('knowledge_base_name')}), '[_ ]', '-', 'g'), '-+', '-', 'g') AS g FROM uploaded_files)"
)
def safe_filename(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "uploaded_files").select("listing_id", text.safe_filename(F.col("filename")).alias("safe"), text.slug(F.col("knowledge_base_name")).alias("slug"))


@query(
    f"SELECT chunk_key, CASE WHEN v IN ('1','true','yes','on','active','enabled') THEN true WHEN v IN ('0','false','no','off','inactive','disabled') THEN false ELSE true END AS active FROM (SELECT chunk_key, lower({strip_(chr(34) + 'metadata' + chr(34) + '[' + chr(39) + 'isActive' + chr(39) + ']')}) AS v FROM chunk_results)"
)
def bool_coerce(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "chunk_results").select("chunk_key", text.truth(F.try_element_at("metadata", F.lit("isActive"))).alias("active"))


_LF = "regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g')"


@query("SELECT scan_id, " + strip_(f"regexp_replace({_LF}, '\\n{{3,}}', chr(10) || chr(10), 'g')") + " AS clean FROM scan_chunks")
def ocr_normalise(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "scan_chunks").select("scan_id", text.ocr_clean(F.col("text")).alias("clean"))


_HEAD = strip_(f"replace(replace(lower({squeeze_(chr(120))}), 'page', ''), 'of', '')")


def _heads(x: str) -> str:
    return _HEAD.replace("coalesce(x, '')", f"coalesce(regexp_replace(regexp_replace(regexp_replace({x}, '\\b\\d+\\b', '', 'g'), '\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}', '', 'g'), '\\d{{4}}', '', 'g'), '')")


@query(f"""
WITH spans AS (SELECT file_id, page_no, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS y, len(string_split(text, chr(10))) AS h FROM scan_chunks),
edge AS (SELECT file_id, page_no, y, h, {_heads('line')} AS head, CASE WHEN y <= 0.12 * h THEN 'header' ELSE 'footer' END AS zone FROM spans WHERE (y <= 0.12 * h OR y > 0.88 * h) AND length(line) > 3),
pages AS (SELECT file_id, count(DISTINCT page_no) AS pages FROM scan_chunks GROUP BY file_id)
SELECT file_id, zone, head, n::BIGINT AS n, lowest::INT AS lowest, highest::INT AS highest FROM (SELECT file_id, zone, head, count(*) AS n, min(y) AS lowest, max(y) AS highest FROM edge WHERE head <> '' GROUP BY ALL) JOIN pages USING (file_id) WHERE n >= greatest(2, 0.5 * pages)
""")
def repeating_zone(spark: SparkSession, d: str) -> DataFrame:
    """Texts that return in the top or bottom eighth of the pages of a file."""
    scans = t(spark, d, "scan_chunks")
    span = scans.select("file_id", "page_no", F.size(F.split("text", "\n")).alias("h"), F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("y", F.col("p") + 1)
    top = F.col("y") <= 0.12 * F.col("h")
    edge = span.where((top | (F.col("y") > 0.88 * F.col("h"))) & (F.length("line") > 3)).select("file_id", "y", text.running_head(F.col("line")).alias("head"), F.when(top, "header").otherwise("footer").alias("zone"))
    n = edge.where("head <> ''").groupBy("file_id", "zone", "head").agg(F.count("*").alias("n"), F.min("y").alias("lowest"), F.max("y").alias("highest"))
    pages = scans.groupBy("file_id").agg(F.count_distinct("page_no").alias("pages"))
    return n.join(pages, "file_id").where(F.col("n") >= F.greatest(F.lit(2), 0.5 * F.col("pages"))).drop("pages")


# ---- ids -------------------------------------------------------------------------------------------------------------

_SCOPE = "concat_ws('|', nullif(f, ''))"
_SEED = f"concat_ws('|', coalesce(file_id, ''), {strip_('substr(text, 1, 100)')}, length(text)::VARCHAR, chunk_index::VARCHAR, metadata['chunk_type'])"


@query(f"SELECT chunk_key, substr(sha256({_SEED}), 1, 16) AS chunk_id FROM chunk_results")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "chunk_results")
    return c.select("chunk_key", ids.chunk_id(F.col("text"), F.col("chunk_index"), F.try_element_at("metadata", F.lit("chunk_type")), ids.scope({"file_id": F.col("file_id")})).alias("chunk_id"))


@query(f"SELECT doc_id, {uuid5_('text', ids.URL)} AS point_id, {uuid5_(chr(99) + 'oncat_ws(' + chr(39) + '::' + chr(39) + ', file_id, ' + chr(39) + 'row' + chr(39) + ', doc_id::VARCHAR)', ids.DNS)} AS row_id FROM documents")
def point_ids_uuid5(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", ids.point_id(F.col("text")).alias("point_id"), ids.row_id(F.col("file_id"), F.lit("row"), F.col("doc_id")).alias("row_id"))


# ---- URLs ------------------------------------------------------------------------------------------------------------

_U = f"regexp_extract({strip_('coalesce(source_url, ' + chr(39) * 2 + ')')}, '^([A-Za-z][A-Za-z0-9+.\\-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?', %d)"
_PATH = "regexp_replace(p, '^$', '/')"


@query(
    f"SELECT listing_id, CASE WHEN s IN ('http', 'https') AND h <> '' THEN CASE WHEN {_PATH} = '/' THEN s || '://' || h || '/' ELSE regexp_replace(s || '://' || h || {_PATH}, '/+$', '') END ELSE '' END AS url,"
    " s IN ('http', 'https') AND (h = 'example' OR ends_with(h, '.example')) AS scoped,"
    " contains(lower(source_url), 'products') OR contains(lower(source_url), 'advice') AS wanted,"
    " CASE WHEN x = '' THEN hh ELSE x END AS title, CASE WHEN y = '' THEN 'page' ELSE y END AS slug FROM (SELECT *, "
    f"{strip_('regexp_replace(regexp_extract(regexp_replace(p, ' + chr(39) + '/+$' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + '([^/]*)$' + chr(39) + ', 1), ' + chr(39) + '[-_]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS x,"
    " regexp_replace(regexp_replace(CASE WHEN regexp_replace(p, '^/+|/+$', '', 'g') = '' THEN 'home' ELSE regexp_replace(p, '^/+|/+$', '', 'g') END, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS y"
    f" FROM (SELECT listing_id, source_url, lower({_U % 1}) AS s, lower({_U % 2}) AS h, {_U % 2} AS hh, {_U % 3} AS p FROM uploaded_files))"
)
def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("source_url")
    return t(spark, d, "uploaded_files").select(
        "listing_id", urls.normal(u).alias("url"), urls.in_scope(u, "example", subdomains=True).alias("scoped"), urls.allowed(u, include=["products", "advice"]).alias("wanted"), urls.title(u).alias("title"), urls.slug(u).alias("slug")
    )


@query(f"SELECT url, min(listing_id) AS first_listing, count(*)::BIGINT AS listings FROM (SELECT listing_id, lower({_U % 1}) || '://' || lower({_U % 2}) AS url FROM uploaded_files WHERE source_url IS NOT NULL) GROUP BY url")
def link_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sites in the order in which they were first listed."""
    u = t(spark, d, "uploaded_files").where("source_url is not null").select("listing_id", F.concat(F.lower(urls.part(F.col("source_url"), 1)), F.lit("://"), F.lower(urls.part(F.col("source_url"), 2))).alias("url"))
    return u.groupBy("url").agg(F.min("listing_id").alias("first_listing"), F.count("*").alias("listings"))


_EXT = "lower(regexp_extract(filename, '(\\.[A-Za-z0-9]+)$', 1))"
_ROUTE = "CASE WHEN x IN ('.csv','.tsv','.xlsx','.xls','.xlsm') THEN 'rows' WHEN x IN ('.png','.jpg','.jpeg','.tif','.tiff','.bmp') THEN 'ocr' WHEN x = '.zip' THEN 'archive' WHEN x IN ('.pdf','.docx','.html','.htm','.xml','.json') THEN substr(x, 2) ELSE 'text' END"


@query(f"SELECT listing_id, x AS suffix, {_ROUTE} AS route, coalesce(regexp_matches(filename, '(^|/)(__MACOSX|\\.[^./])'), false) AS junk FROM (SELECT listing_id, filename, coalesce({_EXT}, '') AS x FROM uploaded_files)")
def file_route(spark: SparkSession, d: str) -> DataFrame:
    from siltworks.sources.files import junk, route, suffix

    f = F.col("filename")
    return t(spark, d, "uploaded_files").select("listing_id", suffix(f).alias("suffix"), route(f).alias("route"), junk(f).alias("junk"))


@query(
    f"SELECT listing_id, coalesce(nullif({strip_('source_type_name')}, ''), CASE WHEN regexp_matches(u, '^\\s*https?://') THEN 'website' END, CASE WHEN nullif({strip_('filename')}, '') IS NOT NULL THEN 'file' END, 'unknown') AS kind,"
    f" coalesce(CASE WHEN regexp_matches(u, '^\\s*https?://') THEN 'website' END, CASE WHEN nullif({strip_('filename')}, '') IS NOT NULL THEN 'file' END, 'unknown') AS inferred FROM (SELECT *, lower(coalesce(source_url, '')) AS u FROM uploaded_files)"
)
def source_type_infer(spark: SparkSession, d: str) -> DataFrame:
    u, f = F.col("source_url"), F.col("filename")
    return t(spark, d, "uploaded_files").select("listing_id", payload.source_type(F.col("source_type_name"), u, f).alias("kind"), payload.source_type(F.lit(None).cast("string"), u, f).alias("inferred"))


# ---- markup ----------------------------------------------------------------------------------------------------------


def _html(spark: SparkSession, d: str) -> DataFrame:
    """Documents dressed as web pages: their title, text and a link for each of the first words."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title, body = esc(F.coalesce("title", F.lit(""))), F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), esc(x), F.lit("</p>"))), "\n")
    links = F.concat(F.lit('<a href="/d/'), F.col("doc_id").cast("string"), F.lit('">next</a><script>var x = 1;</script>'))
    html = F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head>\n<body><h1>"), title, F.lit("</h1>\n"), body, links, F.lit("</body></html>"))
    return t(spark, d, "documents").select("doc_id", "title", "text", html.alias("html"))


@query(
    f"SELECT doc_id, {squeeze_('title')} AS title, 1 AS headings, 1 AS links, '/d/' || doc_id AS first_link, {squeeze_(squeeze_('title') + ' || ' + chr(39) + ' ' + chr(39) + ' || ' + squeeze_('text') + ' || ' + chr(39) + ' next' + chr(39))} AS body FROM documents"
)
def html_parse(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    own = markup.links(h)
    body = markup.plain(F.regexp_replace(markup.body(h), r"(?is)<head.*?</head>", " "))
    return _html(spark, d).select("doc_id", markup.title(h).alias("title"), F.size(markup.headings(h)).alias("headings"), F.size(own).alias("links"), F.element_at(own, 1)["url"].alias("first_link"), body.alias("body"))


@query(
    f"SELECT doc_id, concat_ws(chr(10), CASE WHEN {squeeze_('title')} <> '' THEN '# ' || {squeeze_('title')} || chr(10) END, '**Format**: HTML Document' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Content' || chr(10),"
    f" {squeeze_(squeeze_('title') + ' || ' + chr(39) + ' ' + chr(39) + ' || ' + squeeze_('text') + ' || ' + chr(39) + ' next' + chr(39))}, chr(10) || '## Links' || chr(10) || '- [next](/d/' || doc_id || ')') AS md FROM documents"
)
def html_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _html(spark, d).select("doc_id", markup.to_markdown(F.col("html")).alias("md"))


_BLOCKS = f"list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda b: {strip_('b')}), lambda b: b <> '')"


@query(f"""
WITH b AS (SELECT page_id, unnest(bs) AS block, unnest(range(1, len(bs) + 1)) AS pos FROM (SELECT page_id, {_BLOCKS} AS bs FROM page_chunks) WHERE len(bs) > 0),
f AS (SELECT page_id, min(pos) AS pos, arg_min(block, pos) AS block FROM b GROUP BY page_id, lower({squeeze_('block')}))
SELECT page_id, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS text FROM f GROUP BY page_id
""")
def block_dedup(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "page_chunks").select("page_id", markup.distinct_blocks(F.col("text")).alias("text"))


@query(
    f"SELECT doc_id, CASE WHEN trim(coalesce(title, '')) <> '' THEN regexp_replace(text, '^\\s+', '') ELSE text END AS text FROM (SELECT doc_id, {strip_('title')} AS title, text FROM documents WHERE title IS NOT NULL)"
)
def strip_title(spark: SparkSession, d: str) -> DataFrame:
    """The title set before a document as a heading is taken off again."""
    docs = t(spark, d, "documents").where("title is not null")
    return docs.select("doc_id", markup.without_title(F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("text")), F.col("title")).alias("text"))


# ---- JSON ------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'k: ' || json_extract_string(props, '$.k') AS flat, 'Entry ' || event_id AS name, substr(rtrim(props), 1, length(rtrim(props)) - 1) || ',\"_source_url\":\"/e/' || event_id || '\"}' AS sourced FROM events")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return t(spark, d, "events").select(
        "event_id", jsonops.pick(p, "k").alias("k"), jsonops.flat(p).alias("flat"), jsonops.display_name(p, F.col("event_id")).alias("name"), jsonops.with_source(p, F.concat(F.lit("/e/"), F.col("event_id").cast("string"))).alias("sourced")
    )


@query("SELECT user_id, json_extract_string(props, '$.k')::INT AS k, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def json_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Responses with records under a known key, unwrapped again: one response for each user, type and hour."""
    e = t(spark, d, "events")
    page = e.groupBy("user_id", "event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.to_json(F.struct(F.lit("ok").alias("status"), F.array().cast("array<string>").alias("data"), F.collect_list(F.from_json("props", "struct<k: int>")).alias("items"))).alias("response"))
    one = page.select("user_id", F.explode(jsonops.records(F.col("response"))).alias("r"))
    return one.groupBy("user_id", jsonops.pick(F.col("r"), "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'Entry ' || doc_id AS name, title, lang, false AS bad FROM documents UNION ALL SELECT doc_id, NULL, NULL, NULL, true FROM documents WHERE n_chars IS NULL")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines and read again; for each without a count a broken line stands among them and is reported."""
    docs = t(spark, d, "documents").select("doc_id", "title", "lang", "n_chars")
    good = docs.select(F.to_json(F.struct("doc_id", "title", "lang")).alias("value"))
    cut = docs.where("n_chars is null").select(F.concat(F.lit('{"doc_id":'), F.col("doc_id"), F.lit(',"title":"cut')).alias("value"))
    where = scratch(spark, "json-lines")
    good.unionByName(cut).write.text(where)
    r = jsonfiles.read_lines(spark, where)
    bad = F.col("error").isNotNull()
    key = F.when(bad, F.regexp_extract("raw", r'"doc_id":(\d+)', 1)).otherwise(jsonops.pick(F.col("record"), "doc_id")).cast("long").alias("doc_id")
    return r.select(key, F.when(~bad, jsonops.display_name(F.to_json(F.struct(F.lit(None).cast("string").alias("x"))), jsonops.pick(F.col("record"), "doc_id"))).alias("name"), jsonops.pick(F.col("record"), "title").alias("title"), jsonops.pick(F.col("record"), "lang").alias("lang"), bad.alias("bad"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer UNION ALL SELECT s_suppkey::VARCHAR, s_name, NULL FROM supplier")
def csv_union(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers written as CSV files of two delimiters and read as one union of sources."""
    a, b = scratch(spark, "csv"), scratch(spark, "csv")
    t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).write.option("header", True).option("escape", '"').csv(a)
    t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("name")).write.option("header", True).option("escape", '"').option("sep", ";").csv(b)
    both = files.union({"customers": lambda: tabular.read_csv(spark, a), "suppliers": lambda: tabular.read_csv(spark, b), "gone": lambda: tabular.read_csv(spark, a + "-gone")}, spark)
    return both.where("error is null").select(F.col("key").alias("c_custkey"), F.col("name").alias("c_name"), F.col("segment").alias("c_mktsegment"))


# ---- rows ------------------------------------------------------------------------------------------------------------

_V = lambda c: f"nullif({strip_(c + '::VARCHAR')}, '')"
_CUST = ("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, 'Row ' || c_custkey || ': ' || concat_ws(' | ', " + ", ".join(f"'{c}: ' || {_V(c)}" for c in _CUST) + f") AS text, {uuid5_(chr(39) + 'customer::row::' + chr(39) + ' || c_custkey', ids.DNS)} AS row_id FROM customer")
def row_text_customer(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer")
    return c.select("c_custkey", rows.as_text(list(_CUST), F.col("c_custkey")).alias("text"), ids.row_id(F.lit("customer"), F.lit("row"), F.col("c_custkey")).alias("row_id"))


@query("""
SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS row_number,
  'Row ' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) || ': o_orderkey: ' || o_orderkey || ' | o_orderstatus: ' || o_orderstatus AS text FROM orders
""")
def row_text_orders(spark: SparkSession, d: str) -> DataFrame:
    o = rows.numbered(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_orderkey", "o_custkey")
    return o.select("o_custkey", "o_orderkey", "row_number", rows.as_text(["o_orderkey", "o_orderstatus"], F.col("row_number")).alias("text"))


_CELL = lambda c: f"CASE WHEN lower({strip_(c)}) NOT IN ('','nan','none','nat','<na>','n/a','null','na') THEN {strip_(c)} END"


@query(f"""
SELECT scan_id, 'Sheet: scans | Row ' || scan_id || ': ' || CASE WHEN b = '' THEN '(empty row)' ELSE b END AS text FROM (
  SELECT scan_id, concat_ws(' | ', 'file: ' || f, 'lang: ' || l, 'kind: ' || k) AS b FROM (SELECT scan_id, {_CELL('file_id')} AS f, {_CELL("coalesce(metadata['lang'], 'N/A')")} AS l, {_CELL("coalesce(metadata['chunk_type'], ' null ')")} AS k FROM scan_chunks)
  WHERE (f IS NOT NULL)::INT + (l IS NOT NULL)::INT + (k IS NOT NULL)::INT >= 2)
""")
def excel_clean_rows(spark: SparkSession, d: str) -> DataFrame:
    m = lambda k, other: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(other))
    s = t(spark, d, "scan_chunks").select("scan_id", F.col("file_id").alias("file"), m("lang", "N/A").alias("lang"), m("chunk_type", " null ").alias("kind"))
    c = rows.cleaned(s, ["file", "lang", "kind"])
    return c.select("scan_id", rows.as_text(["file", "lang", "kind"], F.col("scan_id"), sheet="scans").alias("text"))


@query("SELECT file_type, count(*)::BIGINT AS rows, count(lang)::BIGINT AS values FROM documents GROUP BY ROLLUP (file_type)")
def sheet_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.sheets(t(spark, d, "documents"), "file_type", "lang")


# ---- chunking --------------------------------------------------------------------------------------------------------


@query(f"""
WITH RECURSIVE s AS (SELECT doc_id, list_transform({_CUTS}, lambda x: greatest(1, length(x) // 4)) AS n FROM documents),
f AS (SELECT doc_id, n, 1 AS i, 0 AS piece, n[1] AS tokens, false AS closed FROM s WHERE len(n) > 0
  UNION ALL SELECT doc_id, n, i + 1, CASE WHEN tokens + n[i + 1] <= 300 THEN piece ELSE piece + 1 END, CASE WHEN tokens + n[i + 1] <= 300 THEN tokens + n[i + 1] ELSE n[i + 1] END, false FROM f WHERE i < len(n))
SELECT doc_id, piece::INT AS piece, max(tokens)::INT AS tokens FROM f GROUP BY doc_id, piece
""")
def oversized_pack(spark: SparkSession, d: str) -> DataFrame:
    return chunking.packed_sentences(t(spark, d, "documents"), "doc_id", "text", 300)


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    return chunking.chunk(docs, "doc_id", conf=chunking.Settings(target=300), scope={"file_id": F.col("file_id"), "source": F.col("source")})


@query()
def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(t(spark, d, "page_chunks"), "page_id", conf=chunking.Settings(target=120, overlap=20, alike=0.1))


@query(f"""
SELECT file_id, chunk_key, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 9) AS alike FROM (
  SELECT file_id, chunk_key, {words_('text')} AS b, {words_('before')} AS a FROM (SELECT file_id, chunk_key, text, lag(text) OVER (PARTITION BY file_id ORDER BY chunk_index, chunk_key) AS before FROM chunk_results WHERE file_id IS NOT NULL) WHERE before IS NOT NULL)
""")
def semantic_adjacent(spark: SparkSession, d: str) -> DataFrame:
    """How alike each chunk is to the one before it in its file."""
    c = t(spark, d, "chunk_results").where("file_id is not null").select("file_id", "chunk_key", "chunk_index", "text")
    c = with_previous(c, "file_id", ["chunk_index", "chunk_key"], ["text"], F.floor(F.col("chunk_index") / 256)).where("previous is not null").withColumn("before", F.col("previous.text"))
    return c.select("file_id", "chunk_key", F.round(text.jaccard(F.col("before"), F.col("text")), 9).alias("alike"))


@query("SELECT chunk_key, (row_number() OVER (ORDER BY created_at, chunk_key) - 1)::BIGINT AS global_index FROM chunk_results")
def global_chunk_index(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "chunk_results").select("chunk_key", "created_at")
    return chunking.globally_numbered(c, ["created_at", "chunk_key"]).select("chunk_key", "global_index")


# ---- search ----------------------------------------------------------------------------------------------------------

_COS = "list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    return t(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


@query(f"SELECT p.vec_id, round({_COS}, 6) AS score FROM embeddings p, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {_COS} >= 0.1 ORDER BY {_COS} DESC, p.vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    hit = search.top_k(t(spark, d, "embeddings"), _vector(spark, d, 0), k=10, threshold=0.1)
    return hit.select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT p.vec_id, p.label, round({_COS}, 6) AS score FROM embeddings p, (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE {_COS} >= 0.0 AND p.label <> 2 AND (p.label = 1 OR p.label = 3) ORDER BY {_COS} DESC, p.vec_id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    eq = lambda v: {"key": "label", "match": {"value": v}}
    tree = {"must_not": [eq(2)], "should": [eq(1), eq(3)]}
    hit = search.top_k(t(spark, d, "embeddings"), _vector(spark, d, 1), k=10, threshold=0.0, where=tree)
    return hit.select("vec_id", "label", F.round("score", 6).alias("score"))


_BATCH = f"SELECT q.vec_id AS query_id, p.vec_id, {_COS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 12) DESC, p.vec_id) AS rank FROM embeddings p, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE {_COS} >= 0.2"


@query(f"SELECT query_id, vec_id, round(s, 6) AS score, rank::INT AS rank FROM ({_BATCH}) WHERE rank <= 5")
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """The best points for every query whose id is divisible by 50, against all points."""
    e = t(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.top_k_batch(e, q, k=5, threshold=0.2).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT query_id, string_agg('[' || rank || '] (score ' || printf('%.4f', s) || ') ' || coalesce({strip_('text')}, ''), chr(10) ORDER BY rank) AS context FROM ({_BATCH}) b LEFT JOIN documents ON doc_id = b.vec_id WHERE rank <= 5 GROUP BY query_id")
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: for every query the scored context lines of its best points."""
    e = t(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = stored(search.top_k_batch(e, q, k=5, threshold=0.2), "hits")
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text").join(small(hits.select("vec_id").distinct(), 16), "vec_id", "left_semi")
    return search.context_lines(hits.join(docs, "vec_id", "left"), "query_id")


@query()
def embed_hash(spark: SparkSession, d: str) -> DataFrame:
    return search.hashed_embedding(t(spark, d, "documents"), "doc_id", "text").select("doc_id", "dense")


# ---- store -----------------------------------------------------------------------------------------------------------


def _points(spark: SparkSession, d: str) -> DataFrame:
    m = F.try_element_at("metadata", F.lit("isActive"))
    c = t(spark, d, "chunk_results").where("point_id is not null")
    c = c.select("point_id", "file_id", "chunk_index", "text", text.truth(m).alias("is_active"), F.col("chunk_key").alias("seq"))
    return store.latest(c, "point_id", "seq")


_ACT = "CASE WHEN lower(trim({m}['isActive'])) IN ('0','false','no','off','inactive','disabled') THEN false ELSE true END"
_PTS = f"(SELECT c.point_id, c.file_id, c.chunk_index, c.text, {_ACT.format(m='c.metadata')} AS is_active, c.chunk_key AS seq FROM chunk_results c JOIN (SELECT point_id, max(chunk_key) AS chunk_key FROM chunk_results WHERE point_id IS NOT NULL GROUP BY point_id) k USING (chunk_key))"
_NEW = f"(SELECT c.point_id, c.file_id, c.chunk_index, c.text, {_ACT.format(m='c.metadata')} AS is_active, c.incoming_id AS seq FROM incoming_chunks c JOIN (SELECT point_id, max(incoming_id) AS incoming_id FROM incoming_chunks WHERE point_id IS NOT NULL GROUP BY point_id) k USING (incoming_id))"


@query(f"SELECT p.point_id, p.file_id, p.chunk_index, p.seq FROM {_PTS} p WHERE point_id NOT IN (SELECT point_id FROM {_NEW} n) UNION ALL SELECT n.point_id, n.file_id, n.chunk_index, n.seq FROM {_NEW} n")
def upsert_points(spark: SparkSession, d: str) -> DataFrame:
    m = F.try_element_at("metadata", F.lit("isActive"))
    new = t(spark, d, "incoming_chunks").select("point_id", "file_id", "chunk_index", "text", text.truth(m).alias("is_active"), F.col("incoming_id").alias("seq"))
    return store.upserted(_points(spark, d), new, "point_id", "seq").select("point_id", "file_id", "chunk_index", "seq")


_MOST = "(SELECT file_id FROM chunk_results WHERE file_id IS NOT NULL GROUP BY file_id ORDER BY count(*) DESC, file_id LIMIT 1)"


def _largest(spark: SparkSession, d: str) -> str:
    return t(spark, d, "chunk_results").where("file_id is not null").groupBy("file_id").count().orderBy(F.desc("count"), "file_id").first()["file_id"]


@query(f"SELECT point_id, CASE WHEN file_id = {_MOST} THEN false ELSE is_active END AS is_active FROM {_PTS}")
def set_active(spark: SparkSession, d: str) -> DataFrame:
    return store.with_active(_points(spark, d), F.col("file_id") == _largest(spark, d), False).select("point_id", "is_active")


@query(f"SELECT point_id, file_id FROM {_PTS} WHERE file_id IS NULL OR file_id <> {_MOST}")
def delete_by_file(spark: SparkSession, d: str) -> DataFrame:
    return store.without(_points(spark, d), F.col("file_id") == _largest(spark, d)).select("point_id", "file_id")


@query(f"SELECT count(*) FILTER (WHERE coalesce(file_id = {_MOST}, false))::BIGINT AS matched, count(*) FILTER (WHERE NOT coalesce(file_id = {_MOST}, false))::BIGINT AS remaining FROM {_PTS}")
def delete_report(spark: SparkSession, d: str) -> DataFrame:
    return store.removal(_points(spark, d), F.col("file_id") == _largest(spark, d))


@query("SELECT file_id, count(*)::BIGINT AS n FROM chunk_results GROUP BY file_id")
def count_by_file(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "chunk_results").groupBy("file_id").agg(F.count("*").alias("n"))


@query()
def stored_collection(spark: SparkSession, d: str) -> DataFrame:
    """A collection written, upserted, read back: rows of each file by flag."""
    s = store.PointStore(spark)
    s.create("main", _points(spark, d))
    m = F.try_element_at("metadata", F.lit("isActive"))
    s.upsert("main", t(spark, d, "incoming_chunks").select("point_id", "file_id", "chunk_index", "text", text.truth(m).alias("is_active"), F.col("incoming_id").alias("seq")), "seq")
    return s.read("main").groupBy("file_id", "is_active").agg(F.count("*").alias("n"))


@query(
    f"SELECT chunk_key, coalesce(chunk_index, 0)::INT AS chunk_index, length(text)::INT AS char_count, nullif({strip_('file_id')}, '') AS file_id, {_ACT.format(m='metadata')} AS active, CASE WHEN metadata['page_url'] IS NOT NULL THEN '[REDACTED]' END AS url FROM chunk_results"
)
def payload_projection(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metadata")
    renamed = F.transform_keys(m, lambda k, v: F.when(k == "page_url", F.lit("page_token")).otherwise(k))
    p = payload.point_payload(F.col("point_id"), F.col("chunk_index"), F.col("text"), F.col("file_id"), F.try_element_at(m, F.lit("isActive")), renamed, m)
    c = t(spark, d, "chunk_results").select("chunk_key", p.alias("p"))
    return c.select("chunk_key", "p.chunk_index", "p.char_count", "p.file_id", F.col("p.isActive").alias("active"), F.try_element_at("p.source_details", F.lit("page_token")).alias("url"))


# ---- listing ---------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, d: str, active: bool = True) -> DataFrame:
    c = t(spark, d, "chunk_results").select("file_id", "chunk_key", "chunk_index", F.col("ingested_at").cast("string").alias("at"), text.truth(F.try_element_at("metadata", F.lit("isActive"))).alias("is_active"))
    return listing.by_file(c, "file_id", "chunk_key", "at", ["chunk_index"], "is_active" if active else None)


_FILES = f"(SELECT file_id AS file_key, count(*)::BIGINT AS chunk_count, arg_min(chunk_index, chunk_key) FILTER (WHERE chunk_index IS NOT NULL) AS chunk_index, max(ingested_at) AS at FROM chunk_results WHERE file_id IS NOT NULL AND {_ACT.format(m='metadata')} GROUP BY file_id)"
_STATE = "(SELECT r.file_id, r.status FROM file_registry r JOIN (SELECT file_id, max({'u': updated_at, 'r': registry_id}) AS m FROM file_registry WHERE file_id IS NOT NULL GROUP BY file_id) k ON r.registry_id = k.m.r)"


@query(f"SELECT file_key, chunk_count, chunk_index FROM {_FILES}")
def list_files(spark: SparkSession, d: str) -> DataFrame:
    return listing.newest_first(_files(spark, d), "completed_at").select("file_key", "chunk_count", "chunk_index")


@query("SELECT source_type_name, filename, file_id, count(*)::BIGINT AS listings, max(total_chunks)::BIGINT AS total_chunks FROM uploaded_files GROUP BY ALL")
def list_files_batch(spark: SparkSession, d: str) -> DataFrame:
    u = t(spark, d, "uploaded_files").groupBy("source_type_name", "filename", "file_id").agg(F.count("*").alias("listings"), F.max("total_chunks").alias("total_chunks"))
    return u.orderBy("source_type_name", "filename", "file_id")


@query(f"SELECT file_id, status FROM {_STATE}")
def registry_latest(spark: SparkSession, d: str) -> DataFrame:
    return listing.registry_state(t(spark, d, "file_registry")).select("file_id", "status")


@query(f"""
SELECT s.file_id AS file_key, 'registry' AS origin, s.status, f.chunk_count FROM {_STATE} s LEFT JOIN {_FILES} f ON f.file_key = s.file_id WHERE s.status NOT IN ('active', 'deleted')
UNION ALL SELECT file_key, 'points', 'active', chunk_count FROM {_FILES} WHERE file_key NOT IN (SELECT file_id FROM {_STATE} WHERE status NOT IN ('active', 'deleted'))
""")
def merged_listing(spark: SparkSession, d: str) -> DataFrame:
    return listing.merged_listing(_files(spark, d), listing.registry_state(t(spark, d, "file_registry")))


@query(f"""
SELECT coalesce(f.file_key, s.file_id) AS file_key, CASE WHEN s.status IN ('queued','processing','failed','deleting','delete_failed') THEN s.status WHEN f.chunk_count > 0 THEN 'active' ELSE coalesce(s.status, 'unknown') END AS status,
  coalesce(f.chunk_count, 0)::BIGINT AS chunk_count FROM {_FILES} f FULL JOIN {_STATE} s ON s.file_id = f.file_key
""")
def file_status(spark: SparkSession, d: str) -> DataFrame:
    return listing.status(_files(spark, d), listing.registry_state(t(spark, d, "file_registry")))


# ---- metrics ---------------------------------------------------------------------------------------------------------

_LOST = "(text IS NULL OR trim(text) = '' OR text = '[No extractable text]')"


@query(f"SELECT count(DISTINCT file_id)::BIGINT AS files, count(*) FILTER (WHERE NOT {_LOST})::BIGINT AS chunks, coalesce(sum(length(text)) FILTER (WHERE NOT {_LOST}), 0)::BIGINT AS chars, coalesce(sum(octet_length(encode(text))) FILTER (WHERE NOT {_LOST}), 0)::BIGINT AS bytes, count(*) FILTER (WHERE {_LOST})::BIGINT AS failures, 'success' AS status FROM chunk_results")
def job_metrics(spark: SparkSession, d: str) -> DataFrame:
    lost = F.col("text").isNull() | (F.trim("text") == "") | (F.col("text") == "[No extractable text]")
    return metrics.job(t(spark, d, "chunk_results"), "file_id", "text", lost)


@query("SELECT batch_no, count(*) FILTER (WHERE NOT f)::BIGINT AS succeeded, count(*) FILTER (WHERE f)::BIGINT AS failed, CASE WHEN count(*) FILTER (WHERE f) = 0 THEN 'success' WHEN count(*) FILTER (WHERE NOT f) > 0 THEN 'partial_success' ELSE 'FAILED' END AS status FROM (SELECT batch_no, file_id IS NULL OR text IS NULL OR trim(text) = '' AS f FROM incoming_chunks) GROUP BY batch_no")
def batch_status(spark: SparkSession, d: str) -> DataFrame:
    failed = F.col("file_id").isNull() | F.col("text").isNull() | (F.trim("text") == "")
    return metrics.batches(t(spark, d, "incoming_chunks"), "batch_no", failed)


@query("SELECT file_type, count(*)::BIGINT AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 1)::DOUBLE AS rate FROM documents GROUP BY file_type")
def extractor_rates(spark: SparkSession, d: str) -> DataFrame:
    return metrics.shares(t(spark, d, "documents"), "file_type")


# ---- conversation: the events of a user as the messages of a session --------------------------------------------------


def _messages(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("event_type") == "click", "user").when(F.col("event_type") == "view", "Assistant ").otherwise("system")
    return t(spark, d, "events").select("user_id", "event_id", "ts", role.alias("role"), F.concat(F.lit(" k  "), jsonops.pick(F.col("props"), "k")).alias("content"))


_MSG = "(SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'user' ELSE 'assistant' END AS role, 'k ' || json_extract_string(props, '$.k') AS content FROM events WHERE event_type IN ('click', 'view'))"


@query(f"SELECT user_id, event_id, role, content FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM {_MSG}) WHERE r <= 5")
def history_last_n(spark: SparkSession, d: str) -> DataFrame:
    return conversation.last_n(conversation.normalised(_messages(spark, d)), "user_id", ["event_id"], 5).select("user_id", "event_id", "role", "content")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def dedupe_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return conversation.without_repeats(t(spark, d, "events"), "user_id", ["event_id"], ["event_type"], F.floor(F.col("event_id") / 50_000)).select("user_id", "event_id", "event_type")


@query("SELECT user_id, max(event_id)::BIGINT AS last_used FROM events GROUP BY user_id ORDER BY last_used DESC, user_id LIMIT 1000")
def lru_sessions(spark: SparkSession, d: str) -> DataFrame:
    return conversation.recent_sessions(t(spark, d, "events"), "user_id", "event_id")


@query(f"SELECT user_id, string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || content, chr(10) ORDER BY event_id) AS context FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM {_MSG}) WHERE r <= 16 GROUP BY user_id")
def session_context(spark: SparkSession, d: str) -> DataFrame:
    return conversation.transcript(conversation.normalised(_messages(spark, d)), "user_id", ["event_id"])


@query(f"SELECT DISTINCT user_id, 'auto:' || {uuid5_('user_id::VARCHAR', ids.DNS)} AS session FROM events")
def auto_sessions(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return t(spark, d, "events").select("user_id").distinct().select("user_id", conversation.session_id(none, [none], F.col("user_id").cast("string")).alias("session"))


# ---- pages and guards ------------------------------------------------------------------------------------------------


@query("""
WITH g AS (SELECT chunk_key, file_id, CASE WHEN gap THEN (sum(gap::INT) OVER (PARTITION BY file_id ORDER BY chunk_key))::INT END AS n, text, gap FROM (SELECT *, coalesce(text = '[No extractable text]', false) AS gap FROM chunk_results WHERE file_id IS NOT NULL)),
f AS (SELECT file_id, filename, row_number() OVER (PARTITION BY file_id ORDER BY listing_id) AS n FROM uploaded_files WHERE file_id IS NOT NULL)
SELECT g.chunk_key, g.file_id, CASE WHEN gap THEN f.filename ELSE g.text END AS text FROM g LEFT JOIN f ON f.file_id = g.file_id AND f.n = g.n WHERE NOT gap OR f.filename IS NOT NULL
""")
def placeholder_fill(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without text take, in order, the names under which their file is listed."""
    c = t(spark, d, "chunk_results").where("file_id is not null").select("chunk_key", "file_id", "text")
    f = t(spark, d, "uploaded_files").where("file_id is not null").select("file_id", "filename", "listing_id")
    return pages.filled(c, "file_id", "chunk_key", "text", F.col("text") == "[No extractable text]", f, "filename", "listing_id")


@query("SELECT file_id, zone, count(*)::BIGINT AS n FROM (SELECT file_id, CASE WHEN y <= 2 THEN 'header' WHEN y >= h - 1 THEN 'footer' ELSE 'body' END AS zone FROM (SELECT file_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS y, len(string_split(text, chr(10))) AS h FROM scan_chunks)) GROUP BY ALL")
def zone_lines(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "scan_chunks").select("file_id", F.size(F.split("text", "\n")).alias("h"), F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return s.groupBy("file_id", pages.in_zone(F.col("p") + 1, F.lit(2), F.col("h") - 1).alias("zone")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN 'too large: ' || length(text) END AS error FROM documents")
def size_guard(spark: SparkSession, d: str) -> DataFrame:
    good, bad = pages.guarded(t(spark, d, "documents"), F.length("text"), 2000)
    return good.select("doc_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("doc_id", "error"))


@query("SELECT count(*) FILTER (WHERE h)::BIGINT AS hits, count(*) FILTER (WHERE NOT h)::BIGINT AS misses, round(count(*) FILTER (WHERE h) / count(*), 3) AS hit_rate FROM (SELECT coalesce(md5(text) IN (SELECT md5(text) FROM chunk_results), false) AS h FROM incoming_chunks)")
def text_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """How many incoming texts are known letter by letter."""
    return pages.cache_stats(t(spark, d, "incoming_chunks"), t(spark, d, "chunk_results"), F.md5(F.encode("text", "UTF-8")))


@query(f"SELECT file_id, count(*) FILTER (WHERE a)::BIGINT AS active, count(*)::BIGINT AS total, CASE WHEN count(*) FILTER (WHERE a) > 0 THEN 'no match' ELSE 'all inactive' END AS reason FROM (SELECT file_id, {_ACT.format(m='metadata')} AS a FROM chunk_results) GROUP BY file_id")
def no_result_reasons(spark: SparkSession, d: str) -> DataFrame:
    return pages.empty_reason(t(spark, d, "chunk_results"), "file_id", text.truth(F.try_element_at("metadata", F.lit("isActive"))))


@query("SELECT chunk_key, m['lang'] AS lang, len(map_keys(m))::INT AS n FROM (SELECT chunk_key, map_from_entries(list_filter(map_entries(metadata), lambda e: trim(e.key) <> '' AND trim(coalesce(e.value, '')) <> '')) AS m FROM chunk_results WHERE metadata IS NOT NULL)")
def header_maps(spark: SparkSession, d: str) -> DataFrame:
    """Lists of keys and values as maps without blanks."""
    c = t(spark, d, "chunk_results").where("metadata is not null").select("chunk_key", pages.header_map(F.map_entries("metadata")).alias("m"))
    return c.select("chunk_key", F.try_element_at("m", F.lit("lang")).alias("lang"), F.size("m").alias("n"))


# ---- numbers, files, tables --------------------------------------------------------------------------------------------

_PAGE = strip_("metadata['page_number']")


@query(
    f"SELECT chunk_key, greatest(CASE WHEN regexp_matches({_PAGE}, '^[+-]?[0-9]{{1,9}}$') THEN {_PAGE}::INT ELSE 1 END, 1)::INT AS page,"
    f" CASE WHEN regexp_matches({_PAGE}, '^[+-]?[0-9]+(\\.[0-9]+)?$') THEN {_PAGE}::DOUBLE ELSE 0.5 END AS value FROM chunk_results"
)
def safe_numbers(spark: SparkSession, d: str) -> DataFrame:
    p = F.try_element_at("metadata", F.lit("page_number"))
    return t(spark, d, "chunk_results").select("chunk_key", text.safe_int(p, 1, 1).alias("page"), text.safe_float(p, 0.5).alias("value"))


@query(f"SELECT {strip_('source_mapping_id')} AS source_mapping_id, min(listing_id) AS first FROM uploaded_files WHERE {strip_('source_mapping_id')} <> '' GROUP BY ALL")
def source_ids(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sources in the order in which they were first listed."""
    return listing.in_order(t(spark, d, "uploaded_files"), "source_mapping_id", "listing_id").orderBy("first")


@query(f"SELECT p.vec_id, p.label, round({_COS}, 6) AS score FROM embeddings p, (SELECT embedding FROM embeddings WHERE vec_id = 2) q WHERE {_COS} >= 0.0 AND p.label = 1 ORDER BY {_COS} DESC, p.vec_id LIMIT 10")
def vector_topk_model(spark: SparkSession, d: str) -> DataFrame:
    """The best points among those of one embedding model."""
    e = t(spark, d, "embeddings").withColumn("embedding_details", F.struct(F.concat(F.lit("model-"), F.col("label")).alias("embedding_model_name")))
    hit = search.top_k(e, _vector(spark, d, 2), k=10, threshold=0.0, where=search.of_model(None, "model-1"))
    return hit.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT query_id, rank::INT AS rank, text FROM ({_BATCH}) b JOIN chunk_results ON chunk_key = b.vec_id WHERE rank <= 3 AND {strip_('text')} <> ''")
def top_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the three best points of each query, blank ones dropped after the cut."""
    e = t(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = stored(search.top_k_batch(e, q, k=5, threshold=0.2), "hits")
    return search.best_texts(t(spark, d, "chunk_results").select(F.col("chunk_key").alias("vec_id"), "text").join(small(hits, 40), "vec_id"), "query_id")


@query("SELECT file_type, count(*)::BIGINT AS entries, count(*) FILTER (WHERE n_chars IS NULL)::BIGINT AS errors, round(count(n_chars) * 100 / count(*), 1)::DOUBLE AS rate FROM documents GROUP BY file_type")
def json_stats(spark: SparkSession, d: str) -> DataFrame:
    """Entries and faults by file type of documents as JSON, broken where there is no count."""
    whole = F.to_json(F.struct("doc_id", "text"))
    raw = t(spark, d, "documents").select(F.col("file_type").alias("path"), F.when(F.col("n_chars").isNull(), F.substring(whole, 1, 9)).otherwise(whole).alias("raw"))
    return jsonfiles.stats(jsonfiles.checked(raw)).withColumnRenamed("path", "file_type")


@query("""
SELECT doc_id, '{' || concat_ws(',', CASE WHEN lang IS NOT NULL OR source IS NOT NULL THEN '"of":{' || concat_ws(',', '"lang":' || to_json(lang)::VARCHAR, '"source":' || to_json(source)::VARCHAR) || '}' END,
  '"title":' || to_json(title)::VARCHAR, '"parts[*].n":[' || doc_id || ',2]') || '}' AS own FROM documents
""")
def json_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Documents as nested JSON, cut to some of their fields."""
    n = lambda c: F.struct(c.alias("n"), F.lit("x").alias("m"))
    whole = F.to_json(F.struct("doc_id", "title", F.struct("lang", "source", "file_type").alias("of"), F.array(n(F.col("doc_id")), n(F.lit(2).cast("long"))).alias("parts")))
    return t(spark, d, "documents").select("doc_id", jsonops.rebuilt(whole, ["of.lang", "of.source", "title", "none.there", "parts[*].n"]).alias("own"))


@query(f"SELECT listing_id, CASE WHEN coalesce(trim(filename), '') = '' THEN 'no name' WHEN x NOT IN ('.csv','.tsv','.xlsx','.xls','.xlsm','.html','.htm','.json') THEN 'unsupported: ' || x WHEN coalesce(total_chunks, 0) <= 0 THEN 'empty' END AS fault FROM (SELECT listing_id, filename, total_chunks, coalesce({_EXT}, '') AS x FROM uploaded_files)")
def file_faults(spark: SparkSession, d: str) -> DataFrame:
    known = (*files.ROWS, ".html", ".htm", ".json")
    return t(spark, d, "uploaded_files").select("listing_id", files.fault(F.col("filename"), F.col("total_chunks"), known).alias("fault"))


@query("SELECT l_orderkey, (1 + count(*))::INT AS elements, (1 + count(*))::INT AS attributes FROM lineitem GROUP BY l_orderkey")
def xml_counts(spark: SparkSession, d: str) -> DataFrame:
    """Elements and attributes of orders as XML; an order has at most a handful of lines."""
    line = F.concat(F.lit('<line n="'), F.col("l_linenumber"), F.lit('"/>'))
    xml = F.concat(F.lit('<order key="'), F.col("l_orderkey"), F.lit('">'), F.array_join("lines", ""), F.lit("</order>"))
    o = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    return o.select("l_orderkey", tabular.xml_counts(xml).alias("c")).select("l_orderkey", "c.*")


@query(f"SELECT {uuid5_(chr(39) + 'supplier::row::' + chr(39) + ' || s_suppkey', ids.DNS)} AS row_id, b AS text, len(string_split({squeeze_('b')}, ' '))::INT AS tokens FROM (SELECT s_suppkey, 'Row ' || s_suppkey || ': ' || concat_ws(' | ', 's_suppkey: ' || {_V('s_suppkey')}, 's_name: ' || {_V('s_name')}) AS b FROM supplier)")
def table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a database table as texts."""
    return rows.from_table(t(spark, d, "supplier"), ["s_suppkey", "s_name"], "s_suppkey", "supplier")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
