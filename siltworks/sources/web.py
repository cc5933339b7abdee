"""Crawls over tables of pages, sitemaps, and paged APIs.

A crawl is a breadth-first search: each round joins the frontier with the pages, takes their links and drops what was seen.
Frontier and seen pages are stored tables; nothing but a count goes through the driver. Where pages come from is a
function from URLs to pages, so the same crawl runs over stored pages (the default) or a fetcher.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltworks.functions import markup, urls
from siltworks.session import stored

Fetch = Callable[[DataFrame], DataFrame]


def from_table(pages: DataFrame, url: str = "url", html: str = "html") -> Fetch:
    """Pages from a table by their normalised URL."""
    own = pages.select(urls.normal(F.col(url)).alias("url"), F.col(html).alias("html")).where("url <> ''").dropDuplicates(["url"])
    return lambda frontier: frontier.join(own, "url")


def crawl(spark: SparkSession, start: list[str], fetch: Fetch, root_host: str, depth: int = 3, most: int = 500, subdomains: bool = False, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(url, depth, html) of the pages that are reached, nearest first, ties by URL, at most ``most``."""
    frontier = spark.createDataFrame([(u,) for u in start], "raw string").select(urls.normal(F.col("raw")).alias("url"), F.lit(0).alias("depth"))
    scope = lambda c: (c != "") & urls.in_scope(c, root_host, subdomains) & urls.allowed(c, include, exclude) & urls.page_like(c)
    frontier = stored(frontier.where(scope(F.col("url"))).dropDuplicates(["url"]), "frontier")
    seen, got, n = frontier.select("url"), None, 0
    for level in range(depth + 1):
        pages = stored(fetch(frontier).orderBy("url").limit(most - n), "pages")
        k = pages.count()
        got = pages if got is None else got.unionByName(pages)
        n += k
        if not k or n >= most or level == depth:
            break
        found = pages.select("url", F.explode(markup.links(F.col("html"))).alias("l")).select(absolute(F.col("url"), F.col("l.url")).alias("raw"))
        found = found.select(urls.normal(F.col("raw")).alias("url")).where(scope(F.col("url"))).distinct()
        frontier = stored(found.join(seen, "url", "left_anti").withColumn("depth", F.lit(level + 1)), "frontier")
        seen = stored(seen.unionByName(frontier.select("url")), "seen")
    return got.select("url", "depth", "html")


def absolute(base, link):  # noqa: ANN001, ANN201
    """A link as seen from a page: whole URLs stay, ``//host``, ``/path`` and relative paths are completed."""
    origin = F.concat(urls.part(base, 1), F.lit("://"), urls.part(base, 2))
    folder = F.regexp_replace(F.regexp_replace(urls.part(base, 3), "[^/]*$", ""), "^$", "/")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(urls.part(base, 1), F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when(F.startswith(link, F.lit("#")) | (link == ""), base)
        .otherwise(F.concat(origin, folder, F.regexp_replace(link, r"^(?:\./)+", "")))
    )


def sitemap(xml: str) -> tuple[list[str], list[str]]:
    """(child sitemaps, pages) of a sitemap, whatever its namespace; nothing if it cannot be parsed."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return [], []
    locs = list(dict.fromkeys(x.text.strip() for x in root.iter() if x.tag.rpartition("}")[2] == "loc" and (x.text or "").strip()))
    return (locs, []) if root.tag.rpartition("}")[2] == "sitemapindex" else ([], locs)


def following(page: int, size: int, got: int, body: dict) -> int | None:
    """The next page (or offset) of a paged API, or None: it says there is none, the page is short, or the mark does not move on.

    Numbers may come as strings. ``page`` of the response goes before the one asked for; ``total_items`` counts from an offset.
    """
    info = body.get("pagination") if isinstance(body.get("pagination"), dict) else body

    def number(key: str) -> int | None:
        v = info.get(key)
        return v if isinstance(v, int) and not isinstance(v, bool) else int(v) if isinstance(v, str) and v.strip().isdecimal() else None

    if info.get("has_next") is False:
        return None
    for key in ("next_page", "next_offset"):
        n = number(key)
        if n is not None:
            return n if n > page else None
    if (total := number("total_pages")) is not None:
        now = number("page") or page
        return now + 1 if now < total else None
    if (total := number("total_items")) is not None and (at := number("offset")) is not None:
        return at + got if got and at + got < total else None
    return page + 1 if got and got >= size else None


class PagedApi(DataSource):
    """``spark.read.format("paged_api")``: the responses of a paged JSON API as (page, response).

    Options: url (with ``{page}``), size, most (pages). The pages of one API follow each other, so it is one partition;
    several APIs are several reads. A ``file:`` URL reads stored responses. A page that cannot be fetched or is no JSON fails the
    read, so a result that is there is whole.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        return "page int, response string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        from urllib.request import urlopen

        page, seen = int(self.options.get("first", 1)), set()
        for _ in range(int(self.options.get("most", 30))):
            if page in seen:
                return
            seen.add(page)
            with urlopen(self.options["url"].replace("{page}", str(page)), timeout=60) as r:  # noqa: S310
                text = r.read().decode("utf-8")
            yield page, text
            body = json.loads(text)
            body = body if isinstance(body, dict) else {"items": body}
            got = max((len(v) for v in body.values() if isinstance(v, list)), default=0)
            nxt = following(page, int(self.options.get("size", 20)), got, body)
            if nxt is None:
                return
            page = nxt
