"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltworks.functions.text import SPACE, strip

_SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"

# Suffixes of paths that are not pages.
SKIP = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".zip", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".mp3", ".mp4", ".avi", ".mov", ".css", ".js", ".json", ".xml", ".csv")


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 host with port, 3 path, 4 query with its mark; empty if absent."""
    return F.regexp_extract(strip(F.coalesce(url, F.lit(""))), _SPLIT, n)


def normal(url: Column, keep_query: bool = False) -> Column:
    """Scheme and host in lower case, no fragment, no slash at the end; empty if it is no http(s) URL with a host."""
    scheme, host = F.lower(part(url, 1)), F.lower(part(url, 2))
    path = F.regexp_replace(part(url, 3), "^$", "/")
    out = F.concat(scheme, F.lit("://"), host, path, part(url, 4) if keep_query else F.lit(""))
    out = F.when(path == "/", out).otherwise(F.regexp_replace(out, "/+$", ""))
    return F.when(scheme.isin("http", "https") & (host != ""), out).otherwise("")


def in_scope(url: Column, root_host: str, subdomains: bool = False, root_path: str = "/", by_path: bool = False) -> Column:
    """Whether a URL belongs to the site (and path) that a crawl began at."""
    host = F.lower(part(url, 2))
    ok = F.lower(part(url, 1)).isin("http", "https") & ((host == root_host) | (F.endswith(host, F.lit("." + root_host)) if subdomains else F.lit(False)))
    return ok & F.startswith(F.regexp_replace(part(url, 3), "^$", "/"), F.lit(root_path.rstrip("/") or "/")) if by_path else ok


def allowed(url: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a URL holds one of ``include`` (if given) and none of ``exclude``, without case."""
    low = F.lower(url)
    any_of = lambda terms: F.exists(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(low, t))
    return (any_of(include) if include else F.lit(True)) & (~any_of(exclude) if exclude else F.lit(True))


def page_like(url: Column) -> Column:
    """Whether the path does not end like a file that is no page."""
    path = F.lower(part(url, 3))
    return ~F.exists(F.array(*map(F.lit, SKIP)), lambda e: F.endswith(path, e))


def title(url: Column) -> Column:
    """The last part of the path in words, else the host."""
    path = F.regexp_replace(part(url, 3), "/+$", "")
    last = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "[-_]+", " "), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(last == "", part(url, 2)).otherwise(last)


def slug(url: Column) -> Column:
    """The path as a file name; ``home`` for the root."""
    path = F.regexp_replace(part(url, 3), "^/+|/+$", "")
    out = F.regexp_replace(F.regexp_replace(F.when(path == "", "home").otherwise(path), "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.when(out == "", "page").otherwise(out)


def page_filename(url: Column, page_title: Column) -> Column:
    """Slug, up to 40 characters of the title and eight digits of the URL's MD5."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(page_title, F.lit("")), "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")
    digest = F.substring(F.md5(F.encode(url, "UTF-8")), 1, 8)
    return F.concat(F.array_join(F.filter(F.array(slug(url), F.substring(t, 1, 40), digest), lambda x: x != ""), "_"), F.lit(".html"))
