"""HTML and Markdown as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltworks.functions.text import squeeze, strip


def plain(html: Column) -> Column:
    """Tags as blanks, entities of the five basic kinds as characters, white space squeezed."""
    t = squeeze(F.regexp_replace(html, r"(?s)<[^>]+>", " "))
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(c))
    return t


def body(html: Column) -> Column:
    """Without scripts and styles."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(?:script|style)>", " ")


def title(html: Column) -> Column:
    """The page's title; empty without one."""
    return plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def headings(html: Column) -> Column:
    """(level, text) of the headings, by level, then place."""
    one = lambda n: F.transform(F.regexp_extract_all(body(html), F.lit(rf"(?is)<h{n}[^>]*>(.*?)</h{n}>"), F.lit(1)), lambda x: F.struct(F.lit(n).alias("level"), plain(x).alias("text")))
    return F.concat(*(one(n) for n in range(1, 7)))


def links(html: Column) -> Column:
    """(url, text) of the links in order."""
    tag = r'(?is)<a\s[^>]*href=["\']([^"\']+)["\'][^>]*>(.*?)</a>'
    b = body(html)
    return F.zip_with(F.regexp_extract_all(b, F.lit(tag), F.lit(1)), F.regexp_extract_all(b, F.lit(tag), F.lit(2)), lambda u, t: F.struct(u.alias("url"), plain(t).alias("text")))


def to_markdown(html: Column, most_links: int = 50) -> Column:
    """Title, text and the first links of a page as Markdown."""
    own = links(html)
    head = F.when(title(html) != "", F.concat(F.lit("# "), title(html), F.lit("\n")))
    listed = F.transform(F.slice(own, 1, most_links), lambda x: F.concat(F.lit("- ["), x["text"], F.lit("]("), x["url"], F.lit(")")))
    more = F.when(F.size(own) > most_links, F.concat(F.lit("... and "), (F.size(own) - most_links).cast("string"), F.lit(" more")))
    tail = F.when(F.size(own) > 0, F.concat(F.lit("\n## Links\n"), F.concat_ws("\n", listed, more)))
    return F.concat_ws("\n", head, F.lit("**Format**: HTML Document\n\n---\n\n## Content\n"), plain(F.regexp_replace(body(html), r"(?is)<head.*?</head>", " ")), tail)


def distinct_blocks(md: Column) -> Column:
    """Blocks between blank lines, each only where it first stands; case and white space do not count."""
    blocks = F.filter(F.transform(F.split(md, r"\n\s*\n"), strip), lambda b: b != "")
    pairs = F.transform(blocks, lambda b: F.struct(b.alias("b"), F.lower(squeeze(b)).alias("k")))
    # the array of one array binds the pairs to a variable, so their keys are made once and not for every block
    first = F.transform(F.array(pairs), lambda ps: F.filter(ps, lambda p, i: F.array_position(F.transform(ps, lambda x: x["k"]), p["k"]) == i + 1))
    return F.array_join(F.transform(F.element_at(first, 1), lambda x: x["b"]), "\n\n")


def without_title(md: Column, page_title: Column) -> Column:
    """Without the first line if it repeats the title, and without the blank lines after it."""
    t = F.regexp_replace(md, r"^\s+", "")
    first = strip(F.regexp_replace(F.regexp_extract(t, r"^([^\n]*)", 1), "^#+", ""))
    return F.when((first == strip(page_title)) & (first != ""), F.regexp_replace(t, r"^[^\n]*\n?\s*", "")).otherwise(md)


def table_row(cells: Column) -> Column:
    """A Markdown table row of an array of cells."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: squeeze(c)), " | "), F.lit(" |"))
