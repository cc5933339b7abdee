"""Page boilerplate mixed with main content (problem 3).

Line-block distribution. Markup is stripped, every line gets the length of its own text as weight, and the weights are
summed over a sliding window of ``WINDOW`` lines. Where the sum of the lines ahead surges to ``SURGE`` the main body
begins, where the sum of those behind dives below it the body ends; the lines that weigh anything in between are kept. A page that never
reaches ``SURGE`` is read by half of its own highest sum.

Plain lengths confuse short lines of an article (headings, list entries) with the menus round it and teasers with
paragraphs. So a line weighs nothing if it is not the page's own text:

* furniture: the line's template (digits and the site's name are slots) stands on a large share of the site's pages, or is
  frequent on most of the sites that have it at all, or names the site and is not the only line of its template;
* links: rows of entries between separators, paths, lines that are only a link;
* teasers: after a line that announces them, lines in the form of page titles with at most a sentence each, and short
  lines before the last one that precedes the text. What a page title looks like, and which lines announce teasers, is
  counted over all pages.

The counts cover all pages and are made by aggregation. Words and title forms are counted in ``BUCKETS`` buckets by hash,
so the two models that every task gets have a fixed size; announcing lines are joined to the pages. A page is then read on
its own. Null and empty texts have no lines; a page whose site is unknown is read by the counts over all sites.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm import words as W
from siltworks.session import small, stored

#: Share of a site's pages; share of the pages of all sites that have a line; pages that a site needs.
SITE_SHARE, WIDE_SHARE, SITE_PAGES = 0.25, 0.12, 4
#: Window in lines; sum of a window from which it belongs to the body.
WINDOW, SURGE = 7, 40
#: Buckets of the two models; count from which a bucket says anything, whatever the size of the table.
BUCKETS, FLOOR = 1 << 16, 5
#: Mean log odds of its words from which a sentence is a notice.
NOTICE = 1.0

# Java's regular expressions of a line's parts
_LINK, _BULLET = r"\[([^\]]*)\]\([^)]*\)", r"(?U)^\s*(?:[-*•·‣–+]|\d{1,3}[.)])\s+"
_PATH, _ROW = r"(?U)\S\s*[>›»→]\s+\S", r"(?U)\s+[|·•/]\s+|\s{3,}|\t"
_STOP, _SENTENCE = r"(?U)[.!?…:;][\"”»“’)\]]*$", r"(?U)[.!?…]+[\"”»“’)\]]*(?=\s+\S|$)"
_WORD = r"\p{L}{2,}"
_ENDS = r"(?U)^\s+|\s+$"
FORM = re.compile(r"[^\W\d_]+")


def template(line: Column, name: Column) -> Column:
    """A line with letter case, digits, link targets and the site's name set aside."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"\]\([^)]*\)", "]()"), r"\p{Nd}+", "0")
    whole = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.array_join(F.split(name, ""), "[ -]?"), F.lit(r"(?![\p{L}\p{N}])"))
    return F.trim(F.when(F.length(name) > 3, F.regexp_replace(bare, whole, "<site>")).otherwise(bare))


def _pages(pages: DataFrame, files: DataFrame, key: str, file_key: str, text: str) -> DataFrame:
    """(page, host, t) of the pages with an id."""
    of = files.select(F.col(file_key).alias("_f"), W.host(F.col("source_url")).alias("host")).where(F.col("_f").isNotNull() & F.col("host").isNotNull())
    of = stored(of.groupBy("_f").agg(F.min("host").alias("host")), "page-sites")
    return pages.where(F.col(key).isNotNull()).select(F.col(key).alias("page"), F.col(file_key).alias("_f"), F.col(text).alias("t")).join(small(of, 200), "_f", "left").drop("_f")


def _read(rows: Column) -> Column:
    """Of an array of (at, tpl, mark, line): what each line says; its text without markup, its kind, its sentences, the buckets of its words.

    Each step is bound before the next one uses it, so no expression is worked out twice.
    """
    keep = lambda r: [r[c].alias(c) for c in ("at", "tpl", "mark")]
    raw = F.transform(rows, lambda r: F.struct(*keep(r), F.regexp_replace(r["line"], _ENDS, "").alias("raw")))

    def markup(r: Column) -> Column:
        linked = F.contains(r["raw"], F.lit("]("))
        only = linked & r["raw"].rlike(_LINK) & (F.regexp_replace(F.regexp_replace(F.regexp_replace(r["raw"], _BULLET, ""), _LINK, ""), r"^[ |·-]+|[ |·-]+$", "") == "")
        return F.struct(*keep(r), only.alias("only"), F.when(linked, F.regexp_replace(r["raw"], _LINK, "$1")).otherwise(r["raw"]).alias("plain"))

    def text(r: Column) -> Column:
        bare = F.regexp_replace(r["plain"], _BULLET, "")
        own = F.regexp_replace(F.regexp_replace(bare, "^#+", ""), _ENDS, "")
        return F.struct(*keep(r), r["only"].alias("only"), F.startswith(r["plain"], F.lit("#")).alias("head"), (bare != r["plain"]).alias("bullet"), own.alias("text"))

    def cells(r: Column) -> Column:
        own = F.filter(F.split(r["text"], _ROW), lambda c: c.rlike(r"(?U)\S"))
        return F.struct(r.alias("r"), own.alias("cells"), F.length(r["text"]).alias("n"))

    def kind(c: Column) -> Column:
        r, n, k = c["r"], c["n"], F.size(c["cells"])
        figures = F.exists(c["cells"], lambda x: x.rlike(r"\p{Nd}") & ~x.rlike(r"\(\p{Nd}+\)"))
        shape = (
            F.when((n < 160) & ~F.substring(r["text"], -1, 1).isin(".", "!", "?") & r["text"].rlike(_PATH), "path")
            .when((k >= 3) & (n / k < 40) & ~figures & ~r["text"].rlike(_STOP), "links")
            .when(r["only"], "link")
            .when(k >= 2, "row")
            .when(r["head"], "head")
            .when(r["bullet"], "item")
            .when((n > 110) | r["text"].rlike(_STOP), "text")
            .otherwise("short")
        )
        sents = F.size(F.regexp_extract_all(r["text"], F.lit(_SENTENCE), F.lit(0)))
        w = F.transform(F.array_distinct(F.regexp_extract_all(F.lower(r["text"]), F.lit(_WORD), F.lit(0))), lambda x: F.pmod(F.crc32(x), F.lit(BUCKETS)).cast("int"))
        return F.struct(*keep(r), r["text"].alias("text"), shape.alias("kind"), sents.alias("sents"), w.alias("w"))

    return F.transform(F.transform(F.transform(F.transform(raw, markup), text), cells), kind)


def _lines(p: DataFrame) -> DataFrame:
    """(page, host, copy, at, line, tpl, named) of the non-blank lines; copy: the same for the same text; named: the site's name is in it."""
    rows = p.select("page", "host", F.xxhash64("t").alias("copy"), F.posexplode(F.split("t", "\n")).alias("at", "line")).where(F.col("line").rlike(r"(?U)\S"))
    name = F.coalesce(F.regexp_replace(F.regexp_extract("host", r"^([^.\-]+)", 1), "[^a-z0-9]", ""), F.lit(""))
    rows = rows.withColumn("_t", template(F.col("line"), name))
    return rows.select("page", "host", "copy", "at", "line", F.xxhash64("_t").alias("tpl"), F.contains(F.col("_t"), F.lit("<site>")).alias("named"))


def _flagged(lines: DataFrame, size: DataFrame) -> DataFrame:
    """(page, at, tpl, mark, text, kind, sents, w): arrays of each page's lines in order; mark 2: furniture of its site, 1: of many sites.

    size: (host, n), the distinct texts of each site; copies of a page count once.
    """
    seen = lines.select("copy", "host", "tpl", "named").distinct()
    count = stored(seen.groupBy("host", "tpl").agg(F.count("*").alias("k"), F.max("named").alias("named")), "line-counts")
    size = stored(size, "site-sizes")
    share = stored(count.join(small(size, 80), "host").where("n >= %d" % SITE_PAGES).withColumn("share", F.col("k") / F.col("n")), "line-shares")
    often = (F.col("share") >= SITE_SHARE) & (F.col("k") >= 5) | (F.col("share") >= 2 * SITE_SHARE) & (F.col("k") >= 3)
    own = share.where(often).select("host", "tpl", F.lit(2).alias("own"))
    # an entry of a few sites' menus may be a heading elsewhere: most sites that have the line must have it often
    wide = share.where(F.col("n") >= 2 * SITE_PAGES).groupBy("tpl").agg(F.percentile_approx("share", 0.5).alias("middle"), (F.sum("k") / F.sum("n")).alias("pooled"), F.count("*").alias("sites"))
    wide = wide.where((F.col("sites") >= 2) & (F.col("middle") >= WIDE_SHARE) & (F.col("pooled") >= WIDE_SHARE)).select("tpl", F.lit(1).alias("wide"))
    # a line that names the site is furniture if others are like it
    named = count.where("named").groupBy("tpl").agg(F.sum("k").alias("k")).where("k > 1").select("tpl", F.lit(2).alias("wide"))
    own, wide = stored(own, "site-furniture"), stored(wide.unionByName(named).groupBy("tpl").agg(F.max("wide").alias("wide")), "wide-furniture")
    out = lines.join(small(own, 60), ["host", "tpl"], "left").join(small(wide, 24), "tpl", "left")
    mark = F.greatest(F.coalesce("own", F.lit(0)), F.coalesce("wide", F.lit(0)))
    rows = out.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("at", "tpl", mark.alias("mark"), "line"))).alias("rows"))
    rows = rows.select("page", _read(F.col("rows")).alias("rows"))
    return stored(rows.select("page", *(F.col(f"rows.{c}").alias(c) for c in ("at", "tpl", "mark", "text", "kind", "sents", "w"))), "page-lines")


class Line:
    """A line of a page: its text without markup and what its shape says; score: mean log odds of its words as a notice."""

    __slots__ = ("at", "text", "tpl", "mark", "kind", "sents", "score")

    def __init__(self, at: int, tpl: int, mark: int, text: str, kind: str, sents: int, score: float = 0.0):
        self.at, self.tpl, self.mark, self.text, self.kind, self.sents, self.score = at, tpl, mark, text, kind, sents, score

    @property
    def off(self) -> bool:
        return bool(self.mark) or self.kind in ("path", "links")

    @property
    def titled(self) -> bool:
        return not self.off and self.kind in ("short", "link", "head") and len(self.text) < 110


def announces(ls: list[Line], i: int) -> bool:
    """Whether two titles, or a title, a sentence and a title, follow line i."""
    kinds = ["t" if x.titled else "s" if x.kind == "text" and not x.off else "-" for x in ls[i + 1 : i + 4]]
    return "".join(kinds[:2]) == "tt" or "".join(kinds) == "tst"


def form(text: str) -> list[int]:
    """What is counted of a title or heading, as buckets: its words, their places at the ends, their number."""
    w = FORM.findall(text.lower())
    parts = [*w, *(("^" + w[0], "$" + w[-1], f"n{min(len(w), 8)}") if w else ()), ":" if ":" in text else "-"]
    return [zlib.crc32(x.encode()) % BUCKETS for x in parts]


def own_text(x: Line) -> bool:
    return x.kind in ("item", "row") or x.kind == "text" and x.sents > 1


def observed(ls: list[Line], forms: np.ndarray) -> Iterator[tuple[int, bool]]:
    """(template, whether titles follow) of the furniture lines that may announce teasers; counts the forms of titles and headings in ``forms``."""
    for i, x in enumerate(ls):
        if x.mark and x.kind in ("short", "head", "text"):
            yes = announces(ls, i)
            yield x.tpl, yes
            if yes and ls[i + 1].kind in ("short", "link"):
                for w in form(ls[i + 1].text):
                    forms[0, w] += 1
        if x.titled and x.kind != "link" and 0 < i < len(ls) - 1:
            a, b = ls[i - 1], ls[i + 1]
            if not a.off and own_text(a) and b.kind == "text" and not b.off:
                for w in form(x.text):
                    forms[1, w] += 1


def odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of two kinds of text by bucket, from their counts (2, BUCKETS); 0 counts give the odds of the totals."""
    total = counts.sum(axis=1)
    return np.log((counts[0] + 0.5) / (total[0] + 1)) - np.log((counts[1] + 0.5) / (total[1] + 1))


def article(ls: list[Line], announcers: set[int], titles: np.ndarray, window: int | None = None) -> list[int]:
    """Places of the lines that belong to the page's own article. titles: log odds of the forms of titles."""
    solid = ("text", "item", "row")
    title = lambda text: float(sum(titles[w] for w in form(text)))
    for i, x in enumerate(ls[1:-1], 1):
        # an entry of other sites' menus that heads a paragraph here
        if x.mark == 1 and x.kind == "short" and x.tpl not in announcers and not any(c.isdigit() for c in x.text):
            before, after = ls[i - 1], ls[i + 1]
            if before.kind in solid and not before.off and after.kind in solid and not after.off and title(x.text) < -1:
                x.mark = 0
    for x in ls:
        # a notice that no other page has, told by its words
        if not x.mark and (x.kind == "text" and len(x.text) > 60 or x.kind == "short" and len(x.text.split()) > 4) and x.score > NOTICE:
            x.mark = 1
    zero = [x.off or x.kind == "link" or (x.kind == "text" and x.text.endswith("…")) for x in ls]
    odds = [title(x.text) if x.titled else -9.0 for x in ls]
    # a title has the form of one; among teasers, any short line that heads nothing is one
    heads = [i + 1 < len(ls) and ls[i + 1].kind in solid and not ls[i + 1].off for i in range(len(ls))]
    is_title = [x.titled and (x.kind == "link" or odds[i] > 0 or not heads[i]) for i, x in enumerate(ls)]
    begun = False
    i = 0
    title_at = None
    while i < len(ls):
        x = ls[i]
        if x.tpl in announcers and x.kind in ("short", "head", "text") and i + 1 < len(ls) and (is_title[i + 1] or ls[i + 1].kind == "link"):
            zero[i] = True
            j, last, excerpts = i + 1, None, 0
            style = ls[j].kind  # a title in another style is the article's own
            teaser = lambda q: q < len(ls) and ls[q].kind == style and (is_title[q] or style == "link")  # noqa: B023, E731
            while teaser(j):
                last = j
                j += 1
                if j < len(ls) and ls[j].kind == "text" and not ls[j].off and (ls[j].text.endswith("…") or ls[j].sents <= 2):
                    then = teaser(j + 1)
                    if ls[j].sents == 2 and not ls[j].text.endswith("…") and not (then and (ls[j + 1].kind == "link" or odds[j + 1] > 0)):
                        break
                    if ls[j].text.endswith("…") or then or (excerpts and begun) or (last is not None and ls[last].kind == "link"):
                        excerpts += 1
                        j += 1
                    else:
                        break
            end = j
            if not begun and last is not None and style != "link" and last > i + 1 and not (end < len(ls) and is_title[end]):
                nxt = next((ls[q] for q in range(last + 1, len(ls)) if not ls[q].off), None)
                if nxt is not None and not (nxt.kind == "text" and nxt.text.endswith("…")):
                    end, title_at, begun = last, last, True  # the last title of the first run is the article's own
            for q in range(i, end):
                zero[q] = True
            i = max(end, i + 1)
            continue
        if not zero[i] and x.kind == "text":
            begun = True
        i += 1
    weight = [0 if z else len(x.text) for x, z in zip(ls, zero, strict=True)]

    first = next((q for q in range(len(ls)) if weight[q] and ls[q].kind == "text"), None)
    if first is not None:
        # of the short lines before the text only the last can be its title
        own = title_at if title_at is not None and title_at <= first else next((q for q in range(first - 1, -1, -1) if weight[q]), first)
        for q in range(own if own == title_at or ls[own].kind in ("short", "head") else first):
            weight[q] = 0
    return [ls[q].at for q in between(weight, WINDOW if window is None else window) if weight[q]]


def between(weight: list[int], window: int) -> list[int]:
    """Places between the surges and dives of the sums of ``weight`` over ``window`` lines: a surge is where the lines ahead reach ``SURGE``, a dive where those behind no longer do."""
    w = np.asarray(weight, np.int64)
    c = np.concatenate([[0], np.cumsum(w)])
    at = np.arange(len(w))
    ahead, behind = c[np.minimum(at + window, len(w))] - c[at], c[at + 1] - c[np.maximum(at + 1 - window, 0)]
    level = min(SURGE, int(ahead.max(initial=0)) / 2)
    inside = ((ahead >= level) | (behind >= level)) & (ahead + behind > 0)
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    return [q for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True) for q in range(a, b)]


def _pages_of(b: pa.RecordBatch, notices: np.ndarray | None = None) -> Iterator[list[Line]]:
    """The lines of each page of a batch (page, at, tpl, mark, text, kind, sents, w); notices: (2, BUCKETS) log odds and whether they are known."""
    w = b.column(7).flatten()
    if notices is None or not len(w):
        score = np.zeros(len(w))
    else:
        off = w.offsets.to_numpy().astype(np.int64)
        own = w.values.to_numpy()[off[0] : off[-1]]
        known = np.concatenate([[0], np.cumsum(notices[1][own])])
        sums = np.concatenate([[0], np.cumsum(notices[0][own] * notices[1][own])])
        off = off - off[0]
        score = (sums[off[1:]] - sums[off[:-1]]) / np.maximum(5, known[off[1:]] - known[off[:-1]])
    flat = [b.column(j).flatten().to_pylist() for j in range(1, 7)]
    lo = 0
    for n in b.column(1).value_lengths().to_pylist():
        yield [Line(*r) for r in zip(*(c[lo : lo + n] for c in flat), score[lo : lo + n].tolist(), strict=True)]
        lo += n


def _notice_counts(b: pa.RecordBatch, counts: np.ndarray) -> None:
    """Add the words of a batch's furniture and of its articles to ``counts``."""
    w = b.column(7).flatten()
    if not len(w):
        return
    mark, sents = (b.column(j).flatten().to_numpy() for j in (3, 6))
    kind = np.array(b.column(5).flatten().to_pylist())
    lens, own = w.value_lengths().to_numpy(), w.flatten().to_numpy()
    yes = np.isin(kind, ("text", "short")) & (mark == 2)
    no = (np.isin(kind, ("item", "row")) | (kind == "text") & (sents > 1)) & (mark == 0)
    for j, take in enumerate((yes, no)):
        counts[j] += np.bincount(own[np.repeat(take, lens)], minlength=BUCKETS)


def body_places(pages: DataFrame, files: DataFrame, key: str = "page_id", file_key: str = "file_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(``key``, line_no): the lines of each page that belong to its own article; lines are counted from 1."""
    own = _pages(pages, files, key, file_key, text)
    size = own.where(F.col("t").rlike(r"(?U)\S")).select(F.xxhash64("t").alias("copy"), "host").distinct().groupBy("host").agg(F.count("*").alias("n"))
    rows = _flagged(_lines(own), size)

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notice, forms = np.zeros((2, BUCKETS), np.int64), np.zeros((2, BUCKETS), np.int64)
        out = pa.schema([("what", pa.string()), ("k", pa.int64()), ("yes", pa.int64()), ("no", pa.int64())])
        for b in batches:
            _notice_counts(b, notice)
            seen = pd.DataFrame([x for ls in _pages_of(b) for x in observed(ls, forms)], columns=["k", "yes"])
            seen = seen.astype({"k": "int64", "yes": "int64"}).groupby("k")["yes"].agg(["sum", "count"]).reset_index()
            yield pa.RecordBatch.from_pydict({"what": ["a"] * len(seen), "k": seen["k"], "yes": seen["sum"], "no": seen["count"] - seen["sum"]}, out)
        for what, c in (("w", notice), ("f", forms)):
            at = np.flatnonzero(c.any(axis=0))
            yield pa.RecordBatch.from_pydict({"what": [what] * len(at), "k": at, "yes": c[0, at], "no": c[1, at]}, out)

    counts = rows.mapInArrow(observe, "what string, k long, yes long, no long").groupBy("what", "k").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    counts = stored(counts, "page-forms")
    models = {"w": np.zeros((2, BUCKETS), np.int64), "f": np.zeros((2, BUCKETS), np.int64)}
    for r in counts.where("what <> 'a'").toLocalIterator():  # at most two rows a bucket
        models[r.what][:, r.k] = r.yes, r.no
    titles = odds(models["f"])
    notices = np.stack([odds(models["w"]), (models["w"].sum(axis=0) >= FLOOR).astype(float)])

    known = stored(counts.where((F.col("what") == "a") & (F.col("yes") >= 3) & (F.col("yes") >= F.col("no"))).select(F.col("k").alias("tpl")), "announcing-lines")
    told = rows.select("page", F.explode(F.array_distinct("tpl")).alias("tpl")).join(small(known, 24), "tpl", "left_semi").groupBy("page").agg(F.collect_list("tpl").alias("announcers"))
    told = rows.join(told, "page", "left").select(*rows.columns, F.coalesce("announcers", F.array().cast("array<long>")).alias("announcers"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, places = [], []
            for i, (ls, announcers) in enumerate(zip(_pages_of(b, notices), b.column(8).to_pylist(), strict=True)):
                own = [q + 1 for q in article(ls, set(announcers), titles, window)]
                keys += [i] * len(own)
                places += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(places, pa.int32())], names=["page", "line_no"])

    kind = pages.schema[key].dataType.simpleString()
    return told.mapInArrow(pick, f"page {kind}, line_no int").withColumnRenamed("page", key).distinct()


def bodies(pages: DataFrame, files: DataFrame, key: str = "page_id", file_key: str = "file_id", text: str = "text") -> DataFrame:
    """All rows of ``pages`` with ``body``: the lines of the page's own article; empty if there are none, null for null texts."""
    keep = body_places(pages, files, key, file_key, text).groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_set("line_no")).alias("_keep"))
    out = pages.join(keep, F.col(key) == F.col("_k"), "left").drop("_k")
    own = F.filter(F.split(F.col(text), "\n"), lambda x, i: F.coalesce(F.array_contains("_keep", (i + 1).cast("int")), F.lit(False)))
    return out.withColumn("body", F.array_join(own, "\n")).drop("_keep")
