"""Noise in text from scanned pages (problem 5).

Furniture: lines are folded so that misread letters and numbers do not matter; a folded line that returns at the page
edges of its file, or whose ending stands almost only at page edges of its file or over all files, is a running header or
footer. Page numbers are numbers alone on a line at an edge or beside such furniture.

Words: the vocabulary with its counts is taken from all scanned text. A word broken at a line end is joined with or
without its hyphen, whichever the vocabulary knows better. What is misread for what is learned from the vocabulary too:
pairs of a rare and a much more frequent word that differ in one or two letters vote for that exchange, and exchanges
that hold a share of the votes in several surroundings count; what digits and signs look like is given. A word that the vocabulary hardly knows is misread if
undoing such an exchange gives a word that is much more frequent; this is decided once for each distinct word and joined
back to the places.

No file is ever gathered in one task: rows meet their file's templates and their next row in joins, and paragraphs that
run on over rows are numbered by block. Shares are taken of a file's rows or of a line ending's own places, never of the
table. A page scanned twice is read twice and continued by its successor both times; in ``paragraphs`` only its first
scan is used. Null and empty texts have no lines. Rows without file or page number are read alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.operators.neighbours import with_previous
from siltworks.session import small, stored

HYPHENS = "-\xad¬‐‑"
EDGE, RATIO = 3, 10
#: Characters of a line whose ending may tell that it is furniture; body lines are as long as the column.
BRIEF = 70
#: Pages of a block for numbering paragraphs, and of a piece of a paragraph.
BLOCK = 512
#: Uses of a word from which it can show what a rarer one was; surroundings and share of all votes that an exchange needs.
KNOWN, PLACES, VOTES = 12, 3, 0.001

# Letters and pairs that look alike in print; folded to one of them.
_FOLD_PAIRS = (("rn", "m"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("ﬁ", "fi"), ("ﬂ", "fl"))
_FOLD = ("01i5@98hcft|", "olisagbbeeel")
# Letters that digits and signs look like; letters read for letters are learned.
SIGNS = (("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("@", "a"), ("9", "g"), ("8", "b"), ("6", "b"), ("6", "ó"), ("2", "z"), ("ﬁ", "fi"), ("ﬂ", "fl"))
_ROMAN = r"(?=[mdclxvi])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUMBER = rf"^(?:\p{{Nd}}+|{_ROMAN}|(?=.*\p{{Nd}})[\p{{Nd}}lo]{{1,5}}|l[lo]{{1,2}})$"
_STRIP = r"(?U)^[^\w@]+|[^\w@]+$"
STRIP = re.compile(r"^[^\w@]+|[^\w@]+$")
LETTER = re.compile(r"[^\W\d_]")


def folded(line: Column) -> Column:
    """A line without case and numbers, with letters that are misread for each other made equal."""
    tokens = F.filter(F.split(F.lower(line), r"(?U)\s+"), lambda t: t != "")
    both = F.transform(tokens, lambda t: F.struct(t.alias("t"), F.regexp_replace(t, _STRIP, "").alias("b")))
    out = F.array_join(F.transform(both, lambda x: F.when(x["b"].rlike(_NUMBER), F.replace(x["t"], x["b"], F.lit("#"))).otherwise(x["t"])), " ")
    for a, b in _FOLD_PAIRS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, *_FOLD)


def ending(tpl: Column) -> Column:
    """The last two words of a folded line; null if it has none."""
    w = F.filter(F.split(tpl, " "), lambda t: t.rlike(r"[\p{L}\p{N}]") & ~F.contains(t, F.lit("#")))
    return F.when(F.size(w) > 0, F.array_join(F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)), " "))


def _lines(rows: DataFrame) -> DataFrame:
    """One row for each scan with arrays of its non-blank lines: place, text, template, ending (hashes), number alone, plain number, no sentence's end."""
    own = F.filter(F.transform(F.split(F.coalesce("t", F.lit("")), "\n"), lambda x, i: F.struct((i + 1).alias("no"), x.alias("text"))), lambda r: r["text"].rlike(r"(?U)\S"))
    told = F.transform(own, lambda r: F.struct(r.alias("r"), folded(r["text"]).alias("tpl")))
    told = F.transform(told, lambda x: F.struct(x["r"].alias("r"), x["tpl"].alias("tpl"), F.when(F.length(x["r"]["text"]) < BRIEF, ending(x["tpl"])).alias("tail")))
    full = F.transform(
        told,
        lambda x: F.struct(
            x["r"]["no"].alias("no"), x["r"]["text"].alias("text"), F.xxhash64(x["tpl"]).alias("tpl"), F.xxhash64(x["tail"]).alias("tail"), x["tail"].isNotNull().alias("ends"),
            (F.contains(x["tpl"], F.lit("#")) & ~x["tpl"].rlike(r"\p{L}")).alias("number"), (x["tpl"] == "#").alias("plain"), (~x["r"]["text"].rlike(r"(?U)[.,;]\s*$")).alias("head"),
        ),
    )
    rows = rows.select("id", "file", "page", full.alias("l"))
    return stored(rows.select("id", "file", "page", *(F.col(f"l.{c}").alias(c) for c in ("no", "text", "tpl", "tail", "ends", "number", "plain", "head"))), "scan-lines")


def _marked(lines: DataFrame) -> DataFrame:
    """``lines`` with ``marks`` (place in the arrays: 1 known template of the file, 2 ending of furniture, 3 both) and ``alone`` (the file has numbers alone)."""
    size = stored(lines.select("file", "page").distinct().groupBy("file").agg(F.count("*").alias("rows")), "scan-sizes")
    each = lines.select("id", "file", F.coalesce("page", F.lit(0)).alias("page"), F.size("no").alias("of"), F.posexplode(F.arrays_zip("tpl", "tail", "ends", "head")).alias("k", "l")).select("id", "file", "page", "of", "k", "l.*")
    each = each.withColumn("edge", (F.col("k") < EDGE) | (F.col("k") >= F.col("of") - EDGE))
    # a page scanned twice counts once
    often = each.where("edge and head").select("file", "page", "tpl").distinct().groupBy("file", "tpl").agg(F.count("*").alias("n")).join(small(size, 48), "file")
    known = stored(often.where((F.col("n") >= 2) & (F.col("n") >= 0.2 * F.col("rows"))).select("file", "tpl", F.lit(1).alias("known")), "scan-furniture")
    by_file = each.where("ends").groupBy("file", "tail").agg(F.count("*").alias("n"), F.sum(F.col("edge").cast("int")).alias("e"), F.count_distinct("page").alias("pages"))
    by_file = stored(by_file, "scan-endings")
    here = by_file.join(small(size, 48), "file").where((F.col("pages") >= 6) & (F.col("pages") >= 0.3 * F.col("rows")) & (F.col("e") >= 0.85 * F.col("n"))).select("file", "tail", F.lit(2).alias("here"))
    wide = by_file.groupBy("tail").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).where((F.col("n") >= 16) & (F.col("e") >= 0.8 * F.col("n"))).select("tail", F.lit(2).alias("wide"))
    here, wide = stored(here, "scan-endings"), stored(wide, "scan-endings")
    each = each.join(small(known, 64), ["file", "tpl"], "left").join(small(here, 64), ["file", "tail"], "left").join(small(wide, 24), "tail", "left")
    mark = F.coalesce("known", F.lit(0)) + F.when(F.col("ends"), F.coalesce("here", "wide", F.lit(0))).otherwise(0)
    marks = each.select("id", "k", mark.alias("mark")).where("mark > 0").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("k", "mark"))).alias("marks"))
    alone = known.where(F.col("tpl") == F.xxhash64(F.lit("#"))).select("file", F.lit(True).alias("alone"))
    return lines.join(marks, "id", "left").join(small(alone, 48), "file", "left")


def furniture(texts: list[str], number: list[bool], plain: list[bool], marks: dict[int, int], alone: bool) -> set[int]:
    """Places of running headers, footers and page numbers among the lines of a scan."""
    bad = {k for k, m in marks.items() if not number[k]}
    marked = {k for k, m in marks.items() if number[k] and not plain[k] and m & 1}
    bad |= marked
    if not any(number):
        return bad
    top = 0
    while top < len(texts) and (top in bad or number[top]) and top < EDGE + 1:
        bad.add(top)
        top += 1
    low = len(texts) - 1
    while low >= top and (low in bad or number[low]) and low >= len(texts) - EDGE - 1:
        if number[low] and not (alone or low in marked or low + 1 in bad):
            break
        bad.add(low)
        low -= 1
    value = {k: re.sub(r"\W", "", texts[k]).lower() for k in range(len(texts)) if number[k]}
    edges = {int(value[k]) for k in bad if k in value and value[k].isdigit()}
    for k in value:
        if k not in bad and (k - 1 in bad or k + 1 in bad or (value[k].isdigit() and alone and edges & {int(value[k]) - 1, int(value[k]) + 1})):
            bad.add(k)
    return bad


def bare(token: str) -> str:
    return token.lower() if token.isalnum() else STRIP.sub("", token).lower()


def _parsed(lines: DataFrame) -> DataFrame:
    """One row for each scan: furniture lines, words by line, broken words, and what its neighbours need."""
    columns = {"furniture": pa.list_(pa.int32()), "line": pa.list_(pa.int32()), "w": pa.list_(pa.string()), "cut": pa.list_(pa.int32()), "a": pa.list_(pa.string()), "b": pa.list_(pa.string()), "first": pa.string(), "open_line": pa.int32(), "open": pa.string()}

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in columns}
            for no, texts, number, plain, marks, alone in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True):
                bad = furniture(texts, number, plain, dict(marks or ()), bool(alone))
                body = [q for q in range(len(texts)) if q not in bad]
                row: dict[str, list] = {c: [] for c in ("line", "w", "cut", "a", "b")}
                first = opened = None
                skip = False
                for at, q in enumerate(body):
                    toks = texts[q].split()
                    if at == 0:
                        first = toks[0]
                    last = toks[-1]
                    if skip:
                        toks = toks[1:]
                    skip = False
                    if toks and last[-1] in HYPHENS and len(last) > 1 and LETTER.search(last[-2]):
                        if at + 1 < len(body):
                            row["cut"].append(no[q])
                            row["a"].append(last)
                            row["b"].append(texts[body[at + 1]].split()[0])
                            skip = True
                        else:
                            opened = (no[q], last)
                        toks = toks[:-1]
                    own = [w for w in map(bare, toks) if len(w) > 1 and (w.isalpha() or LETTER.search(w))]
                    row["w"] += own
                    row["line"] += [no[q]] * len(own)
                for c, v in row.items():
                    out[c].append(v)
                out["furniture"].append([no[q] for q in sorted(bad)])
                out["first"].append(first)
                out["open_line"].append(opened[0] if opened else None)
                out["open"].append(opened[1] if opened else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(out[c], t) for c, t in columns.items())], names=["id", "file", "page", *columns])

    src = lines.select("id", "file", "page", "no", "text", "number", "plain", "marks", "alone")
    return stored(src.mapInArrow(over, "id long, file string, page int, furniture array<int>, line array<int>, w array<string>, cut array<int>, a array<string>, b array<string>, first string, open_line int, open string"), "scan-words")


def exchanges(counts: DataFrame) -> DataFrame:
    """(a, b, votes): what is read in place of what, by the words of ``counts`` (w, n); at most 1 / ``VOTES`` rows.

    A word votes for the exchange that most words share of those that lead from it to a word used ``RATIO`` times as often.
    """
    spot = F.explode(F.sequence(F.lit(0), F.length("w") - 1)).alias("i")
    spans = counts.where(F.length("w").between(4, 40)).select("w", "n", spot).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).where("i + k <= length(w)")
    spans = spans.select("w", "n", F.expr("concat(substring(w, 1, i), chr(0), substring(w, i + k + 1))").alias("rest"), F.expr("substring(w, i + 1, k)").alias("part"), F.expr("concat(substring(w, greatest(i, 1), if(i > 0, 1, 0)), chr(0), substring(w, i + k + 1, 1))").alias("beside"))
    good = spans.where((F.col("n") >= KNOWN) & F.col("w").rlike(r"^\p{L}+$")).select("rest", F.col("part").alias("b"), F.col("n").alias("m"))
    met = spans.join(good, "rest").where((F.col("part") != F.col("b")) & (F.col("m") >= RATIO * F.col("n")) & (F.length("part") + F.length("b") < 4))
    met = stored(met.select("w", F.col("part").alias("a"), "b", "beside").distinct(), "scan-exchanges")
    share = met.groupBy("a", "b").agg(F.count_distinct("w").alias("words"))
    best = met.join(share, ["a", "b"]).groupBy("w").agg(F.max_by(F.struct("a", "b", "beside"), F.struct("words", "a", "b")).alias("x")).select("x.*")
    votes = stored(best.groupBy("a", "b").agg(F.count("*").alias("votes"), F.count_distinct("beside").alias("places")), "scan-votes")
    total = votes.agg(F.sum("votes")).first()[0] or 0
    return votes.where((F.col("places") >= PLACES) & (F.col("votes") >= VOTES * total)).select("a", "b", "votes")


def candidates(word: str, undo: list[tuple[str, str]], signs: dict[str, list[str]]) -> set[str]:
    """Words that one undone exchange makes of a word; of words with digits or signs also all of them undone. signs: what a sign stands for."""
    out = set()
    for a, b in undo:
        at = word.find(a)
        while at >= 0:
            out.add(word[:at] + b + word[at + len(a) :])
            at = word.find(a, at + 1)
    if re.search(r"[0-9@ﬁﬂ]", word) and LETTER.search(word):
        flats = {word}
        for a, bs in signs.items():
            flats = {x.replace(a, b) for x in flats for b in bs} if a in word else flats
        out |= flats
        out |= {x.replace(a, b, 1) for x in list(out) if not re.search(r"[0-9@]", x) for a, b in undo if a in x}
    out.discard(word)
    return out


def _corrections(counts: DataFrame) -> DataFrame:
    """(w, right) of the distinct words that are misread."""
    learned = sorted(((r.a, r.b, r.votes) for r in exchanges(counts).collect()), key=lambda r: (-r[2], r[0], r[1]))  # at most 1 / VOTES
    undo = list(dict.fromkeys([(a, b) for a, b, _ in learned] + list(SIGNS)))
    signs: dict[str, list[str]] = {}
    for a, b in SIGNS:
        signs.setdefault(a, []).append(b)

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, int(n), c) for w, n in zip(b["w"], b["n"], strict=True) for c in candidates(w, undo, signs)]
            yield pd.DataFrame(rows, columns=["w", "n", "c"]).astype({"n": "int64"})

    cand = counts.mapInPandas(over, "w string, n long, c string")
    mixed = F.col("w").rlike(r"[0-9@ﬁﬂ]") & ~F.col("w").rlike(r"^\p{L}{0,2}[0-9][0-9.,/x]*$")
    met = cand.join(counts.select(F.col("w").alias("c"), F.col("n").alias("m")), "c").where(~F.col("c").rlike(r"[0-9@ﬁﬂ]"))
    sure = F.when(mixed, F.col("m") >= 1).otherwise((F.col("m") >= 3) & (F.col("m") >= F.when(F.col("n") <= 2, 3 * F.col("n")).otherwise(RATIO * F.col("n"))))
    known = met.where(sure).groupBy("w").agg(F.max_by("c", F.struct("m", "c")).alias("right"))
    # a letter among digits or signs is misread even if the vocabulary lacks the word
    right = F.col("w")
    for a, bs in signs.items():
        right = F.replace(right, F.lit(a), F.lit(bs[0]))
    signed = "".join(a for a in signs if not LETTER.search(a))
    alone = counts.where(mixed & F.col("w").rlike(rf"\p{{L}}[{signed}]|[{signed}]\p{{L}}|[ﬁﬂ]") & ~F.col("w").rlike(r"^\p{L}[0-9]+$|[0-9]{2}|^[0-9]+\p{L}{1,2}$"))
    return known.unionByName(alone.join(known, "w", "left_anti").select("w", right.alias("right")))


class Scans:
    """Everything that is known of a table of scans; each part is a stored table."""

    def __init__(self, scans: DataFrame, key: str = "scan_id", file_key: str = "file_id", page: str = "page_no", text: str = "text"):
        rows = scans.where(F.col(key).isNotNull()).select(
            F.col(key).cast("long").alias("id"), F.coalesce(F.col(file_key), F.concat(F.lit("?"), F.col(key).cast("string"))).alias("file"), F.col(page).cast("int").alias("page"), F.col(text).alias("t")
        )
        self.rows = rows
        self.parsed = _parsed(_marked(_lines(rows)))
        # the file's next row that has a line of its own, whatever its number
        begun = self.parsed.where("page is not null and first is not null").groupBy("file", "page").agg(F.min_by("first", "id").alias("first")).withColumn("back", -F.col("page"))
        after = with_previous(begun, "file", ["back"], ["first", "page"], F.floor(F.col("back") / BLOCK), "after")
        self.next = stored(after.select("file", "page", F.col("after.first").alias("b"), F.col("after.page").alias("then")), "scan-next")
        opened = self.parsed.where("open is not null").select("id", "file", "page", F.col("open_line").alias("line"), F.col("open").alias("a")).join(self.next, ["file", "page"]).where("b is not null")
        splits = self.parsed.select("id", F.explode(F.arrays_zip("cut", "a", "b")).alias("s")).select("id", F.col("s.cut").alias("line"), "s.a", "s.b").unionByName(opened.select("id", "line", "a", "b"))
        words = self.parsed.select("id", F.explode(F.arrays_zip("line", "w")).alias("x")).select("id", "x.line", "x.w")
        self.words = words
        head, rest = F.regexp_replace("a", r"[\-\xad¬‐‑]+$", ""), F.col("b")
        strip = lambda c: F.lower(F.regexp_replace(c, r"^[^\p{L}\p{N}_@]+|[^\p{L}\p{N}_@]+$", ""))
        self.splits = stored(splits.select("id", "line", "a", "b", strip(F.concat(head, rest)).alias("whole"), strip(F.concat(head, F.lit("-"), rest)).alias("joined")), "scan-splits")
        seen = words.groupBy("w").agg(F.count("*").alias("n"))
        once = self.splits.select(F.explode(F.array("whole", "joined")).alias("w")).distinct().join(seen, "w", "left_anti").select("w", F.lit(0).cast("long").alias("n"))
        self.counts = stored(seen.unionByName(once).where("w <> ''"), "scan-words")
        self.right = stored(_corrections(self.counts), "scan-corrections")

    def mended(self) -> DataFrame:
        """(id, line, a, b, word): the broken words as they were."""
        n = small(self.counts, 64)
        best = self.splits.join(n.select(F.col("w").alias("whole"), F.col("n").alias("nw")), "whole", "left").join(n.select(F.col("w").alias("joined"), F.col("n").alias("nj")), "joined", "left")
        r = small(self.right, 64)
        best = best.join(r.select(F.col("w").alias("whole"), F.col("right").alias("rw")), "whole", "left").join(r.select(F.col("w").alias("joined"), F.col("right").alias("rj")), "joined", "left")
        # of two words that are not known as they stand, one that is known when mended counts
        nw, nj = F.coalesce("nw", F.lit(0)), F.coalesce("nj", F.lit(0))
        hyphen = (nj > nw) | ((nj == 0) & (nw == 0) & F.col("rj").isNotNull() & F.col("rw").isNull())
        return best.select("id", "line", "a", "b", F.when(hyphen, F.coalesce("rj", "joined")).otherwise(F.coalesce("rw", "whole")).alias("word"))

    def misread(self) -> DataFrame:
        """(id, line, w, word): misread words and what they are."""
        return self.words.join(small(self.right, 64), "w").select("id", "line", "w", F.col("right").alias("word"))

    def found(self, key: str = "scan_id") -> DataFrame:
        """(``key``, line_no, kind, word) of everything that is not as it was printed."""
        fur = self.parsed.select("id", F.explode("furniture").alias("line"), F.lit("furniture").alias("kind"), F.lit("").alias("word"))
        spl = self.mended().select("id", "line", F.lit("split").alias("kind"), "word").where("word <> ''")
        mis = self.misread().select("id", "line", F.lit("misread").alias("kind"), "word")
        return fur.unionByName(spl).unionByName(mis).distinct().select(F.col("id").alias(key), F.col("line").alias("line_no"), "kind", "word")

    def paragraphs(self) -> DataFrame:
        """(file, page, place, piece, text): the paragraphs of each file's text in order, by the page they begin on.

        A paragraph that runs over more than ``BLOCK`` pages comes in pieces of so many pages from its first on, so no row grows with its file.
        The paragraphs of a row without page number begin on page null.
        """
        right = self.misread().groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("w", "word"))).alias("right"))
        split = self.mended().groupBy("id").agg(F.collect_list(F.struct("line", "a", "b", "word")).alias("split"))
        run = F.when(F.col("page").isNull(), F.concat(F.lit("#"), F.col("id").cast("string"))).otherwise(F.col("file")).alias("run")
        rows = self.rows.select("id", "file", run, F.coalesce("page", F.lit(0)).alias("page"), "t")
        firsts = rows.groupBy("run", "page").agg(F.min("id").alias("id"))
        cut = self.mended().join(self.parsed.select("id", "file", "page", "open_line"), "id").where("line = open_line").join(self.next, ["file", "page"])
        cut = cut.select(F.col("file").alias("run"), F.col("then").alias("page"), F.lit(True).alias("cut")).distinct()
        src = rows.join(firsts.select("id"), "id", "left_semi").join(self.parsed.select("id", "furniture"), "id").join(right, "id", "left").join(split, "id", "left").join(cut, ["run", "page"], "left")

        def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for f, g, p, t, fur, r, s, c in zip(b["file"], b["run"], b["page"], b["t"], b["furniture"], b["right"], b["split"], b["cut"], strict=True):
                    for k, (fresh, x) in enumerate(repaired(t, set(fur), dict(r) if r is not None else {}, {y["line"]: y["word"] for y in s} if s is not None else {}, bool(c) if c is not None else False)):
                        out.append((f, g, p, k, fresh, x))
                yield pd.DataFrame(out, columns=["file", "run", "page", "place", "fresh", "text"])

        src = src.select("file", "run", "page", "t", "furniture", "right", "split", "cut")
        parts = stored(src.mapInPandas(over, "file string, run string, page int, place int, fresh boolean, text string"), "scan-parts")
        at = F.struct("page", "place")
        parts = parts.withColumn("block", F.floor(F.col("page") / BLOCK))
        start = F.max(F.when(F.col("fresh"), at))
        own = parts.withColumn("start", start.over(Window.partitionBy("run", "block").orderBy("page", "place")))
        ends = parts.groupBy("run", "block").agg(start.alias("s"), F.min(at).alias("head"))
        ends = ends.select("run", "block", F.coalesce(F.max("s").over(Window.partitionBy("run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.first("head").over(Window.partitionBy("run").orderBy("block"))).alias("carry"))
        own = own.join(ends, ["run", "block"]).withColumn("start", F.coalesce("start", "carry"))
        own = own.withColumn("piece", F.floor((F.col("page") - F.col("start.page")) / BLOCK))
        whole = own.groupBy("file", "run", "start", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "place", "text"))), lambda x: x["text"]), " ").alias("text"))
        return whole.select("file", F.when(F.col("run") == F.col("file"), F.col("start.page")).alias("page"), F.col("start.place").alias("place"), "piece", "text")


def repaired(text: str | None, fur: set[int], right: dict[str, str], split: dict[int, str], cut: bool) -> list[tuple[bool, str]]:
    """(begins a paragraph, text) of the paragraphs of one row; cut: its first word was used up by the row before."""
    out: list[tuple[bool, list[str]]] = []
    fresh, drop = False, cut
    for n, x in enumerate((text or "").split("\n"), 1):
        if n in fur:
            continue
        if not x.strip():
            fresh = fresh or bool(out)
            continue
        toks = x.split()
        if drop:
            toks, drop = toks[1:], False
        if n in split and toks:
            last = toks[-1]
            lead = last[: len(last) - len(last.lstrip("“\"«('‘"))]
            word = split[n]
            toks[-1] = lead + (word.capitalize() if last.lstrip("“\"«('‘")[:1].isupper() else word)
            drop = True
        toks = [_fix(w, right) for w in toks]
        if not out or fresh:
            out.append((bool(out) and fresh, []))
        out[-1][1].extend(toks)
        fresh = False
    return [(f, " ".join(w)) for f, w in out if w]


def _fix(token: str, right: dict[str, str]) -> str:
    b = STRIP.sub("", token)
    r = right.get(b.lower())
    return token.replace(b, r.upper() if b.isupper() and len(b) > 1 else r.capitalize() if b[:1].isupper() else r) if r else token
