"""Garbled text from wrong character encoding (problem 8).

Noisy-channel decoding. A text is cut into *units* (runs of letters and non-ASCII characters). Every channel - a pair of
the encoding a text was wrongly read with and the one it was written in - turns a unit back into bytes and these into a
reading. A Viterbi search over the units picks the channel path whose readings are most likely under the word frequencies
of the whole corpus, with a cost for changing the channel, so that a text damaged only in places is mended only there.

Lost bytes (U+FFFD) are wildcards of a byte lattice: a channel's bytes are followed through the lattice, a lead byte with
a lost continuation gives a range of characters, a lost lead the characters that the continuation allows, a run of lost
bytes one to as many characters. The paths of a unit are a pattern; of the corpus words that fit a pattern the most
frequent one is taken if it holds the share ``sure`` of them all.

The corpus frequencies are counted over all documents; the readings of a document look theirs up in a join, and so do
the patterns, by up to four letters that they know at either end or else by a letter within. Neither the vocabulary nor any fingerprint goes through
the driver.

Null and empty texts, and texts that need no repair, are not among the results. A text with lost characters is reported
with ``lost`` true; ``restored`` then holds the best reading, with U+FFFD where no reading is known: no word or none that
is sure enough fits, or not one letter of the word is left.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.session import small, stored

# Encodings that texts are wrongly read with, pairs (read as, written in) without UTF-8, and the script of each such encoding.
READ_AS = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8_r", "iso8859_2", "cp1254", "cp1257")
LEGACY = (("cp1252", "cp1251"), ("cp1251", "koi8_r"), ("cp1252", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1252", "cp866"), ("mac_roman", "cp1251"), ("cp437", "cp866"), ("cp866", "koi8_r"), ("cp1252", "cp1253"), ("cp1252", "cp1255"), ("cp1252", "cp1256"))
SCRIPTS = {"cp1251": "[Ѐ-ӿ]", "koi8_r": "[Ѐ-ӿ]", "cp866": "[Ѐ-ӿ]", "cp1253": "[Ͱ-Ͽ]", "cp1255": "[֐-׿]", "cp1256": "[؀-ۿ]"}
LOST = "�"

UNIT = re.compile(r"[A-Za-z]*(?:[^\x00-\x7f]+[A-Za-z]*)+")
PIECE = regex.compile(r"\p{L}+|[^\x00-\x7f]")
JAVA_PIECE = r"[\p{L}]*[\p{L}&&[^\x00-\x7F]][\p{L}]*|[^\x00-\x7F\p{L}]"
_SCRIPT = {w: re.compile(x) for w, x in SCRIPTS.items()}
#: Costs in nats: changing the channel; a channel that cannot read a unit; evidence of a multi-byte UTF-8 sequence.
SWITCH, DEAF, PROOF = 2.5, 0.5, 3.0
UNSEEN = 0.05


@cache
def _bytes_of(encoding: str) -> dict[str, int]:
    table: dict[str, int] = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    for b in range(128, 160):
        table.setdefault(chr(b), b)
    return table


def _encode(s: str, encoding: str) -> bytes | None:
    t = _bytes_of(encoding)
    try:
        return bytes([t[c] for c in s])
    except KeyError:
        return None


def _decode(b: bytes | None, encoding: str) -> str | None:
    try:
        return b.decode(encoding) if b is not None else None
    except UnicodeDecodeError:
        return None


@cache
def readings(unit: str) -> dict[tuple[str, str, int], str]:
    """What a unit may have been, by channel (read as, written in, times)."""
    out: dict[tuple[str, str, int], str] = {}
    for e in READ_AS:
        x = _decode(_encode(unit, e), "utf-8")
        if x and x != unit:
            out[e, "utf-8", 1] = x
            y = _decode(_encode(x, e), "utf-8")
            if y and y != x:
                out[e, "utf-8", 2] = y
    for e, w in LEGACY:
        x = _decode(_encode(unit, e), w)
        if x and x != unit and _SCRIPT[w].search(x) and not re.search(r"[A-Za-z\x80-\x9f─-▟]", x):
            out[e, w, 1] = x
    return out


def pieces(s: str) -> list[str]:
    return [p for p in PIECE.findall(s) if not p.isascii()]


def needed(text: str) -> set[str]:
    """Pieces whose frequency decides about a text; none if no channel can read any of its units otherwise."""
    units = set(UNIT.findall(text))
    other = {u: readings(u) for u in units}
    if LOST not in text and not any(other.values()):
        return set()
    return {p for u in units for s in (u, *other[u].values()) for p in pieces(s)}


def _lost_parts(unit: str) -> list[str]:
    return [p for p in re.findall(r"[^\W\d_�]*�[^\W\d_]*(?:�[^\W\d_]*)*", unit)]


ANY = r"[^\x00-\x7F]"


def lattice(part: str, read: str) -> list[tuple[str, bool]] | None:
    """The paths of a part with lost bytes, written in UTF-8 and read as ``read``: (pattern, whether it is one known character); null if there are none."""
    table = _bytes_of(read) if read != "ascii" else {chr(i): i for i in range(128)}
    row: list[int | None] = []
    for c in part:
        if c != LOST and c not in table:
            return None
        row.append(None if c == LOST else table[c])
    out: list[tuple[str, bool]] = []
    i = 0
    while i < len(row):
        b = row[i]
        if b is None:
            run = 1
            while i + run < len(row) and row[i + run] is None:
                run += 1
            after = row[i + run] if i + run < len(row) else None
            if after is not None and 0x80 <= after < 0xC0:  # the last lost byte is the lead of a known continuation
                out += [(f"{ANY}{{{-(-(run - 1) // 4)},{run - 1}}}", False)] if run > 1 else []
                out.append(("[" + "".join(re.escape(chr(x << 6 | after & 63)) for x in range(2, 32)) + "]", False))
                i += run + 1
            else:
                out.append((f"{ANY}{{{-(-run // 4)},{run}}}", False))
                i += run
        elif b < 0x80:
            out.append((chr(b), True))
            i += 1
        else:
            n = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
            rest = row[i + 1 : i + n]
            if not n or len(rest) < n - 1 or any(x is not None and not 0x80 <= x < 0xC0 for x in rest):
                return None
            low, high = (_decode(bytes([b, *(y if x is None else x for x in rest)]), "utf-8") for y in (0x80, 0xBF))
            if None in rest:
                low = low or {0xE0: "\u0800", 0xF0: "\U00010000"}.get(b)
                if not low or not high:
                    return None
                out.append((f"[{re.escape(low)}-{re.escape(high)}]", False))
            elif low:
                out.append((low, True))
            else:
                return None
            i += n
    return out


@cache
def patterns(part: str) -> list[tuple[str, str]]:
    """(key, pattern) of the words that a part with lost bytes may have been, by channel; key: known letters at one end, or one within.

    Read as UTF-8 each mark is a byte of a one-byte encoding, so one letter; read as ASCII the marks are the bytes of UTF-8
    themselves; else the other characters are bytes too.
    """
    out = set()
    paths = [[(ANY, False) if c == LOST else (c, True) for c in part]]
    paths += [p for e in ("ascii", *READ_AS) if (p := lattice(part, e)) is not None]
    for path in paths:
        ahead = next((i for i, x in enumerate(path) if not x[1]), len(path))
        behind = next((i for i, x in enumerate(reversed(path)) if not x[1]), len(path))
        known = [c for c, _ in path]
        within = next((c for c, sure in path if sure), None)
        if within is None:
            continue
        n = min(4, max(ahead, behind))
        key = "~" + within if not n else "^" + "".join(known[:n]) if ahead >= behind else "$" + "".join(known[-n:])
        out.add((key, "^" + "".join(re.escape(c) if sure else c for c, sure in path) + "$"))
    return sorted(out)


def wanted(text: str) -> list[tuple[str, str, str]]:
    """(part, key, pattern) of the parts of a text that have lost bytes: words with marks, and whole units with marks."""
    units = {u for u in UNIT.findall(text) if LOST in u}
    return sorted({(p, *x) for u in units for p in {u, *_lost_parts(u)} for x in patterns(p)})


def _score(s: str, freq: dict[str, int], own: Counter[str], total: float) -> float:
    out = 0.0
    for p in pieces(s):
        c = max(0, freq.get(p, 0) - own.get(p, 0))
        out += math.log((c + UNSEEN) / total) - (len(p) if c <= 0 else 0)
    return out


def mend(text: str, freq: dict[str, int], best: dict[str, str], total: float) -> str:
    """The most likely original of a text. freq: counts of pieces; best: the reading of a part with lost bytes."""
    spots = list(UNIT.finditer(text))
    own = Counter(p for m in spots for p in pieces(m[0]))
    same = ("", "", 0)
    channels = {same} | {k for m in spots for k in readings(m[0])}
    back: list[dict[tuple[str, str, int], tuple[tuple[str, str, int], str]]] = []
    cost = {k: 0.0 if k == same else -SWITCH for k in channels}
    for m in spots:
        u, read = m[0], readings(m[0])
        plain = _score(u, freq, own, total)
        top = max(cost, key=lambda k: cost[k])
        now, step = {}, {}
        for k in channels:
            came = top if cost[top] - SWITCH > cost[k] else k
            before = cost[top] - SWITCH if came is top and top != k else cost[k]
            x = u if k == same else read.get(k)
            if x is None:
                gain, x = plain - DEAF, u
            elif k == same:
                gain = plain
            else:
                gain = _score(x, freq, Counter(), total) + (PROOF * sum(1 for c in x if ord(c) > 127) if k[1] == "utf-8" else 0)
            now[k], step[k] = before + gain, (came, x)
        cost = now
        back.append(step)
    k = max(cost, key=lambda q: (cost[q], q == same))
    chosen: list[str] = []
    for step in reversed(back):
        k, x = step[k]
        chosen.append(x)
    out, at = [], 0
    for m, x in zip(spots, reversed(chosen), strict=True):
        x = best.get(x, x)
        for p in _lost_parts(x) if LOST in x else ():
            x = x.replace(p, best.get(p, p))
        out += [text[at : m.start()], x]
        at = m.end()
    return "".join(out) + text[at:]


def repair(docs: DataFrame, key: str = "doc_id", text: str = "text", sure: float = 0.9) -> DataFrame:
    """Garbled documents only: ``key``, ``restored`` (the text as it was, as far as known) and ``lost`` (characters are gone).

    ``sure``: share of the corpus words fitting a piece with lost bytes that the most frequent one must hold to be taken.
    """
    src = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).where(F.col("id").isNotNull() & F.col("t").rlike(r"[^\x00-\x7F]"))

    counted = src.select(F.explode(F.regexp_extract_all("t", F.lit(JAVA_PIECE), F.lit(0))).alias("piece")).where(F.col("piece") != "")
    freq = stored(counted.groupBy("piece").agg(F.count("*").alias("n")), "piece-counts")
    total = float(freq.agg(F.sum("n")).first()[0] or 1)

    lost_type = "array<struct<part: string, key: string, pattern: string>>"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, sorted(n), [dict(zip(("part", "key", "pattern"), w, strict=True)) for w in wanted(t)] if LOST in t else []) for i, t in zip(b["id"], b["t"], strict=True) if (n := needed(t)) or LOST in t]
            readings.cache_clear()
            patterns.cache_clear()
            yield pd.DataFrame({"id": pd.Series([r[0] for r in rows], dtype="int64"), "asks": pd.Series([r[1] for r in rows], dtype="object"), "gaps": pd.Series([r[2] for r in rows], dtype="object")})

    asks = stored(src.mapInPandas(ask, f"id long, asks array<string>, gaps {lost_type}"), "piece-asks")
    plain = asks.select("id", F.explode("asks").alias("piece")).join(small(freq, 96), "piece").select("id", "piece", "n", F.lit(None).cast("string").alias("best"))

    # the corpus words by what may be known of them at either end or within
    whole = freq.where(~F.col("piece").contains(LOST) & (F.length("piece") > 1))
    ends = F.array(*(F.concat(F.lit("^"), F.left("piece", F.lit(k))) for k in (1, 2, 3, 4)), *(F.concat(F.lit("$"), F.right("piece", F.lit(k))) for k in (1, 2, 3, 4)))
    ends = F.concat(ends, F.transform(F.split("piece", ""), lambda c: F.concat(F.lit("~"), c)))
    want = stored(asks.select("id", F.explode("gaps").alias("g")).select("id", "g.*"), "piece-gaps")
    keys = small(stored(want.select("key").distinct(), "gap-keys"), 40)
    vocabulary = whole.select("piece", "n", F.explode(F.array_distinct(ends)).alias("key")).join(keys, "key", "left_semi")
    fits = want.select("part", "key", "pattern").distinct().join(vocabulary, "key").where(F.rlike("piece", F.col("pattern"))).select("part", "piece", "n").distinct()
    best = fits.groupBy("part").agg(F.max_by("piece", F.struct("n", "piece")).alias("best"), F.max("n").alias("n"), F.sum("n").alias("all")).where(F.col("n") >= sure * F.col("all"))
    lost = want.select("id", "part").distinct().join(best, "part").select("id", F.col("part").alias("piece"), "n", "best")
    told = plain.unionByName(lost).groupBy("id").agg(F.collect_list(F.struct("piece", "n", "best")).alias("told"))
    told = asks.select("id").join(told, "id", "left")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, told in zip(b["id"], b["t"], b["told"], strict=True):
                told = [] if told is None else told
                f = {x["piece"]: x["n"] for x in told if x["best"] is None}
                fixed = mend(t, f, {x["piece"]: x["best"] for x in told if x["best"] is not None}, total)
                if fixed != t or LOST in t:
                    rows.append((i, fixed, LOST in t))
            readings.cache_clear()
            yield pd.DataFrame(rows, columns=["id", "restored", "lost"]).astype({"id": "int64", "lost": "bool"})

    return src.join(told, "id").select("id", "t", "told").mapInPandas(decode, "id long, restored string, lost boolean").withColumnRenamed("id", key)
