"""Text functions as column expressions. All of them give null for null unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's ``\s`` alone is ASCII.
SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(s: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(s, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def squeeze(s: Column) -> Column:
    """Runs of white space become one blank, none at the ends; empty for null."""
    return strip(F.regexp_replace(F.coalesce(s, F.lit("")), f"{SPACE}+", " "))


def optional(s: Column) -> Column:
    """Stripped, or null if blank."""
    return F.nullif(strip(s), F.lit(""))


def token_count(s: Column) -> Column:
    """The offline estimate: a token for four characters, one at least; 0 for null and empty."""
    n = F.length(F.coalesce(s, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def word_tokens(s: Column) -> Column:
    """Number of words between white space."""
    t = squeeze(s)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def word_set(s: Column, least: int = 4) -> Column:
    """Distinct lower-case words of at least ``least`` letters, digits or underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(rf"[\p{{L}}\p{{N}}_]{{{least},}}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words of two texts over all their words; 0 if either has none."""
    x, y = word_set(a), word_set(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def sentences(s: Column) -> Column:
    """Sentences: cut after ``.``, ``!`` or ``?`` before white space and a capital; blank ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), rf"(?<=[.!?]){SPACE}+(?=[A-Z])"), strip), lambda x: x != "")


def delimited(s: Column, delimiter: str) -> Column:
    """Parts between a literal delimiter, stripped, blank ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), "\\Q" + delimiter + "\\E"), strip), lambda x: x != "")


def char_windows(s: Column, target: int, overlap: int, least: int) -> Column:
    """Windows of 4*target characters, 4*(target-overlap) apart; a last one shorter than 4*least joins the one before."""
    size, stride, small = 4 * target, 4 * max(1, target - overlap), 4 * least
    n = F.length(s)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride))
    k = F.size(starts)
    short = (k > 1) & (n - F.element_at(starts, -1) < small)
    used = F.when(short, F.slice(starts, 1, k - 1)).otherwise(starts)
    last = F.element_at(used, -1)
    cut = F.transform(used, lambda i: F.substring(s, i + 1, F.when(short & (i == last), n).otherwise(size)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def overlap_tail(s: Column, overlap: int) -> Column:
    """The last words of a text whose token counts add up to at most ``overlap``."""
    w = F.reverse(F.filter(F.split(squeeze(s), " "), lambda x: x != ""))
    zero = F.struct(F.array().cast("array<string>").alias("w"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + token_count(x)
        ok = ~acc["full"] & (n <= overlap)
        return F.struct(F.when(ok, F.concat(F.array(x), acc["w"])).otherwise(acc["w"]).alias("w"), F.when(ok, n).otherwise(acc["n"]).alias("n"), (~ok).alias("full"))

    return F.array_join(F.aggregate(w, zero, step)["w"], " ")


def page_number(s: Column) -> Column:
    """The number of the first ``## Page n`` mark; 1 without one."""
    n = F.regexp_extract(F.coalesce(s, F.lit("")), r"(?i)##\s*Page\s+(\d+)", 1)
    return F.when(n == "", 1).otherwise(n.try_cast("int"))


def safe_filename(s: Column, default: str = "upload.pdf") -> Column:
    """The base name with runs of other characters than letters, digits, ``._-`` as one underscore."""
    base = F.regexp_extract(F.regexp_replace(F.coalesce(s, F.lit("")), "/+$", ""), "([^/]*)$", 1)
    out = F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.when(out == "", default).otherwise(out)


def slug(s: Column) -> Column:
    """Lower case with underscores and blanks as single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(s)), "[_ ]", "-"), "-+", "-")


def truth(s: Column, default: bool = True) -> Column:
    """A word for yes or no as boolean; ``default`` for null and other words."""
    t = F.lower(strip(s.cast("string")))
    # Fixed values.
    yes, no = ("1", "true", "yes", "on", "active", "enabled"), ("0", "false", "no", "off", "inactive", "disabled")
    return F.when(t.isin(*yes), True).when(t.isin(*no), False).otherwise(default)


def safe_int(s: Column, default: int, least: int | None = None) -> Column:
    """A whole number of up to nine digits; ``default`` for null and anything else, and never below ``least``."""
    t = strip(s.cast("string"))
    n = F.coalesce(F.when(t.rlike(r"^[+-]?[0-9]{1,9}$"), t.try_cast("int")), F.lit(default))
    return n if least is None else F.greatest(n, F.lit(least))


def safe_float(s: Column, default: float) -> Column:
    """A decimal number; ``default`` for null and anything else."""
    t = strip(s.cast("string"))
    return F.coalesce(F.when(t.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), t.try_cast("double")), F.lit(float(default)))


def running_head(s: Column) -> Column:
    """A page edge line without numbers, dates and the words that come with them, to tell running heads."""
    t = F.regexp_replace(s, r"\b\d+\b", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", ""), r"\d{4}", "")
    return strip(F.replace(F.replace(F.lower(squeeze(t)), F.lit("page"), F.lit("")), F.lit("of"), F.lit("")))


def ocr_clean(s: Column) -> Column:
    """Line ends as LF, runs of blanks and tabs as one blank, at most one empty line, stripped."""
    t = F.regexp_replace(F.regexp_replace(s, "\r\n?", "\n"), "[ \t]+", " ")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def safe_path(s: Column) -> Column:
    """A member path of an archive with forbidden characters as ``_``, without ``.`` and ``..``, no hidden names."""
    parts = F.filter(F.split(F.replace(s, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", ".", ".."))
    return F.array_join(F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, r'[<>:"|?*\x00-\x1f]', "_"), r"^\.", "_.")), "/")


def clean_query(q: Column) -> Column:
    """A rewritten query without its label and quotes."""
    return F.regexp_replace(F.regexp_replace(squeeze(q), r"(?i)^(?:standalone|rewritten|resolved)\s+query\s*:\s*", ""), "^[ \"']+|[ \"']+$", "")


def last_question(prompt: Column) -> Column:
    """The last ``Question:`` line of a prompt, or null."""
    return F.try_element_at(F.regexp_extract_all(prompt, F.lit(r"(?im)^Question:[ \t]*(.+?)[ \t]*$"), F.lit(1)), F.lit(-1))


def contains_any(s: Column, terms: list[str]) -> Column:
    """Whether any of the terms stands in a text, without case."""
    low = F.lower(squeeze(s))
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))
