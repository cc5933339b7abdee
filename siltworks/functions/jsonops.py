"""JSON columns: paths, envelopes, flattening."""

from __future__ import annotations

import re
from json import dumps as json_key

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where the records of a response may stand, and where the name of a record.
ENVELOPE = ("data", "results", "items", "records", "entries", "content", "payload", "rows", "list")
NAMES = ("$.properties.displayName", "$.name", "$.title", "$.label", "$.id")


def path(p: str) -> str:
    """A path as ``$.a[0]['b']``; a bare one gets its ``$``. Raises on what is no path."""
    p = p.strip()
    if not p.startswith("$"):
        p = "$" + ("" if p.startswith("[") else ".") + p
    if not re.fullmatch(r"\$(?:\.[^.\[\]]+|\[\d+\]|\['[^']*'\]|\[\*\])*", p):
        raise ValueError(f"not a path: {p}")
    return p


def pick(json: Column, p: str) -> Column:
    """What stands at a path, as string; null if nothing does or the text is no JSON. ``[*]`` gives a JSON array."""
    return F.get_json_object(json, path(p))


def records(json: Column) -> Column:
    """The records of a response: the first list that is not empty under a known key, the list itself, or the one object."""
    lists = [F.from_json(F.get_json_object(json, f"$.{k}"), "array<string>") for k in ENVELOPE]
    found = [F.when(F.size(x) > 0, x) for x in lists]
    own = F.when(F.startswith(F.ltrim(json), F.lit("[")), F.from_json(json, "array<string>"))
    return F.coalesce(own, *found, F.when(F.try_parse_json(json).isNotNull(), F.array(json)), F.array().cast("array<string>"))


def display_name(json: Column, index: Column) -> Column:
    """The name of a record, else ``Entry n``."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(json, p)), F.lit("")) for p in NAMES), F.concat(F.lit("Entry "), index.cast("string")))


def flat(json: Column) -> Column:
    """``key: value`` lines of an object's own keys, in order of keys; nested values stay JSON."""
    m = F.from_json(json, "map<string,string>")
    rows = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null"))))
    return F.array_join(rows, "\n")


def project(json: Column, paths: list[str]) -> Column:
    """A map of path to value of the paths that are there."""
    pairs = F.array(*(F.struct(F.lit(p).alias("key"), pick(json, p).alias("value")) for p in paths))
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def with_source(json: Column, url: Column) -> Column:
    """An object with ``_source_url``; anything else wrapped as its ``value``."""
    extra = F.concat(F.lit('"_source_url":'), F.to_json(F.array(url)).substr(F.lit(2), F.length(F.to_json(F.array(url))) - 2), F.lit("}"))
    obj = F.regexp_replace(F.trim(json), r"\}\s*$", "")
    return F.when(F.startswith(F.ltrim(json), F.lit("{")), F.concat(obj, F.when(F.trim(obj) == "{", "").otherwise(","), extra)).otherwise(F.concat(F.lit('{"value":'), json, F.lit(","), extra))


def blank(s: Column) -> Column:
    """Whether a value is null, blank or an empty container."""
    return s.isNull() | F.trim(s).isin("", "[]", "{}", "null")


def rebuilt(json: Column, paths: list[str]) -> Column:
    """An object of the parts at dotted paths, nested as they were; missing ones are left out.

    A path with ``[*]`` or an index gives its values under the path's own text. Null for what is no JSON.
    """
    whole = F.try_parse_json(json)
    tree: dict = {}
    for p in paths:
        at, steps = tree, [p] if "[" in p else path(p)[2:].split(".")
        for s in steps[:-1]:
            at = at.setdefault(s, {})
        at[steps[-1]] = pick(json, p) if "[*]" in p else F.to_json(F.try_variant_get(whole, path(p), "variant"))

    def members(t: dict) -> Column:
        own = [F.concat(F.lit(json_key(k) + ":"), F.concat(F.lit("{"), F.nullif(members(v), F.lit("")), F.lit("}")) if isinstance(v, dict) else v) for k, v in t.items()]
        return F.concat_ws(",", *own)

    return F.when(whole.isNotNull(), F.concat(F.lit("{"), members(tree), F.lit("}")))
