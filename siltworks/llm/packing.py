"""Filling fixed-capacity containers with items (problem 6).

Best-two-fit. A container is filled greedily, the largest item that fits first; then its smallest item is replaced by two
unpacked items that fit the space it leaves, if they fill it more tightly.

Items are dealt to groups of at most about ``GROUP`` items by a hash of their id, so a group is bounded however large or
skewed the table is, and each group is packed on its own; what this costs is at most one container that is not full a
group and capacity. An item that exceeds the capacity is divided into full containers and one rest, which is packed like
any other item; no other item is divided.

Sizes are tokens of a public tokenizer whose vocabulary file is a parameter. Null and empty texts have size 0 and go into
the first container of their group. Rows with a null id are left out; rows that repeat an id are items of their own.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.session import stored

TOKENIZER = os.environ.get("SILTWORKS_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
GROUP = 20_000


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, size): the number of tokens of each text."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for b in batches:
            sizes: list[int] = []
            texts = b["t"].fillna("").tolist()
            for lo in range(0, len(texts), 64):
                sizes += [len(e) for e in t.encode_batch(texts[lo : lo + 64], add_special_tokens=False)]
            yield pd.DataFrame({"id": b["id"], "size": pd.Series(sizes, dtype="int32")})

    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInPandas(over, "id long, size int")


class Pool:
    """Unpacked items by size."""

    def __init__(self, items: list[tuple[int, int]]):
        self.by: dict[int, list[int]] = {}
        for size, name in items:
            self.by.setdefault(size, []).append(name)
        self.sizes = sorted(self.by)

    def take(self, size: int) -> int:
        own = self.by[size]
        name = own.pop()
        if not own:
            del self.by[size]
            self.sizes.pop(bisect_right(self.sizes, size) - 1)
        return name

    def put(self, size: int, name: int) -> None:
        if size not in self.by:
            self.by[size] = []
            self.sizes.insert(bisect_right(self.sizes, size), size)
        self.by[size].append(name)

    def largest(self, room: int) -> int:
        at = bisect_right(self.sizes, room)
        return self.sizes[at - 1] if at else 0

    def two(self, room: int, over: int) -> tuple[int, int] | None:
        """The two items that fill ``room`` best, more than ``over``."""
        best, pair = over, None
        low, high = 0, bisect_right(self.sizes, room - 1) - 1
        while low <= high:
            a, b = self.sizes[low], self.sizes[high]
            if a + b > room or (low == high and len(self.by[a]) < 2):
                high -= 1
                continue
            if a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            low += 1
        return pair


def pack(items: list[tuple[int, int]], capacity: int) -> list[int]:
    """The container of each item (size, name 0..n-1), by name; sizes from 1 to ``capacity``."""
    pool, home, at = Pool(sorted(items)), [0] * len(items), 0
    while pool.sizes:
        inside: list[tuple[int, int]] = []
        room = capacity
        while (size := pool.largest(room)) > 0:
            inside.append((size, pool.take(size)))
            room -= size
        if room and pool.sizes:
            size, name = inside[-1]
            if pair := pool.two(room + size, size):
                inside.pop()
                inside += [(s, pool.take(s)) for s in pair]
                pool.put(size, name)
        for _, name in inside:
            home[name] = at
        at += 1
    return home


def containers(docs: DataFrame, capacities: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, group: int = GROUP) -> DataFrame:
    """(container_type, ``key``, part_no, container, tokens) for each document and capacity; ``container`` is unique for its type.

    ``capacities``: (container_type, capacity_tokens), a handful of rows; types without a positive capacity are left out.
    """
    sizes = stored(token_counts(docs, key, text, tokenizer), "token-counts")
    groups = max(1, -(-sizes.count() // group))
    caps = capacities.where("container_type is not null and capacity_tokens > 0").select("container_type", F.col("capacity_tokens").cast("int").alias("cap"))
    kinds = [(r.container_type, r.cap) for r in caps.distinct().collect()]
    each = sizes.withColumn("kind", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(c).alias("c")) for t, c in kinds)))) if kinds else sizes.limit(0).withColumn("kind", F.struct(F.lit("").alias("t"), F.lit(1).alias("c")))
    each = each.select(F.col("kind.t").alias("kind"), F.col("kind.c").alias("cap"), "id", "size", F.pmod(F.xxhash64("id", F.lit(6)), F.lit(groups)).cast("int").alias("grp"))

    # the full containers of an item beyond the capacity need no packing; its rest does
    whole = F.when(F.col("size") > F.col("cap"), F.floor((F.col("size") - 1) / F.col("cap"))).otherwise(0).cast("int")
    each = each.withColumn("full", whole)
    full = each.where("full > 0").select("kind", "id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part_no"), F.col("cap").alias("tokens"))
    full = full.select("kind", "id", "part_no", F.concat_ws("-", F.lit("f"), "id", "part_no").alias("container"), "tokens")

    def over(k: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["rest", "id"]).reset_index(drop=True)
        rest = b["rest"].tolist()
        blank = sum(r == 0 for r in rest)
        home = [0] * blank + pack([(r, i) for i, r in enumerate(rest[blank:])], int(b["cap"].iloc[0]) if len(b) else 1)
        name = [f"g-{k[1]}-{h}" for h in home]
        return pd.DataFrame({"kind": b["kind"], "id": b["id"], "part_no": b["full"], "container": name, "tokens": b["rest"]})

    rest = each.withColumn("rest", (F.col("size") - F.col("full") * F.col("cap")).cast("int"))
    packed = rest.groupBy("kind", "grp").applyInPandas(over, "kind string, id long, part_no int, container string, tokens int")
    return packed.unionByName(full).select(F.col("kind").alias("container_type"), F.col("id").alias(key), "part_no", "container", "tokens")


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """For each type the number of containers, the tokens in them and the share of the space that they fill."""
    by = packed.groupBy("container_type").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    by = by.join(F.broadcast(capacities.select("container_type", "capacity_tokens").distinct()), "container_type")
    return by.withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
