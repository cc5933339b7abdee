"""Messages of sessions: normalising, trimming, sessions kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.ids import DNS, uuid5
from siltworks.functions.text import optional, squeeze
from siltworks.operators.neighbours import with_previous


def normalised(messages: DataFrame, role: str = "role", content: str = "content") -> DataFrame:
    """User and assistant messages that say something, with squeezed text."""
    m = messages.withColumn(role, F.lower(squeeze(F.col(role)))).withColumn(content, squeeze(F.col(content)))
    return m.where(F.col(role).isin("user", "assistant") & (F.col(content) != ""))


def without_repeats(messages: DataFrame, session: str, order: list[str], same: list[str], bucket: Column | None = None) -> DataFrame:
    """Without messages that equal the one before them in their session. ``bucket`` splits long sessions (see neighbours)."""
    m = with_previous(messages.where(F.col(session).isNotNull()), session, order, same, F.lit(0) if bucket is None else bucket, "_before")
    return m.where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.struct(*same))).drop("_before")


def last_n(messages: DataFrame, session: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` messages of each session; the rank limit is pushed below the shuffle, so a hot session sends n rows a task."""
    w = Window.partitionBy(session).orderBy(*(F.desc(o) for o in order))
    return messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def recent_sessions(messages: DataFrame, session: str, at: str, keep: int = 1000) -> DataFrame:
    """The ``keep`` sessions used last, ties by name."""
    return messages.groupBy(session).agg(F.max(at).alias("last_used")).orderBy(F.desc("last_used"), session).limit(keep)


def transcript(messages: DataFrame, session: str, order: list[str], role: str = "role", content: str = "content", n: int = 16) -> DataFrame:
    """(session, context): ``Role: content`` lines of the last ``n`` messages."""
    line = F.concat(F.initcap(role), F.lit(": "), F.col(content))
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("l"))))
    return last_n(messages, session, order, n).groupBy(session).agg(F.array_join(F.transform(rows, lambda x: x["l"]), "\n").alias("context"))


def session_id(explicit: Column, headers: list[Column], user: Column) -> Column:
    """The session that is named, else the first header or cookie that names one, else one derived from the user."""
    named = [optional(c) for c in (explicit, *headers)]
    return F.coalesce(*named, F.concat(F.lit("auto:"), uuid5(F.coalesce(user, F.lit("anonymous")), DNS)))


def expanded(history: DataFrame, session: str, items: str) -> DataFrame:
    """(session, seq, role, content) of histories given as array<struct<role, content, question, answer>>, in either form."""
    own = history.select(session, F.posexplode(items).alias("p", "m"))
    pairs = F.array(
        F.struct(F.lit(0).alias("k"), F.when(F.col("m.role").isNotNull(), F.col("m.role")).otherwise("user").alias("role"), F.coalesce("m.content", "m.question").alias("content")),
        F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), F.when(F.col("m.role").isNull() & (squeeze(F.col("m.question")) != ""), F.col("m.answer")).alias("content")),
    )
    flat = own.select(session, "p", F.explode(pairs).alias("x")).select(session, (F.col("p") * 2 + F.col("x.k")).alias("seq"), "x.role", "x.content")
    return normalised(flat)
