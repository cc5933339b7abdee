"""Structured Streaming: session histories as keyed state, and a folder whose new files are ingested."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEEP = 40


def session_histories(messages: DataFrame, session: str = "session", at: str = "ts", idle: str = "1 hour", keep: int = KEEP) -> DataFrame:
    """A stream of (session, seen, kept) after each trigger: messages ever seen and kept, at most the last ``keep``.

    ``messages``: a stream of (session, ts, role, content). State is bounded for each session, and a session idle for
    ``idle`` of event time is dropped.
    """
    hours = pd.Timedelta(idle)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, held = state.get if state.exists else (0, [])
        held = list(held)
        last = 0
        for b in batches:
            b = b.sort_values("ts")
            seen += len(b)
            held = (held + [f"{r}: {c}" for r, c in zip(b["role"], b["content"], strict=True)])[-keep:]
            last = max(last, int(b["ts"].max().timestamp() * 1000))
        state.update((seen, held))
        due = max(last, state.getCurrentWatermarkMs()) + int(hours.total_seconds() * 1000)
        state.setTimeoutTimestamp(due)
        yield pd.DataFrame({"session": [key[0]], "seen": [seen], "kept": [len(held)]})

    src = messages.select(F.col(session).alias("session"), F.col(at).cast("timestamp").alias("ts"), "role", "content").withWatermark("ts", idle)
    return src.groupBy("session").applyInPandasWithState(step, "session string, seen long, kept int", "seen long, held array<string>", "update", GroupStateTimeout.EventTimeTimeout)


def activity(messages: DataFrame, at: str = "ts", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """A stream of message counts for each time window and role; rows later than ``late`` are dropped."""
    src = messages.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return src.groupBy(F.window("_at", window).alias("w"), "role").agg(F.count("*").alias("n")).select("w.start", "role", "n")


def watch_folder(spark: SparkSession, folder: str, checkpoint: str, ingest: Callable[[DataFrame, int], None], once: bool = True):  # noqa: ANN201
    """Hand new files (path, filename, suffix, content, ...) to ``ingest`` batch by batch; done files are not read again."""
    from siltworks.sources.files import route, suffix

    schema = "path string, modificationTime timestamp, length long, content binary"
    new = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    new = new.withColumn("filename", name).withColumn("suffix", suffix(name)).withColumn("route", route(name))
    w = new.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def csv_rows(spark: SparkSession, folder: str, schema: str, delimiter: str = ",") -> DataFrame:
    """A stream of the rows of CSV files that arrive in a folder, with ``row_text``: ``a: x | b: y`` without blank cells."""
    from siltworks.functions.text import strip

    rows = spark.readStream.schema(schema).option("header", True).option("sep", delimiter).csv(folder)
    cells = (F.concat(F.lit(f"{c}: "), F.nullif(strip(F.col(c).cast("string")), F.lit(""))) for c in rows.columns)
    return rows.select("*", F.concat_ws(" | ", *cells).alias("row_text"))
