"""Session settings, shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in rows times bytes a row, that is ever sent to every executor.
BROADCAST_BYTES = 48 * 1024 * 1024


def session(name: str = "siltworks", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library expects: UTC, Arrow and adaptive execution."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


_local: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``).

    Where that setting is absent a session on one machine, as in tests, uses a local folder; on a cluster this raises.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``stored`` that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured bytes fit ``limit``; otherwise unchanged, for a shuffled join.

    Rows are counted at ``row_bytes`` at least; what strings, binaries, arrays, maps and structs hold is measured, not guessed.
    ``df`` should be cheap to read (a stored table or a tiny input).
    """
    fixed, held = 16, []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        flat = kind == "struct" and not any(g.dataType.typeName() in ("string", "binary", "array", "map", "struct", "variant") for g in f.dataType.fields)
        fixed += 8 * len(f.dataType.fields) if flat else 8
        if kind in ("string", "binary"):
            held.append(F.octet_length(f.name))
        elif kind in ("array", "map", "struct") and not flat:
            held.append(F.octet_length(F.to_json(F.col(f.name) if kind != "array" else F.struct(f.name))))
    if held:
        width = sum((F.coalesce(x, F.lit(0)) for x in held), F.lit(fixed))
        size = df.agg(F.coalesce(F.sum(F.greatest(width, F.lit(row_bytes)).cast("long")), F.lit(0))).first()[0]
    else:
        size = df.count() * max(fixed, row_bytes)
    return F.broadcast(df) if size <= limit else df
