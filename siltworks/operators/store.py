"""Keyed point tables: upsert, activate, delete, count; and their persistent form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.session import scratch


def latest(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The last row of each key in the given order (nulls first). Aggregated before the shuffle, so a hot key is no hot task."""
    cols = [c for c in df.columns if c != key]
    at = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), at).alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in cols))


def upserted(points: DataFrame, new: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """``points`` with the rows of ``new``; of one key the last in ``new`` by ``order`` replaces the stored row. Null keys are left out of ``new``."""
    put = latest(new.where(F.col(key).isNotNull()), key, *order)
    return points.join(put.select(key), key, "left_anti").unionByName(put, allowMissingColumns=True)


def built(chunks: DataFrame, key: str = "chunk_id", dense: str = "dense") -> DataFrame:
    """Points of embedded chunks; a chunk without a vector is an error when it is read."""
    from siltworks.functions.ids import point_id

    ok = F.when(F.coalesce(F.size(dense), F.lit(0)) > 0, F.col(dense)).otherwise(F.raise_error(F.concat(F.lit("no vector: "), F.coalesce(F.col(key), F.lit("null")))))
    return chunks.withColumn(dense, ok.cast(chunks.schema[dense].dataType)).withColumn("point_id", point_id(F.col(key)))


def with_active(points: DataFrame, where: Column, value: bool, flag: str = "is_active") -> DataFrame:
    """``flag`` set where the condition holds (null is no); other rows as they are."""
    return points.withColumn(flag, F.when(F.coalesce(where, F.lit(False)), F.lit(value)).otherwise(F.col(flag)))


def without(points: DataFrame, where: Column) -> DataFrame:
    """The rows for which the condition does not hold; null is no."""
    return points.where(~F.coalesce(where, F.lit(False)))


def removal(points: DataFrame, where: Column) -> DataFrame:
    """One row (matched, remaining): what a removal takes and leaves."""
    hit = F.coalesce(where, F.lit(False))
    return points.agg(F.count_if(hit).alias("matched"), F.count_if(~hit).alias("remaining"))


def vector_size(points: DataFrame, dense: str = "dense") -> int | None:
    """The length of the first vector that is not empty; null without any."""
    row = points.where(F.size(dense) > 0).select(F.size(dense)).first()
    return row[0] if row else None


class PointStore:
    """Collections of points as versioned Parquet directories.

    Every change writes a new version beside the old one and then the name of the current version, in one small file that
    is replaced whole; readers see the old or the new version, and a writer that dies leaves the old one. One writer at a
    time. Tables are clustered by ``file_id``, so a look-up by file prunes by Parquet statistics.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, key: str = "point_id", dense: str = "dense"):
        self.spark, self.path, self.key, self.dense = spark, path or scratch(spark, "points"), key, dense

    def _fs(self, p: str):  # noqa: ANN202
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(p)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        at, fs = self._fs(f"{self.path}/{name}/current")
        return fs.exists(at)

    def version(self, name: str) -> int:
        return int(self.spark.read.text(f"{self.path}/{name}/current").first()[0])

    def read(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise ValueError(f"no collection {name}")
        return self.spark.read.parquet(f"{self.path}/{name}/v{self.version(name)}")

    def _publish(self, name: str, df: DataFrame) -> None:
        n = self.version(name) + 1 if self.exists(name) else 0
        by = [c for c in ("file_id",) if c in df.columns]
        # a range by file and key: equal sizes even if one file holds a third of the rows
        out = df.repartitionByRange(*by, self.key).sortWithinPartitions(*by, self.key) if by else df
        out.write.mode("overwrite").parquet(f"{self.path}/{name}/v{n}")
        at, fs = self._fs(f"{self.path}/{name}/current")
        fs.mkdirs(at.getParent())
        stream = fs.create(at, True)
        stream.write(bytearray(str(n), "ascii"))
        stream.close()
        if n > 1:  # the version before stays for readers that have begun
            old, fs = self._fs(f"{self.path}/{name}/v{n - 2}")
            fs.delete(old, True)

    def create(self, name: str, points: DataFrame) -> None:
        """A new collection. Raises if there is one."""
        if self.exists(name):
            raise ValueError(f"collection {name} exists")
        self._publish(name, points)

    def recreate(self, name: str, points: DataFrame) -> None:
        """The collection with these points only."""
        self.drop(name)
        self._publish(name, points)

    def clone(self, source: str, target: str) -> None:
        self.create(target, self.read(source))

    def drop(self, name: str) -> None:
        at, fs = self._fs(f"{self.path}/{name}")
        fs.delete(at, True)

    def names(self, prefix: str = "") -> list[str]:
        at, fs = self._fs(self.path)
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in found if n.startswith(prefix) and self.exists(n))

    def upsert(self, name: str, new: DataFrame, *order: Column | str) -> None:
        """Put points by key. Raises if the vectors are of another length than the stored ones."""
        if not self.exists(name):
            self._publish(name, latest(new.where(F.col(self.key).isNotNull()), self.key, *order))
            return
        old = self.read(name)
        if self.dense in old.columns and self.dense in new.columns:
            a, b = vector_size(old, self.dense), vector_size(new, self.dense)
            if a and b and a != b:
                raise ValueError(f"vectors of {b}, not {a}")
        self._publish(name, upserted(old, new, self.key, *order))

    def set_active(self, name: str, file_id: str, value: bool, flag: str = "is_active") -> int:
        """Set the flag of a file's points; how many there are."""
        n = self.count(name, file_id)
        if n:
            self._publish(name, with_active(self.read(name), F.col("file_id") == file_id, value, flag))
        return n

    def delete(self, name: str, file_id: str) -> dict[str, int]:
        """Remove a file's points. Raises if there are none; else how many matched and how many of the file remain."""
        n = self.count(name, file_id)
        if not n:
            raise ValueError(f"no points of {file_id}")
        self._publish(name, without(self.read(name), F.col("file_id") == file_id))
        return {"matched": n, "remaining": self.count(name, file_id)}

    def count(self, name: str, file_id: str | None = None) -> int:
        df = self.read(name)
        return (df.where(F.col("file_id") == file_id) if file_id is not None else df).count()
