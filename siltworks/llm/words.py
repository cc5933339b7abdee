"""Words, lines and hashes shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a longest run of Unicode letters and digits.
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case words of a text, in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def host(url: Column) -> Column:
    """Host of a URL without case, blanks, port, user and leading ``www.``; null if there is none."""
    h = F.regexp_extract(F.lower(F.trim(url)), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@\s]*@)?([^/?#:\s]+)", 1)
    h = F.regexp_replace(h, r"^www\.", "")
    return F.when(h != "", h)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: neighbouring inputs give unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def ragged(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat uint64 values and row offsets (n + 1) of an Arrow list<int64> column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = col.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    val = col.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return val[off[0] : off[-1]], off - off[0]


def at_least(b: pa.RecordBatch, col: int, least: int) -> pa.RecordBatch:
    """The rows of a batch whose list has ``least`` values or more; as a predicate of Spark it would have the lists made twice."""
    return b.filter(pc.fill_null(pc.greater_equal(pc.list_value_length(b.column(col)), least), False))


def shingles(v: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` values, flat; the last k-1 places of the array are dropped."""
    n = len(v) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix(v[:n] + np.uint64(1))
    for j in range(1, k):
        out = mix(out * np.uint64(31) + v[j : j + n])
    return out
