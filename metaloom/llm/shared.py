"""Helpers that the operators of this subpackage share.

Texts reach Python as Arrow string columns. The helpers here look at their UTF-8 bytes as numpy arrays, a quarter
of a megabyte at a time, so that the memory of a task does not depend on the size of its Arrow batches.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy code looks at in one go (a single longer text is still taken whole).
CHUNK_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests), a temporary folder that becomes the setting."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="metaloom-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys (longs) up to which they are broadcast: about 64 MB where they are hashed.
BROADCAST_KEYS = 2_000_000


def with_keys(rows: DataFrame, key: str, keys: DataFrame, most: int = BROADCAST_KEYS) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key (a long, never null) is among keys (its one column), and the others, without a shuffle of rows:
    the keys are broadcast if they are counted to be few. Beyond that all rows, and None: a join must tell them apart."""
    known = keys.toDF("known_key").distinct()
    if known.limit(most + 1).count() > most:
        return rows, None
    on = F.col(key) == F.col("known_key")
    return rows.join(F.broadcast(known), on, "left_semi"), rows.join(F.broadcast(known), on, "left_anti")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each row starts (one more entry than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of at most that many bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def batches(it: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each run of rows of an Arrow stream with the bytes of its text column and their offsets."""
    for batch in it:
        data, offsets = utf8(batch.column(text))
        for i, j in chunks(offsets, most):
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


# --- words -----------------------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, A-Z as a-z.
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []

#: A word is a run of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def _powers(n: int) -> list[np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES) + 1
        for base in (_BASE, _UNBASE):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS.append(np.multiply.accumulate(factors))
        del _POWERS[:-2]
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, A-Z as a-z."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * down[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, for each row, where its words start (one more entry than rows)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = WORD[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    starts[first] = inside[first]
    ends = inside
    last = ends.copy()
    last[:-1] &= ~inside[1:]
    final = offsets[1:][offsets[1:] > 0] - 1
    last[final] = inside[final]
    begin, end = np.flatnonzero(starts), np.flatnonzero(last) + 1
    return span_hashes(data, begin, end), np.searchsorted(begin, offsets)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]], zero for empty runs."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths: the run of each entry, and its place in the run."""
    counts = np.asarray(counts, np.int64)
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
