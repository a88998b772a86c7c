"""Exact dedup against a minimal perfect hash of historical digests.

Documents become strong digests of their texts without white space. Each shard of historical distinct digests gets a
minimal perfect hash; its slots hold the full digests and the winner of each. Newer digests are looked up there, byte
by byte: those found join the historical group, the others form groups of their own. A group's winner is the row with
the most code points, then the smallest id.

Nulls: a null text is empty; empty texts are equal. A null id counts as the largest. Rows that repeat an id and a text
are equal in all columns of the result. A very long text is normalised and hashed whole; what is kept of it is its digest and
length. An empty table has an empty result; other columns change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Digests of a shard, about.
SHARD_DIGESTS = 1 << 16
_SPACE = b" \t\n\v\f\r"


class PerfectHash:
    """A minimal perfect hash of distinct digests (rows of 32 bytes): levels of bits, in which lone keys find a place.

    slot() gives 0 to n - 1 for its own keys, each once; for others any slot or -1.
    """

    def __init__(self, digests: np.ndarray, gamma: float = 2.0):
        parts = self._parts(digests)
        self.sizes, bits = [], []
        left = np.arange(len(parts))
        while len(left):
            size = max(64, int(gamma * len(left)))
            at = self._place(parts[left], len(self.sizes), size)
            lone = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            bits.append(lone)
            left = left[~lone[at]]
        self.bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.before = np.cumsum(self.bits) - self.bits

    @staticmethod
    def _parts(digests: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)

    @staticmethod
    def _place(parts: np.ndarray, level: int, size: int) -> np.ndarray:
        h = shared.mix(parts[:, 0] + np.uint64(level + 1) * (parts[:, 1] | np.uint64(1)) + parts[:, 2])
        return (h % np.uint64(size)).astype(np.int64)

    def slot(self, digests: np.ndarray) -> np.ndarray:
        parts, found = self._parts(digests), np.full(len(digests), -1)
        left, start = np.arange(len(parts)), 0
        for level, size in enumerate(self.sizes):
            at = start + self._place(parts[left], level, size)
            hit = self.bits[at]
            found[left[hit]] = self.before[at[hit]]
            left, start = left[~hit], start + size
        return found


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in shared.batches(it, "words"):
        chars = shared.segment_sums(((data & 0xC0) != 0x80).astype(np.int64), offsets)
        raw = data.tobytes()
        digest = [hashlib.sha256(raw[a:b].translate(None, _SPACE)).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(digest, pa.binary()), pa.array(chars, pa.int64())], names=["doc", "digest", "chars"])


def digests(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, digest of the text without white space, chars (code points of the text)."""
    source = documents.select(F.col(doc_id).cast("bigint").alias("doc"), shared.text_or_empty(text).alias("words"))
    return source.mapInArrow(_digests, "doc bigint, digest binary, chars bigint")


def groups(rows: DataFrame) -> DataFrame:
    """For each digest its winner and size: digest, chars, doc, size."""
    best = F.max(F.struct("chars", F.bitwise_not("doc").alias("rank")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("size")).select("digest", F.col("best.chars").alias("chars"), F.bitwise_not("best.rank").alias("doc"), "size")


def _matrix(table: pa.Table) -> np.ndarray:
    data, _ = shared.utf8(table.column("digest"))
    return data.reshape(-1, 32)


def _lookup(history: pa.Table, new: pa.Table) -> pa.Table:
    """The groups of a shard: historical ones with what newer rows add, and those of newer rows alone."""
    columns = ["digest", "chars", "doc", "size"]
    if not len(history) or not len(new):
        return pa.concat_tables([history.select(columns), new.select(columns)])
    old, fresh = _matrix(history), _matrix(new)
    index = PerfectHash(old)
    order = np.empty(len(old), np.int64)
    order[index.slot(old)] = np.arange(len(old))  # slot -> row: digest and winner locator
    at = index.slot(fresh)
    row = order[np.maximum(at, 0)]
    member = (at >= 0) & (old[row] == fresh).all(axis=1)
    size = history.column("size").to_numpy().copy()
    chars, doc = history.column("chars").to_numpy().copy(), np.array(history.column("doc").to_pylist(), object)
    other = np.array(new.column("doc").to_pylist(), object)
    new_chars, new_size = new.column("chars").to_numpy(), new.column("size").to_numpy()
    rank = lambda c, d: (-c, d is None, d or 0)
    for i in np.flatnonzero(member):
        r = row[i]
        size[r] += new_size[i]
        if rank(new_chars[i], other[i]) < rank(chars[r], doc[r]):
            chars[r], doc[r] = new_chars[i], other[i]
    merged = pa.table({"digest": history.column("digest"), "chars": chars, "doc": pa.array(doc, pa.int64()), "size": size})
    return pa.concat_tables([merged, new.filter(pa.array(~member)).select(columns)])


def exact_groups(rows: DataFrame, historical) -> DataFrame:
    """The groups of digests(), of which rows where historical holds are indexed and the others (also those for which it
    is null) looked up."""
    past = F.coalesce(historical, F.lit(False))
    old, new = groups(rows.filter(past)), groups(rows.filter(~past))
    shards = max(1, -(-rows.count() // SHARD_DIGESTS))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")
    pair = old.select(shard, "*").groupBy("shard").cogroup(new.select(shard, *(F.col(c).alias(c) for c in new.columns)).groupBy("shard"))

    def lookup(left, right):
        return _lookup(left, right)

    return pair.applyInArrow(lookup, "digest binary, chars bigint, doc bigint, size bigint")


def exact_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", historical=None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    historical: a condition on doc for the rows that are indexed (where it is null a row is not); by default every second
    one by a hash of its id.
    """
    rows = shared.stored(digests(documents, doc_id, text), "digests")
    past = (F.pmod(F.xxhash64("doc"), F.lit(2)) == 0) if historical is None else historical
    found = exact_groups(rows, past).select("digest", F.col("doc").alias("keep_id"), F.col("chars").alias("keep_chars"), F.col("size").alias("group_size"))
    joined = rows.join(found, "digest")
    kept = F.col("doc").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return joined.select(F.col("doc").alias(doc_id), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op4(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
