"""Reversible line dedup: exact reference-count tables, with sharded cuckoo filters before them.

The holders table has a row for each document and long line in it; the reference-count table has for each line key the
number of documents that hold it and the largest of them. A key that enough documents hold is repeated; each shard of
keys has a cuckoo filter of its repeated keys, into which keys go when they become repeated and from which they go
when deletions make them rare again. Filters that are together small enough are broadcast; beyond that the lines are
sent to the filter of their shard, large shards to several copies of it. Either way the filters spare the join with the
exact table the lines that no filter knows; the exact table decides.

Nulls: a null text is one empty line. A document without an id is neither counted nor changed. Rows that repeat an id
are one document: they count once and lose the same lines. Ties: of the documents with a line the largest id keeps it,
in all its rows and places. Lines below the least length never count. Very long texts are split in one task; an empty
table has an empty result; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Documents that must hold a line, and code points that its key must have.
MIN_DOCS, MIN_CHARS = 3, 20
#: Repeated keys of a shard, about, and bytes of all filters that may be broadcast.
SHARD_KEYS, FILTER_BYTES = 1 << 15, 32 << 20
#: Lines that one copy of a filter looks at, about, where they are sent to it.
COPY_LINES = 1 << 22
SLOTS = 4
_SPACE = " \t\n\v\f\r"


def line_key(line: str, least: int = MIN_CHARS) -> bytes | None:
    """The key of a line: a strong digest of it without white space at its ends, A-Z lower-cased; None if it is short."""
    line = line.strip(_SPACE)
    return hashlib.sha256(line.encode().lower()).digest()[:16] if len(line) >= least else None


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four, of keys given as 128-bit digests. Keys can be deleted again."""

    def __init__(self, capacity: int, slots: bytes | None = None):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(capacity, 1) / SLOTS / 0.8))))
        self.slots = np.zeros((self.buckets, SLOTS), np.uint16)
        if slots is not None:
            self.slots = np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()
            self.buckets = len(self.slots)

    def _where(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (keys[:, 0] >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (keys[:, 1] & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, one, self._other(mark, one)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (shared.mix(mark.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._where(keys)
        return ((self.slots[one] == mark[:, None]) | (self.slots[two] == mark[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Adds keys; False if the filter is too full (build a larger one from the exact table)."""
        mark, bucket, _ = self._where(keys)
        rng = np.random.default_rng(1)
        for turn in range(500):
            if not len(mark):
                return True
            by = np.argsort(bucket, kind="stable")
            mark, bucket = mark[by], bucket[by]
            first = np.searchsorted(bucket, bucket)
            free = self.slots[bucket] == 0
            fits = np.arange(len(bucket)) - first < free.sum(axis=1)
            nth = np.cumsum(free, axis=1)
            slot = np.argmax(free & (nth == (np.arange(len(bucket)) - first + 1)[:, None]), axis=1)
            self.slots[bucket[fits], slot[fits]] = mark[fits]
            mark, bucket, first = mark[~fits], bucket[~fits], np.append(True, bucket[~fits][1:] != bucket[~fits][:-1])[: (~fits).sum()]
            if turn and len(mark):  # one key of each full bucket takes the place of another
                slot = rng.integers(0, SLOTS, len(mark))
                out = self.slots[bucket[first], slot[first]]
                self.slots[bucket[first], slot[first]] = mark[first]
                mark = np.where(first, 0, mark)
                mark[first] = out
            bucket = self._other(mark, bucket)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Removes keys that are in the filter, one copy of the fingerprint each."""
        for mark, one, two in zip(*(x.tolist() for x in self._where(keys)), strict=True):
            for b in (one, two):
                at = np.flatnonzero(self.slots[b] == mark)
                if len(at):
                    self.slots[b, at[0]] = 0
                    break


def _words(keys: pa.Array) -> np.ndarray:
    """Binary keys of 16 bytes as pairs of 64-bit words."""
    data, _ = shared.utf8(keys)
    return data.view(np.uint8).reshape(-1, 16).view(np.uint64)


class LineIndex(NamedTuple):
    """holders: key, doc, each pair once. references: key, n_docs, last_doc. filters: shard, slots (bytes of a cuckoo
    filter). The rest says how it was made, and updates keep to that."""

    holders: DataFrame
    references: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int


def _holders(it: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch, _, _ in shared.batches(it, "words"):
        keys, docs = [], []
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("words").to_pylist(), strict=True):
            own = {line_key(x, least) for x in text.split("\n")} - {None} if len(text) >= least else ()
            keys += own
            docs += [doc] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(docs, pa.int64())], names=["key", "doc"])


def holders(documents: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    source = documents.select(F.col(doc_id).cast("bigint").alias("doc"), shared.text_or_empty(text).alias("words"))
    source = source.filter("doc IS NOT NULL")
    held = source.mapInArrow(partial(_holders, least=min_chars), "key binary, doc bigint")
    # Ids that several rows have are few, as a rule: only their lines are made distinct.
    again = shared.stored(source.groupBy("doc").count().filter("count > 1").select("doc"), "repeated")
    if again.isEmpty():
        return held
    return held.join(again, "doc", "left_anti").select("key", "doc").unionByName(held.join(again, "doc", "left_semi").select("key", "doc").distinct())


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A shard's filter: the old one, if there is one, with keys added (+1) and deleted (-1); a new one of them all if it gets full."""
    old = [x for x in table.column("slots").to_pylist() if x is not None]
    rows = table.filter(pc.is_valid(table.column("key")))
    keys = _words(rows.column("key"))
    change = rows.column("change").to_numpy()
    made = CuckooFilter(max(len(keys), 64), old[0] if old else None)
    if old:
        made.delete(keys[change < 0])
        fits = made.insert(keys[change > 0])
    else:
        fits = made.insert(keys[change >= 0])
    room = max(len(keys), 64)
    while not fits:
        room *= 2
        made = CuckooFilter(room)
        fits = made.insert(keys[change >= 0])
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "slots": pa.array([made.slots.tobytes()], pa.binary())})


def _filters(repeated: DataFrame, old: DataFrame | None, shards: int) -> DataFrame:
    """repeated: key and change: +1 becomes repeated, -1 is no longer, 0 stays."""
    rows = repeated.select(_shard(shards).alias("shard"), "key", "change", F.lit(None).cast("binary").alias("slots"))
    if old is not None:
        rows = rows.unionByName(old.select("shard", F.lit(None).cast("binary").alias("key"), F.lit(0).alias("change"), "slots"))
    return rows.groupBy("shard").applyInArrow(_build, "shard int, slots binary")


def build_index(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int | None = None) -> LineIndex:
    """The index of documents. By default as many shards as hold SHARD_KEYS repeated keys each."""
    held = shared.stored(holders(documents, doc_id, text, min_chars), "holders")
    references = shared.stored(counted(held), "references")
    repeated = references.filter(F.col("n_docs") >= min_docs)
    shards = shards or max(1, -(-repeated.count() // SHARD_KEYS))
    filters = shared.stored(_filters(repeated.select("key", F.lit(1).alias("change")), None, shards), "filters")
    return LineIndex(held, references, filters, shards, min_docs, min_chars)


def update_index(index: LineIndex, added: DataFrame | None = None, removed: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
    """The index with documents added and with the ids in removed deleted; an id that is removed and added is replaced.

    Added lines are a table beside the old ones; deletions write the holders anew. Only keys that the change touches are
    counted again, and only filters of shards whose repeated keys change are loaded; the other filters stay.
    """
    held, touched = index.holders, None
    if removed is not None:
        gone = removed.select(F.col(doc_id).cast("bigint").alias("doc")).distinct()
        touched = held.join(gone, "doc", "left_semi").select("key")
        held = shared.stored(held.join(gone, "doc", "left_anti").select("key", "doc"), "holders")
    if added is not None:
        new = shared.stored(holders(added, doc_id, text, index.min_chars).join(held, ["key", "doc"], "left_anti"), "holders-new")
        touched = new.select("key") if touched is None else touched.unionByName(new.select("key"))
        held = held.select("key", "doc").unionByName(new)
    if touched is None:
        return index
    touched = shared.stored(touched.distinct(), "touched")
    recounted = shared.stored(counted(held.join(touched, "key", "left_semi")), "recounted")
    references = shared.stored(index.references.join(touched, "key", "left_anti").unionByName(recounted), "references")
    many = F.col("n_docs") >= index.min_docs
    now = recounted.filter(many).select("key", F.lit(1).alias("now"))
    was = index.references.join(touched, "key", "left_semi").filter(many).select("key", F.lit(1).alias("was"))
    change = now.join(was, "key", "full").select("key", (F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("change")).filter("change != 0")
    moved = shared.stored(change.withColumn("shard", _shard(index.shards)), "moved")
    open_ = moved.select("shard").distinct()
    # A filter that gets full is made anew, so all repeated keys of its shard come along.
    stay = references.filter(many).select("key", _shard(index.shards).alias("shard")).join(open_, "shard", "left_semi").join(moved.select("key"), "key", "left_anti")
    keys = moved.select("key", "change").unionByName(stay.select("key", F.lit(0).alias("change")))
    made = _filters(keys, index.filters.join(open_, "shard", "left_semi"), index.shards)
    filters = shared.stored(index.filters.join(open_, "shard", "left_anti").unionByName(made), "filters")
    return LineIndex(held, references, filters, index.shards, index.min_docs, index.min_chars)


def _known(it: Iterator[pa.RecordBatch], handle) -> Iterator[pa.RecordBatch]:
    filters = {k: CuckooFilter(0, x) for k, x in handle.value.items()}
    for batch in it:
        shard, keys = batch.column("shard").to_numpy(), _words(batch.column("key"))
        keep = np.zeros(len(shard), bool)
        for k in np.unique(shard):
            if k in filters:
                on = shard == k
                keep[on] = filters[k].contains(keys[on])
        yield batch.filter(pa.array(keep)).select(["key", "doc"])


def _sifted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and copy, before whose lines stands their filter: the lines that the filter knows."""
    where, own = None, None
    for batch in it:
        shard, copy = batch.column("shard").to_numpy(), batch.column("copy").to_numpy()
        is_filter = batch.column("slots").is_valid().to_numpy(zero_copy_only=False)
        keep = np.zeros(len(batch), bool)
        starts = np.flatnonzero(np.concatenate([[len(batch) > 0], (shard[1:] != shard[:-1]) | (copy[1:] != copy[:-1])]))
        for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
            if (shard[a], copy[a]) != where:
                where, own = (shard[a], copy[a]), None
            if is_filter[a]:
                own = CuckooFilter(0, batch.column("slots")[int(a)].as_py())
                a += 1
            if own is not None and a < b:
                keep[a:b] = own.contains(_words(batch.column("key").slice(a, b - a)))
        yield batch.filter(pa.array(keep)).select(["key", "doc"])


def _sent(index: LineIndex, copy_lines: int) -> DataFrame:
    """The lines that the filter of their shard knows, each line sent to a copy of it."""
    shard = _shard(index.shards).alias("shard")
    copies = index.references.groupBy(shard).agg(F.ceil(F.sum("n_docs") / copy_lines).cast("int").alias("copies"))
    copies = shared.stored(copies.join(index.filters.select("shard"), "shard"), "copies")
    none = F.lit(None).cast("binary")
    filters = index.filters.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "slots", none.alias("key"), F.lit(None).cast("bigint").alias("doc"))
    lines = index.holders.select(shard, "key", "doc").join(copies, "shard").select("shard", F.pmod(F.xxhash64("doc"), F.col("copies")).cast("int").alias("copy"), none.alias("slots"), "key", "doc")
    placed = filters.unionByName(lines).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("slots").isNull())
    return placed.mapInArrow(_sifted, "key binary, doc bigint")


def losses(index: LineIndex, filter_bytes: int = FILTER_BYTES, copy_lines: int = COPY_LINES) -> DataFrame:
    """doc, keys: the lines that each document loses; documents that lose none have no row."""
    spark = index.holders.sparkSession
    size = index.filters.agg(F.coalesce(F.sum(F.octet_length("slots")), F.lit(0))).first()[0]
    if size <= filter_bytes:
        handle = spark.sparkContext.broadcast({r["shard"]: bytes(r["slots"]) for r in index.filters.collect()})
        rows = index.holders.select(_shard(index.shards).alias("shard"), "key", "doc").mapInArrow(partial(_known, handle=handle), "key binary, doc bigint")
    else:
        rows = _sent(index, copy_lines)
    repeated = index.references.filter(F.col("n_docs") >= index.min_docs)
    lost = rows.join(repeated, "key").filter("doc != last_doc").select("doc", "key")
    return lost.groupBy("doc").agg(F.collect_set("key").alias("keys"))


def _rebuild(it: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch, _, _ in shared.batches(it, "words"):
        kept, n_lines, n_dropped = [], [], []
        for text, keys in zip(batch.column("words").to_pylist(), batch.column("keys").to_pylist(), strict=True):
            total = text.count("\n") + 1
            n_lines.append(total)
            if keys:
                gone, lines = set(keys), text.split("\n")
                lines = [x for x in lines if line_key(x, least) not in gone]
                text, total = "\n".join(lines), len(lines)
            kept.append(text)
            n_dropped.append(n_lines[-1] - total)
        own = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("words", "keys")]
        names = [c for c in batch.schema.names if c not in ("words", "keys")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "kept", "n_lines", "n_dropped"])


def dedup_lines(documents: DataFrame, index: LineIndex | None = None, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per document: doc, kept (its text without repeated lines), n_lines, n_dropped. The index is built of the
    documents unless one is given."""
    index = index or build_index(documents, doc_id=doc_id, text=text, min_docs=min_docs, min_chars=min_chars)
    source = documents.select(F.col(doc_id).cast("bigint").alias("doc"), shared.text_or_empty(text).alias("words"))
    lost = losses(index, filter_bytes).withColumnRenamed("doc", "lost_doc")
    joined = source.join(lost, source["doc"] == lost["lost_doc"], "left").select("doc", "words", "keys")
    return joined.mapInArrow(partial(_rebuild, least=index.min_chars), "doc bigint, kept string, n_lines bigint, n_dropped bigint")


def drop_repeated_lines(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All columns of the documents, with the text as dedup_lines() leaves it; a null text stays null."""
    index = build_index(documents, doc_id=doc_id, text=text, **options)
    lost = losses(index).withColumnRenamed("doc", "lost_doc")
    source = documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("row"), F.col(doc_id).cast("bigint").alias("doc"), shared.text_or_empty(text).alias("words"))
    joined = source.join(lost, source["doc"] == lost["lost_doc"], "left").select("row", "words", "keys")
    schema = f"row {joined.schema['row'].dataType.simpleString()}, kept string, n_lines bigint, n_dropped bigint"
    done = joined.mapInArrow(partial(_rebuild, least=index.min_chars), schema)
    kept = F.when(F.col("row")[text].isNotNull(), F.col("kept"))
    return done.select(*((kept if c == text else F.col("row")[c]).alias(c) for c in documents.columns))


def op1(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(documents).select(F.col("doc").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
