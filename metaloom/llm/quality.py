"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are single tokens and pairs of neighbours (words, and runs of other printable characters), and marks of the
text's length; a text is a sparse row of unit length. A bounded sample of labelled rows is dealt to buckets; each
bucket runs FTRL-proximal updates over its rows in an order fixed by their hash, from the state broadcast for the
round; the states of the buckets are averaged. Scoring is a sparse dot product with the broadcast weights.

Nulls: a null text is empty; an empty text has the mark of its length only. Rows without a label teach nothing; with
no labelled row every score is 0.5. A label beside a repeated id counts for each row of that id. Rows of equal hash (of a
repeated id) may train in either order. Scoring looks at a very long text whole, at some rows at a time. An empty table has an
empty result; other columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .langid import held_out

BITS = 18
#: About so many labelled rows, chosen by a hash of their id; buckets that train at once; rounds over them.
TRAIN_ROWS, BUCKETS, ROUNDS = 16_000, 8, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5

_KIND = np.full(256, 2, np.uint8)
_KIND[:33] = 0
_KIND[127] = 0
_KIND[shared.WORD] = 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (runs of word bytes, runs of other printable bytes) and where each row's start."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[offsets] = True
    edge = np.flatnonzero(new)
    begin, end = edge[:-1], edge[1:]
    on = kind[begin] > 0
    return shared.span_hashes(data, begin[on], end[on]), np.searchsorted(begin[on], offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes and values of each row in a run, and where each row's start."""
    h, at = tokens(data, offsets)
    row, _ = shared.spread(np.diff(at))
    pair = shared.mix(h[:-1] * np.uint64(3) + h[1:])[row[1:] == row[:-1]] if len(h) else h
    rows = np.arange(len(offsets) - 1)
    length = shared.mix(np.log2(np.diff(at) + 1.0).astype(np.uint64) + np.uint64(77))
    owner = np.concatenate([row, row[1:][row[1:] == row[:-1]], rows])
    # Counted by sorting the row and the index as one number.
    key = (owner.astype(np.uint64) << np.uint64(BITS)) | (np.concatenate([h, pair, length]) >> np.uint64(64 - BITS))
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    starts = np.searchsorted((key >> np.uint64(BITS)).astype(np.int64), np.arange(len(offsets)))
    value = np.sqrt(count)
    norm = np.sqrt(shared.segment_sums(value * value, starts))
    own, _ = shared.spread(np.diff(starts))
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), value / norm[own], starts


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal weights of a state."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(z: np.ndarray, n: np.ndarray, index: np.ndarray, value: np.ndarray, label: float) -> None:
    """One update of the state, in place."""
    own_z, own_n = z[index], n[index]
    w = weights(own_z, own_n)
    p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
    g = (p - label) * value
    sigma = (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / ALPHA
    z[index] = own_z + g - sigma * w
    n[index] = own_n + g * g


def _updates(handle):
    """A round over one bucket, from the state in handle."""

    def run(key, table):
        z, n = (x.copy() for x in handle.value)
        table = table.sort_by([("turn", "ascending")])
        data, offsets = shared.utf8(table.column("words"))
        label = table.column("label").to_numpy()
        for i, j in shared.chunks(offsets):
            index, value, at = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for k in range(j - i):
                learn(z, n, index[at[k] : at[k + 1]], value[at[k] : at[k + 1]], label[i + k])
        return pa.table({"z": pa.array([z.astype(np.float32).tobytes()], pa.binary()), "n": pa.array([n.astype(np.float32).tobytes()], pa.binary())})

    return run


def train(labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS, buckets: int = BUCKETS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights for all features. Of more than so many rows, a share chosen by a hash of doc_id is read."""
    spark = labelled.sparkSession
    known = labelled.select(F.xxhash64(F.lit("quality"), F.col(doc_id).cast("string")).alias("turn"), shared.text_or_empty(text).alias("words"), F.col(label).cast("double").alias("label")).filter("label IS NOT NULL")
    share = rows / max(known.count(), 1)
    if share < 1:
        known = known.filter(F.pmod("turn", F.lit(1_000_003)) < int(share * 1_000_003))
    known = shared.stored(known.withColumn("bucket", F.pmod(F.shiftright("turn", 24), F.lit(buckets)).cast("int")), "quality-sample")
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for _ in range(rounds):
        handle = spark.sparkContext.broadcast((z, n))
        run = _updates(handle)
        states = known.groupBy("bucket").applyInArrow(run, "z binary, n binary").collect()
        if not states:
            break
        z, n = (np.mean([np.frombuffer(s[c], np.float32) for s in states], axis=0).astype(np.float64) for c in ("z", "n"))
        handle.unpersist()
    return weights(z, n).astype(np.float32)


def _score(it: Iterator[pa.RecordBatch], handle) -> Iterator[pa.RecordBatch]:
    w = handle.value
    for batch, data, offsets in shared.batches(it, "words"):
        index, value, at = features(data, offsets)
        score = 1 / (1 + np.exp(-np.clip(shared.segment_sums(w[index] * value, at), -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(score, pa.float64())], names=["doc", "score"])


def score(documents: DataFrame, w: np.ndarray, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of whole texts."""
    handle = documents.sparkSession.sparkContext.broadcast(w)
    kind = documents.schema[doc_id].dataType.simpleString()
    source = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("words"))
    return source.mapInArrow(partial(_score, handle=handle), f"doc {kind}, score double").withColumnRenamed("doc", doc_id)


def op5(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(~held_out())
    found = score(documents, train(documents.join(labels, "doc_id")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
