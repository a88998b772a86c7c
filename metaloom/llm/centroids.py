"""Centroid clustering with Drake's adaptive bounds.

Each vector carries its own centroid, lower bounds of the distances to its several nearest other centroids, and one
lower bound for all the rest. After centroids move, bounds shrink by how far each moved. A vector stays where it is when
its exact distance to its own centroid is below all bounds; if only stored bounds are too low, those centroids alone are
measured; if the bound of the rest is, all are. Measuring is exact, in whole numbers, so ties go to the smaller
centroid; a bound that is equal certifies nothing. The number of stored bounds adapts: each round keeps as many as the
last one needed, between an eighth and a quarter of the centroids.

Each round writes vectors with their bounds to the shared folder and reads them again; a centroid's sums are taken by
Spark from what was written, so a round that lost executors gives the same. What reaches the driver is bounded by
centroids times components, whatever the number of vectors.

Vectors that are null, have another number of components, or a component that is null or not finite have no row.
Repeated rows and ids are vectors of their own; a null id has a row and seeds a centroid only when fewer ids are not
null than there are centroids. Equal seed hashes go by components. Fewer vectors than centroids make fewer centroids.
An empty table has an empty result; other columns change nothing. Distances are exact as long as scaled components are
below 2**27 in size; a larger one ends the run with an error, as distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

CENTROIDS, COMPONENTS, SCALE, ROUNDS = 16, 64, 64, 3
#: Scaled components of a smaller size have exact distances in 64 bits, and in doubles.
EXACT_LONG, EXACT_DOUBLE = 1 << 27, 1 << 22
#: Rows that are measured in one go.
ROWS = 4096
#: Bounds are doubles: lower ones are made smaller, and exact roots larger, by this share.
SLACK = 1e-12


def kept_vectors(vectors: DataFrame, *, vec_id: str, embedding: str, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the vectors that count, each component as floor(scale * component)."""
    x = F.col(embedding).cast("array<double>")
    fit = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), x.alias("raw")).filter((F.size("raw") == components) & F.forall("raw", fit))
    scaled = F.transform("raw", lambda c: F.floor(c * scale).cast("long"))
    unfit = F.raise_error(F.concat(F.lit("a component is too large for exact distances: vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))
    small = F.forall("raw", lambda c: F.abs(c * scale) < EXACT_LONG)
    return rows.select("vec_id", F.when(small, scaled.cast("array<int>")).otherwise(unfit.cast("array<int>")).alias("x"))


def seeds(kept: DataFrame, centroids: int = CENTROIDS, seed: int = 1) -> np.ndarray:
    """The vectors whose ids hash lowest, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(centroids).collect()
    return np.array([r["x"] for r in rows], np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all of c, as longs."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT_DOUBLE and x.shape[1] <= 128:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def _ranked(d: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each row the order of its columns by distance; equal ones by the number of the centroid."""
    by_name = np.argsort(names, axis=1, kind="stable")
    order = np.argsort(np.take_along_axis(d, by_name, 1), axis=1, kind="stable")
    return np.take_along_axis(by_name, order, 1)


def _below(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 - SLACK)


class Bounds:
    """Clusters and bounds of a run of vectors: own centroid, near (others, nearest first), lower, rest, used."""

    def __init__(self, x: np.ndarray, c: np.ndarray, keep: int):
        self.x, self.c, self.keep = x, c, min(keep, len(c) - 1)
        n = len(x)
        self.own, self.distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.near, self.lower = np.zeros((n, self.keep), np.int64), np.zeros((n, self.keep))
        self.rest, self.used = np.full(n, np.inf), np.zeros(n, np.int64)

    def scan(self, rows: np.ndarray) -> None:
        """Measure all centroids for these rows."""
        if not len(rows):
            return
        k, keep = len(self.c), self.keep
        d = distances(self.x[rows], self.c)
        order = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, order, 1)
        self.own[rows], self.distance[rows] = order[:, 0], d[:, 0]
        self.near[rows], self.lower[rows] = order[:, 1 : keep + 1], _below(d[:, 1 : keep + 1])
        self.rest[rows] = _below(d[:, keep + 1]) if k > keep + 1 else np.inf
        self.used[rows] = k

    def carry(self, own: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray, moved: np.ndarray) -> None:
        """Take over bounds from before the centroids moved this far, and measure what they cannot certify."""
        lower = lower - moved[near]
        lower -= np.abs(lower) * SLACK
        rest = rest - moved.max(initial=0.0)
        rest -= np.where(np.isfinite(rest), np.abs(rest) * SLACK, 0)
        if near.shape[1] > self.keep:  # fewer are kept from now on: the others join the rest
            rest = np.minimum(rest, lower[:, self.keep :].min(1))
            near, lower = near[:, : self.keep], lower[:, : self.keep]
        distance = ((self.x - self.c[own]) ** 2).sum(1)
        root = np.sqrt(distance.astype(np.float64)) * (1 + SLACK)
        self.own[:], self.distance[:], self.near[:], self.lower[:], self.rest[:] = own, distance, near, lower, rest
        low = lower <= root[:, None]
        # Bounds up to the last one that is too low are measured; beyond it all are larger than the own distance.
        self.used[:] = np.where(low.any(1), self.keep - np.argmax(low[:, ::-1], axis=1), 0) if self.keep else 0
        everything = rest <= root
        self.scan(np.flatnonzero(everything))
        some = np.flatnonzero(~everything & (self.used > 0))
        for used in np.unique(self.used[some]):
            self.measure(some[self.used[some] == used], int(used))

    def measure(self, rows: np.ndarray, used: int) -> None:
        """Measure the first stored centroids of these rows; the nearest of them and the own one becomes the own."""
        names = np.concatenate([self.own[rows, None], self.near[rows, :used]], 1)
        d = np.stack([self.distance[rows], *(((self.x[rows] - self.c[names[:, i]]) ** 2).sum(1) for i in range(1, used + 1))], 1)
        order = _ranked(d, names)
        names, d = np.take_along_axis(names, order, 1), np.take_along_axis(d, order, 1)
        self.own[rows], self.distance[rows] = names[:, 0], d[:, 0]
        self.near[rows, :used], self.lower[rows, :used] = names[:, 1:], _below(d[:, 1:])


_STATE = "own int, distance bigint, near array<int>, lower array<double>, rest double, used int"


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1), kind))


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _assign(it: Iterator[pa.RecordBatch], c: np.ndarray, moved: np.ndarray | None, keep: int) -> Iterator[pa.RecordBatch]:
    for whole in it:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            b = Bounds(_matrix(batch.column("x"), np.int64), c, keep)
            if moved is None:
                b.scan(np.arange(batch.num_rows))
            else:
                before = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("own", "rest")]
                b.carry(before[0].astype(np.int64), _matrix(batch.column("near"), np.int64), _matrix(batch.column("lower"), np.float64), before[1], moved)
            found = [pa.array(b.own, pa.int32()), pa.array(b.distance), _lists(b.near, pa.int32()), _lists(b.lower, pa.float64()), pa.array(b.rest), pa.array(b.used, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("x"), *found], names=["vec_id", "x", "own", "distance", "near", "lower", "rest", "used"])


def assign(vectors: DataFrame, c: np.ndarray, moved: np.ndarray | None, keep: int) -> DataFrame:
    """Vectors with cluster, distance and bounds; moved (how far each centroid moved) is None where none are known."""
    kind = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, x array<int>, {_STATE}"
    return vectors.mapInArrow(partial(_assign, c=c, moved=moved, keep=keep), kind)


def moved_centroids(assigned: DataFrame, c: np.ndarray) -> tuple[np.ndarray, int]:
    """The floors of the means of each cluster (an empty one stays), and the most bounds that a vector needed."""
    sums = [F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(c.shape[1])]
    used = F.max(F.when(F.col("used") < len(c), F.col("used")).otherwise(0)).alias("used")
    new, most = c.copy(), 0
    for r in assigned.groupBy("own").agg(F.count("*").alias("n"), used, *sums).collect():  # a row for each centroid
        new[r["own"]] = [r[f"s{i}"] // r["n"] for i in range(c.shape[1])]
        most = max(most, r["used"])
    return new, most


def cluster(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", centroids: int = CENTROIDS, components: int = COMPONENTS, scale: int = SCALE, rounds: int = ROUNDS, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Vectors (vec_id, x, own, distance and bounds) by the final centroids, and those centroids."""
    state = shared.stored(kept_vectors(vectors, vec_id=vec_id, embedding=embedding, components=components, scale=scale), "vectors")
    c, keep, moved = seeds(state, centroids, seed), centroids // 4, None
    for step in range(rounds + 1):
        if not len(c):
            return assign(state, c, None, 0), c  # no vectors
        state = shared.stored(assign(state, c, moved, keep), f"clusters-{step}")
        if step < rounds:
            new, used = moved_centroids(state, c)
            if moved is not None:
                keep = min(keep, max(centroids // 8, used))
            moved, c = np.sqrt(((new - c) ** 2).sum(1).astype(np.float64)) * (1 + SLACK), new
    return state, c


def op11(spark, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that counts."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return report(*cluster(vectors))


def report(assigned: DataFrame, c: np.ndarray) -> DataFrame:
    """Assigned vectors beside what is known of their clusters, a row for each centroid."""
    known = assigned.groupBy("own").agg(F.sum("distance").alias("s")).collect()
    total = sum(r["s"] for r in known)
    digest = lambda row: hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()
    rows = [(r["own"], r["s"], total, digest(c[r["own"]])) for r in known]
    each = assigned.sparkSession.createDataFrame(rows, "own int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(each), "own").select("vec_id", F.col("own").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
