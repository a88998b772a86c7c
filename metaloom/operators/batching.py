"""Greedy batches of commands in their order, under ceilings on sums of weights.

A batch ends where the next command would break a ceiling. Commands are cut by position into slices at least as long as
a batch can be, so a batch ends in its slice or the next. A task finds, for each place where a batch may come into its
slice, where the last batch that starts in the slice leaves it. These pairs of places are few; doubling them tells
where the chain from the first command comes into each slice, and the slices label their own rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import stored

#: Ceilings of an import batch.
MAX_RESOURCES, MAX_CHARACTERISTICS = 50_000, 500_000


def running_sums(rows: DataFrame, order: list[str], weights: list[str]) -> DataFrame:
    """Rows with position (from 0) and sum_<weight> up to and with each row.

    Ranges of the order are summed on their own; only the ranges' totals, one row for each, are summed over all.
    """
    placed = stored(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"), *(F.sum(w).alias(f"__w{i}") for i, w in enumerate(weights))).orderBy("__part").collect()
    start, offsets = [0] * (len(weights) + 1), []
    for t in totals:
        offsets.append((t["__part"], *start))
        start = [a + b for a, b in zip(start, t[1:], strict=True)]
    names = ["__rows", *(f"__w{i}" for i in range(len(weights)))]
    if not offsets:
        return placed.drop("__part").withColumns({"position": F.lit(0).cast("bigint"), **{f"sum_{w}": F.lit(0).cast("bigint") for w in weights}})
    before = rows.sparkSession.createDataFrame(offsets, "__part int, " + ", ".join(f"{n} bigint" for n in names))
    w = Window.partitionBy("__part").orderBy(*order)
    sums = {f"sum_{x}": F.col(f"__w{i}") + F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)) for i, x in enumerate(weights)}
    return placed.join(before, "__part").withColumns({"position": F.col("__rows") + F.row_number().over(w) - 1, **sums}).drop("__part", *names)


def _next(position: np.ndarray, sums: list[np.ndarray], weights: list[np.ndarray], most: list[int]) -> np.ndarray:
    """For each row of a run of rows the place in the run of the first that no longer fits in a batch started there."""
    end = np.full(len(position), len(position))
    for total, weight, ceiling in zip(sums, weights, most, strict=True):
        end = np.minimum(end, np.searchsorted(total, total - weight + ceiling, side="right"))
    return end


def _read(table: pa.Table, most: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The positions of rows in order, and _next() of them."""
    column = lambda name: table.column(name).to_numpy()
    by = np.argsort(column("position"))
    at = range(len(most))
    return column("position")[by], _next(column("position")[by], [column(f"s{i}")[by] for i in at], [column(f"w{i}")[by] for i in at], most)


def _leaves(next_: np.ndarray, end: int) -> np.ndarray:
    """For each place before end, where the chain of batches from it first comes to end or beyond."""
    out = next_[:end].copy()
    for i in range(end - 1, -1, -1):
        if out[i] < end:
            out[i] = out[out[i]]
    return out


def _pairs(key: tuple[pa.Scalar, ...], table: pa.Table, width: int, most: list[int]) -> pa.Table:
    """Where a batch may start first in this slice (low), and where the chain from there comes into the next one."""
    position, next_ = _read(table, most)
    slice_ = key[0].as_py()
    begin, end = np.searchsorted(position, [slice_ * width, (slice_ + 1) * width])
    ways = _leaves(next_, end) if begin < len(position) else np.zeros(0, np.int64)
    if slice_:
        low = np.unique(_leaves(next_, begin))
        low = low[low < end]
    else:
        low = np.zeros(min(1, len(position)), np.int64)
    high = ways[low]
    there = high < len(position)
    low, high = low[there], high[there]
    return pa.table({"low": position[low], "high": position[high]})


def _label(key: tuple[pa.Scalar, ...], table: pa.Table, width: int, most: list[int]) -> pa.Table:
    """Rows of a slice with the number of batches that have started in it, given where the chain comes into it."""
    position, next_ = _read(table, most)
    entry = table.column("entry").to_numpy()[0] if len(position) else 0
    end = int(np.searchsorted(position, (key[0].as_py() + 1) * width))
    starts = np.zeros(end, np.int64)
    i = int(np.searchsorted(position, entry))
    while i < end:
        starts[i] = 1
        i = int(next_[i])
    return pa.table({"position": position[:end], "started": np.cumsum(starts)})


def batches(rows: DataFrame, order: list[str], ceilings: dict[str, int]) -> DataFrame:
    """Rows with position and batch (from 0). Weights are at least 0, and at least one of them is at least 1 in each
    row; other rows, and one above a ceiling, are an error. A task holds the positions and sums of about two slices,
    each as long as the sum of the ceilings."""
    names, most = list(ceilings), list(ceilings.values())
    above = reduce(lambda a, b: a | b, [F.col(w) > m for w, m in ceilings.items()])
    idle = reduce(lambda a, b: a & b, [F.col(w) < 1 for w in names]) | reduce(lambda a, b: a | b, [F.col(w) < 0 for w in names])
    fault = rows.agg(F.max(above).alias("above"), F.max(idle).alias("idle")).first()
    if fault["above"]:
        raise ValueError("a single command is above a ceiling")
    if fault["idle"]:
        raise ValueError("a command has no weight, or a negative one")
    width = sum(most)

    def pairs(key, table):
        return _pairs(key, table, width, most)

    def label(key, table):
        return _label(key, table, width, most)

    summed = stored(running_sums(rows, order, names), "sums")
    narrow = summed.select("position", *(F.col(f"sum_{w}").alias(f"s{i}") for i, w in enumerate(names)), *(F.col(w).cast("bigint").alias(f"w{i}") for i, w in enumerate(names)))
    slice_ = F.floor(F.col("position") / width)
    around = narrow.withColumn("slice", F.explode(F.array(slice_ - 1, slice_, slice_ + 1))).filter("slice >= 0")
    jump = stored(around.groupBy("slice").applyInArrow(pairs, "low bigint, high bigint"), "pairs")
    # Where the chain from the first command comes into each slice: jumps of doubled length until there is no new place.
    entries = narrow.filter("position = 0").select("position")
    known = entries.count()
    while known:
        entries = stored(entries.unionByName(entries.join(jump, entries["position"] == jump["low"]).select(F.col("high").alias("position"))).distinct(), "entries")
        found = entries.count()
        if found == known:
            break
        known = found
        further = jump.select("low", F.col("high").alias("mid")).join(jump.select(F.col("low").alias("mid"), "high"), "mid")
        jump = stored(further.select("low", "high"), "pairs")
    entries = entries.select(slice_.alias("slice"), F.col("position").alias("entry"))
    own = narrow.withColumn("slice", F.explode(F.array(slice_ - 1, slice_))).join(entries, "slice")
    labelled = own.groupBy("slice").applyInArrow(label, "position bigint, started bigint")
    labelled = stored(labelled.withColumn("slice", slice_), "labels")
    before, offsets = 0, []
    for r in labelled.groupBy("slice").agg(F.max("started").alias("n")).orderBy("slice").collect():  # a row for each slice
        offsets.append((r["slice"], before))
        before += r["n"]
    base = rows.sparkSession.createDataFrame(offsets, "slice bigint, base bigint")
    numbered = labelled.join(base, "slice").select("position", (F.col("base") + F.col("started") - 1).alias("batch"))
    return summed.select(*rows.columns, "position").join(numbered, "position").select(*rows.columns, "position", "batch")


def batch_totals(batched: DataFrame, ceilings: dict[str, int]) -> DataFrame:
    return batched.groupBy("batch").agg(F.count(F.lit(1)).alias("n_commands"), *(F.sum(w).alias(f"total_{w}") for w in ceilings))
