"""Near-duplicate join on word n-grams with Bayesian pruning of candidates.

Documents are sets of five-word shingles; two are linked at a Jaccard similarity of 0.8 or more. Equal sets become one
class first. Bands of MinHash values put the sets in buckets. Within a bucket the low bytes of MinHash values are
compared a few at a time, and a pair is dropped as soon as the posterior probability that it reaches the threshold
falls below the tolerance; what is left joins sets to clusters, so that pairs which met by chance join nothing. Only
sets of clusters are read again, as whole shingle sets, made once; within a cluster (in blocks, if it is large) all
MinHash values are compared in the same way and the pairs left are verified on the whole sets. No pair leaves a task:
it gives counts of links and a forest of them. Shingles are compared as hashes of 44 bits.

Nulls: a null or wordless text has no shingles, no links, and is a class of its own; fewer than five words are one
shingle. A null id links nothing and has a null class. Rows that repeat an id are documents of their own: with the same
text copies of each other, with another text as similar as the texts are. Ties: a class has the name of its least id.
Very long texts are one row of a task. An empty table has an empty result. Other columns change nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared
from .components import components

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Bands and MinHash values in each: a pair at 0.8 shares no band with probability (1 - 0.8**6)**32 < 7e-5.
BANDS, ROWS = 32, 6
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Sets of a block of a large bucket; sets and shingles of a block of a large cluster.
BUCKET_SETS, BLOCK_SETS, BLOCK_SHINGLES = 4096, 1024, 1 << 20
#: Keys up to which rows are told apart by a broadcast and not by a shuffle.
BROADCAST_KEYS = shared.BROADCAST_KEYS
_HASH_BITS = 44
_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 44-bit shingle hashes of each row, and where each row's start."""
    hashes, at = shared.words(data, offsets)
    counts = np.diff(at)
    n = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    row, place = shared.spread(n)
    first = at[row] + place
    total = np.zeros(len(first), np.uint64)
    for k in range(size):
        inside = place + k < counts[row]
        value = hashes[np.minimum(first + k, max(len(hashes) - 1, 0))] if len(hashes) else total
        total = total * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, value, np.uint64(k + 1))
    key = (row.astype(np.uint64) << np.uint64(_HASH_BITS)) | (shared.mix(total) >> np.uint64(64 - _HASH_BITS))
    key.sort()
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    own = (key >> np.uint64(_HASH_BITS)).astype(np.int64)
    return key & np.uint64((1 << _HASH_BITS) - 1), np.searchsorted(own, np.arange(len(offsets)))


def minhashes(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values of each row's set (a row for each; an empty set has the largest values)."""
    out = np.full((len(at) - 1, BANDS * ROWS), np.uint32(0xFFFFFFFF))
    x = sets.astype(np.uint32)
    full = np.flatnonzero(np.diff(at))
    for part in np.array_split(full, max(1, len(x) >> 16)):
        if len(part):
            low, high = at[part[0]], at[part[-1] + 1]
            y, starts = x[low:high], at[part] - low
            for k in range(BANDS * ROWS):
                out[part, k] = np.minimum.reduceat(y * _MUL[k] + _ADD[k], starts)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each row."""
    key = np.zeros((len(values), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = shared.mix(key * np.uint64(0xD6E8FEB86659FD93) + values[:, k::ROWS].astype(np.uint64))
    return key.view(np.int64)


def least_matches(n: int, similarity: float, tolerance: float) -> int:
    """The fewest of n equal MinHash values at which the posterior (uniform prior) still allows the threshold."""
    total, m = 0.0, -1
    while total < tolerance:
        m += 1
        total += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
    return m


def floors(similarity: float, tolerance: float) -> list[tuple[int, int]]:
    """After how many MinHash values how many must be equal."""
    return [(n, least_matches(n, similarity, tolerance)) for n in range(STEP, BANDS * ROWS + 1, STEP)]


def low_bytes(values: np.ndarray) -> np.ndarray:
    """A byte of each MinHash value that all its bits decide; two values that differ share it with probability 1/256."""
    return ((values * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def digests(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits for each row's set."""
    one, two = shared.mix(sets + np.uint64(0xA5A5)), shared.mix(sets * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    return np.stack([shared.segment_sums(one, at), shared.segment_sums(two, at)], axis=1).astype(">u8")


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes of one width as binary values."""
    rows = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    starts = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(starts.tobytes()), pa.py_buffer(rows.tobytes())])


def fixed_rows(column: pa.Array, width: int, kind: type = np.uint8) -> np.ndarray:
    """Binary values of one width as rows of a matrix."""
    return shared.utf8(column)[0].reshape(-1, width).view(kind)


_SIGNATURES = "doc bigint, mark bigint, n bigint, digest binary, bands array<bigint>, bytes binary"


def _signatures(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "mark", "n", "digest", "bands", "bytes"]
    for batch, data, offsets in shared.batches(it, "words"):
        sets, at = shingle_sets(data, offsets)
        n = np.diff(at)
        values = minhashes(sets, at)
        digest = digests(sets, at).view(np.uint8).reshape(-1, 16).copy()
        for i in np.flatnonzero(n == 0):  # a text without words is known by its bytes
            digest[i] = np.frombuffer(hashlib.sha256(data[offsets[i] : offsets[i + 1]].tobytes()).digest()[:16], np.uint8)
        starts = pa.array(np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32))
        bands = pa.ListArray.from_arrays(starts, pa.array(band_keys(values)[n > 0].ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("mark"), pa.array(n, pa.int64()), fixed_binary(digest), bands, fixed_binary(low_bytes(values))], names=names)


def groups(it: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by integer keys as tables of whole groups, with where each group starts (and the end)."""
    held: list[pa.RecordBatch] = []

    def out(rows: list[pa.RecordBatch], last: bool) -> tuple[pa.Table, np.ndarray, list[pa.RecordBatch]]:
        table = pa.Table.from_batches(rows).combine_chunks()
        new = np.zeros(len(table), bool)
        new[:1] = True
        for k in keys:
            column = table.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        starts = np.append(np.flatnonzero(new), len(table))
        if last or len(starts) < 2:
            return table, starts, []
        return table.slice(0, starts[-2]), starts[:-1], table.slice(starts[-2]).to_batches()  # the last group may go on

    for batch in it:
        held.append(batch)
        ends = [[x.column(k)[i].as_py() for k in keys] for x, i in ((held[0], 0), (batch, len(batch) - 1))] if len(batch) else [0, 0]
        if ends[0] != ends[1]:
            table, starts, held = out(held, False)
            if len(table):
                yield table, starts
    if held:
        table, starts, _ = out(held, True)
        if len(table):
            yield table, starts


def surviving(values: np.ndarray, i: int | np.ndarray, j: np.ndarray, floor: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of rows i (one, or one for each) and j are not dropped, as places in j."""
    on = np.arange(len(j))
    matches = np.zeros(len(j), np.int64)
    for n, least in floor:
        if not len(on):
            break
        own = i if np.isscalar(i) else i[on]
        matches += (values[j[on], n - STEP : n] == values[own, n - STEP : n]).sum(axis=1)
        good = matches >= least
        on, matches = on[good], matches[good]
    return on


def forest(values: np.ndarray, block: np.ndarray, across: bool, floor: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs of rows not dropped that connect all such pairs: rows that are connected already are not compared again."""
    label, edges = np.arange(len(values)), []
    for i in range(len(values) - 1):
        apart = label[i + 1 :] != label[i]
        if across:
            apart &= block[i + 1 :] != block[i]
        j = i + 1 + np.flatnonzero(apart)
        j = j[surviving(values, i, j, floor)]
        if len(j):
            found, first = np.unique(label[j], return_index=True)
            edges += [(i, int(k)) for k in j[first]]
            label[np.isin(label, found)] = label[i]
    return edges


def _meet(it: Iterator[pa.RecordBatch], floor: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Edges between the sets of each bucket that may be similar."""
    for table, starts in groups(it, ("band", "low", "high")):
        values, block = fixed_rows(table.column("bytes"), BANDS * ROWS), table.column("block").to_numpy()
        low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
        size = np.diff(starts)
        i = starts[:-1][(size == 2) & (low[starts[:-1]] == high[starts[:-1]])]
        i = i[surviving(values, i, i + 1, floor)]
        edges = list(zip(i.tolist(), (i + 1).tolist(), strict=True))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            across = bool(low[a] != high[a])
            if b - a > 2 or across:
                edges += [(a + x, a + y) for x, y in forest(values[a:b], block[a:b], across, floor)]
        if edges:
            one, two = (table.column("digest").take(pa.array(x)).combine_chunks() for x in zip(*edges, strict=True))
            yield pa.RecordBatch.from_arrays([one, two], names=["a", "b"])


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets and MinHash values of texts; rows whose text is not that of the set (they repeat its id) go."""
    for batch, data, offsets in shared.batches(it, "words"):
        sets, at = shingle_sets(data, offsets)
        values, found = minhashes(sets, at), digests(sets, at).view(np.uint8).reshape(-1, 16)
        same = pa.array((found == fixed_rows(batch.column("digest"), 16)).all(axis=1))
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))
        own = [batch.column(c) for c in ("digest", "component", "copies", "block", "blocks")]
        names = ["digest", "component", "copies", "block", "blocks", "shingles", "minhash"]
        yield pa.RecordBatch.from_arrays([*own, lists, fixed_binary(values)], names=names).filter(same)


def links(table: pa.Table, across: bool, similarity: float, floor: list[tuple[int, int]]) -> pa.Table:
    """Links within a block, or across two: for each set its linked sets and rows, and its least linked set."""
    digest = fixed_rows(table.column("digest"), 16)
    _, own = np.unique(digest, axis=0, return_index=True)  # a row that is there again counts once; in order of digests
    table = table.take(pa.array(own)).combine_chunks()
    copies, block = table.column("copies").to_numpy(), table.column("block").to_numpy()
    lists = table.column("shingles").combine_chunks()
    size = np.diff(lists.offsets.to_numpy().astype(np.int64))
    values = fixed_rows(table.column("minhash"), 4 * BANDS * ROWS, np.uint32)
    ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    by = np.argsort(size, kind="stable")
    begin = (np.cumsum(size) - size)[by]
    copies, block, size, values = copies[by], block[by], size[by], values[by]
    share = Fraction(str(similarity))
    n_links, rows = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
    parent = np.arange(len(by))
    flag = np.zeros(len(ids) and int(ids.max()) + 1, bool)
    top = np.searchsorted(size, size * share.denominator // share.numerator, side="right")

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(by) - 1):
        j = np.arange(i + 1, top[i])  # the larger sets that can reach the threshold
        if across:
            j = j[block[j] != block[i]]
        j = j[surviving(values, i, j, floor)]
        if not len(j):
            continue
        mine = ids[begin[i] : begin[i] + size[i]]
        flag[mine] = True
        run, place = shared.spread(size[j])
        common = shared.segment_sums(flag[ids[begin[j][run] + place]].astype(np.int64), np.concatenate([[0], np.cumsum(size[j])]))
        flag[mine] = False
        j = j[common * share.denominator >= share.numerator * (size[i] + size[j] - common)]
        if len(j):
            n_links[i] += len(j)
            rows[i] += copies[j].sum()
            n_links[j] += 1
            rows[j] += copies[i]
            for r in {root(int(k)) for k in j}:
                a, b = sorted((r, root(i)), key=lambda x: by[x])
                parent[b] = a
    least = by[[root(i) for i in range(len(by))]]
    on = n_links > 0
    name = table.column("digest").combine_chunks()
    return pa.table({"digest": name.take(pa.array(by[on])), "links": n_links[on], "rows": rows[on], "least": name.take(pa.array(least[on]))})


def _links(it: Iterator[pa.RecordBatch], similarity: float, floor: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for table, starts in groups(it, ("cluster", "low", "high")):
        low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield from links(table.slice(a, b - a), bool(low[a] != high[a]), similarity, floor).to_batches()


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """Rows with block and blocks, once for each pair (low, high) of blocks that their own is in, together in tasks and
    sorted by key and pair."""
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
    return rows.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high")


def _classes(documents: DataFrame, doc_id: str, text: str, similarity: float, tolerance: float) -> DataFrame:
    """A row for each row of documents with an id: doc, mark (of its text), n, the first row (doc and mark) with its set
    and the number of those, its links, and the first row of its class."""
    source = documents.select(F.col(doc_id).cast("bigint").alias("doc"), shared.text_or_empty(text).alias("words")).filter("doc IS NOT NULL")
    known = shared.stored(source.withColumn("mark", F.xxhash64("words")).mapInArrow(_signatures, _SIGNATURES), "signatures")
    # What is summed by a key and joined on it again is stored first: then large keys of the join can be split.
    same = known.groupBy("digest", "n").agg(F.min(F.struct("doc", "mark")).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    same = shared.stored(same, "classes")
    own = known.join(same, ["digest", "n"], "left").withColumns({"first": F.coalesce("first", F.struct("doc", "mark")), "copies": F.coalesce("copies", F.lit(1))})
    members = shared.stored(own.select("doc", "mark", "n", "digest", "first", "copies"), "members")
    heads = own.filter("n > 0 AND first.doc = doc AND first.mark = mark").select("doc", "n", "digest", "copies", "bands", "bytes")
    heads = shared.stored(heads, "heads")
    # Buckets of more than one set; of those with the same sets one is enough.
    bands = heads.select(F.explode("bands").alias("band"), "digest")
    many = shared.stored(bands.groupBy("band").count().filter("count > 1").select("band"), "bands")
    # Their number grows with the rows, so they are never broadcast: one plan at every size, whose hot bands can be split.
    met = shared.stored(bands.join(many.hint("merge"), "band").distinct(), "met")
    marks = [F.sum(F.pmod(F.xxhash64("digest", F.lit(i)), F.lit(1 << 31))).alias(f"mark{i}") for i in range(4)]
    buckets = met.groupBy("band").agg(F.count(F.lit(1)).alias("sets"), *marks).filter("sets > 1")
    buckets = buckets.groupBy("sets", "mark0", "mark1", "mark2", "mark3").agg(F.min("band").alias("band"))
    buckets = shared.stored(buckets.select("band", F.ceil(F.col("sets") / BUCKET_SETS).cast("int").alias("blocks")), "buckets")
    met = met.join(buckets, "band").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    met = met.join(heads.select("digest", "bytes"), "digest")
    byte = floors(similarity + (1 - similarity) / 256, tolerance)
    near = components(_blocks(met, "band").mapInArrow(partial(_meet, floor=byte), "a binary, b binary"))
    # The whole shingle sets of clusters, made once.
    placed = shared.stored(heads.select("doc", "n", "digest", "copies").distinct().join(near, F.col("digest") == F.col("node")).drop("node"), "placed")
    wide = shared.stored(placed.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "wide")
    placed = placed.join(wide, "component").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    # Only texts of clusters are shuffled, as long as the ids of those can be broadcast.
    wanted, _ = shared.with_keys(source, "doc", placed.select("doc"), BROADCAST_KEYS)
    texts = wanted.join(placed, "doc").select("digest", "component", "copies", "block", "blocks", "words")
    kind = "digest binary, component binary, copies bigint, block int, blocks int, shingles array<bigint>, minhash binary"
    sets = shared.stored(texts.mapInArrow(_sets, kind), "sets").withColumn("cluster", F.xxhash64("component")).drop("component")
    linked = _blocks(sets, "cluster").mapInArrow(partial(_links, similarity=similarity, floor=floors(similarity, tolerance)), "digest binary, links bigint, rows bigint, least binary")
    linked = shared.stored(linked, "links")
    named = components(linked.select(F.col("digest").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "digest")
    starts = members.filter("n > 0").select("digest", "first").distinct()
    named = shared.stored(named.join(starts, "digest"), "named")
    classes = shared.stored(named.groupBy("component").agg(F.min("first").alias("class")), "classes")
    sums = linked.groupBy("digest").agg(F.sum("links").alias("links"), F.sum("rows").alias("rows"))
    sums = shared.stored(sums.join(named.join(classes, "component").select("digest", "class"), "digest", "left"), "sums")
    zero = F.lit(0).cast("bigint")
    return members.join(sums, "digest", "left").select("doc", "mark", "n", "first", "copies", F.coalesce("class", "first").alias("class"), F.coalesce("links", zero).alias("links"), F.coalesce("rows", zero).alias("rows"))


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: its id, class_id (least id of its component of links and copies), copy_of (least id with
    its shingle set), n_links (other documents at the similarity or more), n_texts (linked shingle sets but its own).
    """
    rows = _classes(documents, doc_id, text, similarity, tolerance)
    has, zero = F.col("n") > 0, F.lit(0).cast("bigint")
    out = rows.select(
        "doc",
        F.when(has, F.col("class.doc")).otherwise(F.col("doc")).alias("class_id"),
        F.when(has, F.col("first.doc")).otherwise(F.col("doc")).alias("copy_of"),
        F.when(has, F.col("copies") - 1 + F.col("rows")).otherwise(zero).alias("n_links"),
        F.when(has, F.col("links")).otherwise(zero).alias("n_texts"),
    )
    none = F.lit(None).cast("bigint")
    unnamed = documents.select(F.col(doc_id).cast("bigint").alias("doc")).filter("doc IS NULL").select("doc", none.alias("class_id"), none.alias("copy_of"), zero.alias("n_links"), zero.alias("n_texts"))
    return out.unionByName(unnamed).withColumnRenamed("doc", doc_id)


def one_of_each(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> DataFrame:
    """The documents without all but one of each near-duplicate class: the row with the least id stays, of those with
    that id the one with the least hash of its text, of equal rows one. Texts without words are a class where their
    bytes are equal (null is empty). Rows without an id stay."""
    rows = _classes(documents, doc_id, text, similarity, tolerance)
    first = (F.col("doc") == F.col("class.doc")) & (F.col("mark") == F.col("class.mark"))
    gone = rows.filter(~first).select("doc", "mark").distinct()
    again = rows.filter(first & (F.col("copies") > 1)).groupBy("doc", "mark").count().filter("count > 1").select("doc", "mark")
    marks = shared.stored(gone.withColumn("again", F.lit(False)).unionByName(again.withColumn("again", F.lit(True))), "marks")
    key = F.struct(F.col(doc_id).cast("bigint").alias("doc"), F.xxhash64(shared.text_or_empty(text)).alias("mark"))
    source = documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("row"), key.alias("key"))
    # Rows that no mark can be about stay without a shuffle, as long as hashes of the marks can be broadcast.
    source = source.withColumn("hash", F.xxhash64("key.doc", "key.mark"))
    source, rest = shared.with_keys(source, "hash", marks.select(F.xxhash64("doc", "mark")), BROADCAST_KEYS)
    joined = source.join(marks, (F.col("key.doc") == F.col("doc")) & (F.col("key.mark") == F.col("mark")), "left")
    once = joined.filter("again").withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))).filter("at = 1")
    kept = joined.filter("again IS NULL").select("row").unionByName(once.select("row"))
    if rest is not None:
        kept = kept.unionByName(rest.select("row"))
    return kept.select(*(F.col("row")[c].alias(c) for c in documents.columns))


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
