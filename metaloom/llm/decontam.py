"""Benchmark decontamination by an FM-index for each training shard.

A shard is a bounded run of whole documents of one Spark partition. Its words become symbols of 16 bits, its
suffixes are sorted, and the Burrows-Wheeler transform is held as a wavelet matrix. All test phrases of a benchmark
search a shard at once, backwards, by wavelet ranks; occurrences are located by walking to sampled suffix positions,
checked against the full word hashes, and merged to spans. The windows of the benchmark are made and counted by Spark,
each once, and taken in passes of a bounded number; with one pass, documents are never shuffled.

Nulls: a null document or item text has no words. An item without words has no window; one without an id is called
"null". Items that share an id are one item. Rows that repeat a document id stay rows of their own. A very long text is
a shard of its own. Ties do not occur: spans are merged. An empty benchmark hits nothing; no document, no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Words of a test phrase.
WINDOW = 13
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 1 << 18
#: Every so many-th position of a shard keeps its suffix position.
SAMPLE = 8
#: Documents of a shard, at most (they may have no words).
SHARD_ROWS = 1 << 16
#: Windows of items that one pass over the documents takes: about 150 bytes each on the driver and in every task.
PASS_WINDOWS = 1 << 18
#: Items of a window that a pass names by themselves; a window of more is named by a mark.
ITEMS_EACH = 64
OWN, MARK = "=", "#"
END, BREAK, LEAST = 0, 1, 2


def symbols(hashes: np.ndarray) -> np.ndarray:
    """16-bit symbols of word hashes; 0 and 1 stay free."""
    return (hashes % np.uint64((1 << 16) - LEAST)).astype(np.uint16) + np.uint16(LEAST)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a text whose last symbol is its only 0: by four symbols, then doubling where ties are left."""
    n = len(s)
    wide = np.zeros(n + 3, np.uint64)
    wide[:n] = s
    key = (wide[:n] << np.uint64(48)) | (wide[1 : n + 1] << np.uint64(32)) | (wide[2 : n + 2] << np.uint64(16)) | wide[3 : n + 3]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    lone = new & np.append(new[1:], True)
    open_ = np.flatnonzero(~lone)  # places in the order whose suffix still ties with another
    step = 4
    while len(open_):
        at = order[open_]
        key = (rank[at] << 32) | rank[at + step]  # a suffix that ties is longer than step: the text's end is unique
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        rank[at] = np.repeat(open_[first], np.diff(np.append(first, len(key))))
        open_ = open_[~(new & np.append(new[1:], True))]
        step *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence of 16-bit symbols, a level for each bit."""

    def __init__(self, s: np.ndarray):
        self.ones, self.zeros = [], []
        for bit in range(15, -1, -1):
            b = (s >> np.uint16(bit)) & np.uint16(1)
            count = np.zeros(len(s) + 1, np.int32)
            np.cumsum(b, dtype=np.int32, out=count[1:])
            self.ones.append(count)
            b = b.view(np.int16).astype(bool)
            left = s[~b]
            self.zeros.append(len(left))
            s = np.concatenate([left, s[b]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before i. The start of its run is found beside it."""
        begin = np.zeros(len(i), np.int64)
        i = i.astype(np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (15 - level)) & 1).astype(bool)
            up, start = ones[i], ones[begin]
            i = np.where(bit, zeros + up, i - up)
            begin = np.where(bit, zeros + start, begin - start)
        return i - begin

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i, and how often each stands before it."""
        i = i.astype(np.int64)
        begin, symbol = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            up, start = ones[i], ones[begin]
            bit = ones[i + 1] > up
            symbol = (symbol << 1) | bit
            i = np.where(bit, zeros + up, i - up)
            begin = np.where(bit, zeros + start, begin - start)
        return symbol, i - begin


class FMIndex:
    """The index of one shard, given as symbols of which the last is the only 0."""

    def __init__(self, s: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(s)
        self.smaller = np.zeros((1 << 16) + 1, np.int64)
        np.cumsum(np.bincount(s, minlength=1 << 16), out=self.smaller[1:])
        self.bwt = WaveletMatrix(s[order - 1])
        self.marked = order % sample == 0
        self.place = np.cumsum(self.marked) - 1
        self.samples = order[self.marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each phrase (symbols, right-aligned in a matrix)."""
        width = phrases.shape[1]
        last = phrases[:, -1].astype(np.int64)
        low, high = self.smaller[last], self.smaller[last + 1]
        for back in range(2, width + 1):
            on = np.flatnonzero((lengths >= back) & (high > low))
            if not len(on):
                break
            c = phrases[on, width - back].astype(np.int64)
            low[on] = self.smaller[c] + self.bwt.rank(c, low[on])
            high[on] = self.smaller[c] + self.bwt.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        found = np.zeros(len(rows), np.int64)
        on, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(on):
            known = self.marked[rows]
            found[on[known]] = self.samples[self.place[rows[known]]] + steps
            on, rows = on[~known], rows[~known]
            if len(on):
                c, before = self.bwt.access(rows)
                rows = self.smaller[c] + before
            steps += 1
        return found


class Phrases(NamedTuple):
    """Windows of benchmark items, each once, in flat arrays."""

    #: Word hashes and symbols, right-aligned in rows of the longest window; how many words each has.
    words: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    #: Items of window i: names[items[starts[i] : starts[i + 1]]].
    names: list[str]
    items: np.ndarray
    starts: np.ndarray


def make_phrases(table: pa.Table, window: int = WINDOW) -> Phrases:
    """Phrases of a table of item (a name) and window (the bytes of its word hashes), each pair once."""
    windows, names = table.column("window").combine_chunks().dictionary_encode(), table.column("item").combine_chunks().dictionary_encode()
    data, offsets = shared.utf8(windows.dictionary)
    lengths = np.diff(offsets) // 8
    words = np.zeros((len(lengths), window), np.uint64)
    row, place = shared.spread(lengths)
    words[row, window - lengths[row] + place] = data.copy().view(np.uint64)
    which = windows.indices.to_numpy()
    by = np.argsort(which, kind="stable")
    return Phrases(words, symbols(words), lengths, names.dictionary.to_pylist(), names.indices.to_numpy()[by], np.searchsorted(which[by], np.arange(len(lengths) + 1)))


def _windows(it: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in shared.batches(it, "words"):
        hashes, at = shared.words(data, offsets)
        counts = np.diff(at)
        row, place = shared.spread(np.where(counts > 0, np.maximum(counts - window + 1, 1), 0))
        first, size = at[row] + place, np.minimum(counts[row], window)
        raw = hashes.tobytes()
        found = [raw[8 * a : 8 * (a + n)] for a, n in zip(first.tolist(), size.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), pa.array(found, pa.binary())], names=["item", "window"])


def windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """item, window: every window of each item once."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("words"))
    return items.mapInArrow(partial(_windows, window=window), "item string, window binary").distinct()


def shard_hits(hashes: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, list[list[int]], list[list[tuple[int, int]]]]:
    """For each document of a shard: words hit, items that occur, and merged word spans [begin, end)."""
    docs = len(offsets) - 1
    n_hit, items, spans = np.zeros(docs, np.int64), [[] for _ in range(docs)], [[] for _ in range(docs)]
    if not len(hashes) or not len(phrases.lengths):
        return n_hit, items, spans
    # Equal documents are indexed once.
    same: dict[bytes, int] = {}
    of = np.array([same.setdefault(hashes[a:b].tobytes(), i) for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True))])
    one = np.unique(of)
    run, place = shared.spread(offsets[one + 1] - offsets[one] + 1)  # a break after each document
    source = np.minimum(offsets[one][run] + place, len(hashes) - 1)
    stop = np.append(run[1:] != run[:-1], True)
    full = np.where(stop, np.uint64(0), hashes[source])
    s = np.append(np.where(stop, np.uint16(BREAK), symbols(full)), np.uint16(END))
    index = FMIndex(s)
    low, high = index.search(phrases.symbols, phrases.lengths)
    which, nth = shared.spread(high - low)
    if not len(which):
        return n_hit, items, spans
    at = index.locate(low[which] + nth)
    size = phrases.lengths[which]
    good = np.ones(len(at), bool)  # symbols are hashes of 16 bits: compare the whole hashes
    width = phrases.words.shape[1]
    for k in range(1, width + 1):
        on = size >= k
        good[on] &= full[at[on] + size[on] - k] == phrases.words[which[on], width - k]
    at, size, which = at[good], size[good], which[good]
    edge = np.zeros(len(full) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    hit = np.cumsum(edge)[:-1] > 0
    starts = np.concatenate([[0], np.flatnonzero(stop) + 1])
    counts = shared.segment_sums(hit.astype(np.int64), starts)
    pairs: dict[int, set[int]] = {}
    for d, w in set(zip(run[at].tolist(), which.tolist(), strict=True)):
        pairs.setdefault(d, set()).update(phrases.items[phrases.starts[w] : phrases.starts[w + 1]].tolist())
    turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    begin, end = turn[::2], turn[1::2]
    own: dict[int, list[tuple[int, int]]] = {}
    for d, a, b in zip(run[begin].tolist(), (begin - starts[run[begin]]).tolist(), (end - starts[run[begin]]).tolist(), strict=True):
        own.setdefault(d, []).append((a, b))
    number = {int(x): i for i, x in enumerate(one)}
    for d in range(docs):
        u = number[int(of[d])]
        n_hit[d], items[d], spans[d] = counts[u], sorted(pairs.get(u, ())), own.get(u, [])
    return n_hit, items, spans


_SCHEMA = "{id} {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<begin:bigint,end:bigint>>"


def _shards(it: Iterator[pa.RecordBatch], text: str, shard_words: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Runs of whole rows with their word hashes and where each row's start."""
    rows: list[pa.RecordBatch] = []
    held: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    for batch, data, offsets in shared.batches(it, text):
        hashes, at = shared.words(data, offsets)
        rows.append(batch)
        held.append(hashes)
        sizes.append(np.diff(at))
        if sum(map(len, held)) >= shard_words or sum(map(len, rows)) >= SHARD_ROWS:
            yield rows, np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            rows, held, sizes = [], [], []
    if rows:
        yield rows, np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _search(it: Iterator[pa.RecordBatch], handle, id_column: str, text: str, shard_words: int) -> Iterator[pa.RecordBatch]:
    phrases: Phrases = handle.value
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for rows, hashes, offsets in _shards(it, text, shard_words):
        n_hit, items, spans = shard_hits(hashes, offsets, phrases)
        key = pa.concat_arrays([x.column(id_column) for x in rows])
        names = [sorted(phrases.names[i] for i in x) for x in items]
        marks = [[{"begin": a, "end": b} for a, b in x] for x in spans]
        yield pa.RecordBatch.from_arrays([key, pa.array(np.diff(offsets), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(marks, kind)], names=[id_column, "n_words", "n_hit", "items", "spans"])


def _change(it: Iterator[pa.RecordBatch], handle, text: str, shard_words: int, share: int | None) -> Iterator[pa.RecordBatch]:
    """Whole rows: without those that are contaminated (by share), or all with their texts stripped (share None)."""
    for rows, hashes, offsets in _shards(it, text, shard_words):
        n_hit, _, spans = shard_hits(hashes, offsets, handle.value)
        keep = ~((n_hit > 0) & (share * n_hit >= np.diff(offsets))) if share else None
        done = 0
        for batch in rows:
            own = slice(done, done + len(batch))
            done += len(batch)
            yield batch.filter(pa.array(keep[own])) if share else _stripped(batch, text, spans[own])


def _stripped(batch: pa.RecordBatch, text: str, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    at = batch.schema.get_field_index(text)
    texts = [x if x is None or not own else strip_spans(x, own) for x, own in zip(batch.column(at).to_pylist(), spans, strict=True)]
    return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type))


def merged(spans):
    """An array of spans as sorted spans of which none touch."""
    empty = F.array().cast("array<struct<begin:bigint,end:bigint>>")

    def add(done, span):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (last["end"] >= span["begin"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), empty, add)


class Passes(NamedTuple):
    """The passes over the documents that a benchmark takes."""

    blocks: int
    #: The broadcast phrases of each pass, made when it comes.
    handles: Iterator
    #: mark, item: the items of windows that more items share than a broadcast names. Null if there is no such window.
    shared_by: DataFrame | None


def _passes(benchmark: DataFrame, item_id: str, item_text: str, window: int, pass_windows: int, items_each: int, named: bool = True) -> Passes:
    """A window is whole in one pass. What comes to the driver for a pass is bounded: a window of more than items_each
    items is named by a mark there, and its items stay in a table; not named, windows come without items."""
    spark = benchmark.sparkSession
    every = windows(benchmark, item_id, item_text, window)
    every = shared.stored(every if named else every.select(F.lit("").alias("item"), "window").distinct(), "windows")
    shared_by = None
    often = every.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > items_each).select("window", F.sha2("window", 256).alias("mark"))
    if named and not often.isEmpty():
        often = shared.stored(often, "shared-windows")
        shared_by = shared.stored(every.join(often, "window").select("mark", "item"), "shared-items")
        own = every.join(often, "window", "left_anti").select(F.concat(F.lit(OWN), "item").alias("item"), "window")
        every = shared.stored(own.unionByName(often.select(F.concat(F.lit(MARK), "mark").alias("item"), "window")), "windows")
    blocks = max(1, -(-every.count() // pass_windows))
    part = lambda k: every.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
    return Passes(blocks, (spark.sparkContext.broadcast(make_phrases(part(k).toArrow(), window)) for k in range(blocks)), shared_by)


def _named(found: DataFrame, shared_by: DataFrame) -> DataFrame:
    """found with the items that marks stand for. Documents with the same marks and items are looked up once."""
    marked = F.exists("items", lambda x: x.startswith(MARK))
    found = shared.stored(found.withColumn("__set", F.when(marked, F.sha2(F.to_json("items"), 256))), "found")
    each = found.filter("__set IS NOT NULL").select("__set", "items").distinct().select("__set", F.explode("items").alias("x"))
    rest = F.substring("x", 2, 2**31 - 1)
    looked_up = each.filter(F.col("x").startswith(MARK)).select("__set", rest.alias("mark")).join(shared_by, "mark").select("__set", "item")
    every = each.filter(F.col("x").startswith(OWN)).select("__set", rest.alias("item")).unionByName(looked_up)
    sets = every.groupBy("__set").agg(F.array_sort(F.collect_set("item")).alias("__items"))
    plain = F.transform("items", lambda x: F.substring(x, 2, 2**31 - 1))
    return found.join(sets, "__set", "left").withColumn("items", F.coalesce("__items", plain)).drop("__set", "__items")


def contamination(documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, pass_windows: int = PASS_WINDOWS, items_each: int = ITEMS_EACH) -> DataFrame:
    """One row per document: its id, n_words, n_hit, items (ids as sorted strings) and spans of words hit.

    Each pass_windows windows of the benchmark are a pass over the documents. Passes follow one another, each with its
    broadcast alone; they are written, and their spans merged by id and text. Items of windows that more than items_each
    items share are joined to what was found, by sets of such windows.
    """
    blocks, handles, shared_by = _passes(benchmark, item_id, item_text, window, pass_windows, items_each)
    key = F.col(doc_id) if blocks == 1 else F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("mark"))
    source = documents.select(key.alias("doc"), F.col(text).alias("words"))
    schema = _SCHEMA.format(id="doc", kind=source.schema["doc"].dataType.simpleString())
    one = lambda x: source.mapInArrow(partial(_search, handle=x, id_column="doc", text="words", shard_words=shard_words), schema)
    named = lambda found: found if shared_by is None else _named(found, shared_by)
    if blocks == 1:
        return named(one(next(handles))).withColumnRenamed("doc", doc_id)
    parts = []
    for k, x in enumerate(handles):
        # The first pass keeps all documents, the others those that they hit.
        found = one(x) if k == 0 else one(x).filter("n_hit > 0")
        parts.append(shared.stored(found.withColumn("block", F.lit(k)), "pass"))
        x.unpersist()
    every = reduce(DataFrame.unionByName, parts)
    part = F.when(F.col("n_hit") > 0, F.struct("block", "items", "spans"))
    joined = every.groupBy("doc").agg(F.max("n_words").alias("n_words"), F.collect_set(part).alias("parts"), F.count_if(F.col("block") == 0).alias("rows"))
    joined = joined.withColumns({"items": F.array_sort(F.array_distinct(F.flatten("parts.items"))), "spans": merged(F.flatten("parts.spans"))})
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["begin"])
    copies = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    return named(joined.select(F.col("doc.id").alias(doc_id), "n_words", hit.alias("n_hit"), "items", "spans", copies.alias("copy")).drop("copy"))


def verdicts(found: DataFrame, share: int = 20) -> DataFrame:
    """contamination() with the number and digest of the items, and whether a document counts as contaminated."""
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    bad = (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))
    return found.withColumns({"n_items": F.size("items").cast("bigint"), "items_sha256": digest, "contaminated": bad})


def _changed(documents: DataFrame, benchmark: DataFrame, text: str, share: int | None, options: dict) -> DataFrame:
    """Whole rows as _change() gives them. With several passes, hits by id and text are joined to the documents."""
    search = {"item_id": "item_id", "item_text": "text", "window": WINDOW, "pass_windows": PASS_WINDOWS, "items_each": ITEMS_EACH, "shard_words": SHARD_WORDS, "doc_id": "doc_id"} | options
    blocks, handles, _ = _passes(benchmark, search["item_id"], search["item_text"], search["window"], search["pass_windows"], search["items_each"], named=False)
    names = [f"c{i}" for i in range(len(documents.columns))]  # names may clash
    own = names[documents.columns.index(text)]
    plain = documents.toDF(*names)
    if blocks == 1:
        step = partial(_change, handle=next(handles), text=own, shard_words=search["shard_words"], share=share)
        return plain.mapInArrow(step, plain.schema).toDF(*documents.columns)
    mark = F.struct(F.xxhash64(own).alias("one"), F.sha2(F.coalesce(own, F.lit("")), 256).alias("two"))
    found = contamination(plain.select(mark.alias("key"), F.col(own).alias("words")).distinct(), benchmark, **(search | {"doc_id": "key", "text": "words"})).filter("n_hit > 0")
    found = verdicts(found, share or 1).filter("contaminated" if share else "true").select("key", "spans")
    if share:
        return plain.withColumn("key", mark).join(found, "key", "left_anti").select(*names).toDF(*documents.columns)
    joined = plain.withColumn("key", mark).join(found, "key", "left").select(*names, "spans")
    return joined.mapInArrow(partial(_strip, text=own), plain.schema).toDF(*documents.columns)


def _strip(it: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in it:
        spans = [[(x["begin"], x["end"]) for x in own or ()] for own in batch.column("spans").to_pylist()]
        yield _stripped(batch.select(batch.schema.names[:-1]), text, spans)


def clean(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, unchanged, each row once and judged by its own text whatever its id is.
    A null text has no words and stays."""
    return _changed(documents, benchmark, text, 20, options)


def strip(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """All documents, without the words of their texts that windows hit (and what stands between those)."""
    return _changed(documents, benchmark, text, None, options)


def strip_spans(text: str | None, spans: list[tuple[int, int]]) -> str:
    """A text without the words of these spans (and what stands between them)."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    inside = np.concatenate([[False], shared.WORD[raw], [False]])
    begin, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    keep = np.ones(len(raw), bool)
    for a, b in spans:
        keep[begin[a] : end[b - 1]] = False
    return raw[keep].tobytes().decode()


def op10(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return verdicts(contamination(documents, benchmark)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
