"""Detection of periodic runs of words with a suffix automaton.

A run is a stretch of words with smallest period q, of at least max(12, 2 q) words, that no neighbouring word extends. In
a suffix automaton the end positions of a state are those of its suffix-link children together. They are merged from the
longest states on, the smaller ordered set into the larger one; where an inserted position and a neighbour lie no
further apart than the state is long, the words between are a square, whose period is that distance. Each square is
extended to both sides, and of equal stretches the smallest period stays. Every run is found: the first of its words
less one period occur twice, q apart, in a state that is at least that long, and no occurrence lies between, for a
smaller period would follow.

A run of 12 words or more holds a window of 6 words twice, and such windows cover it. So the automaton is built only of
stretches that repeated windows of their own cover without a gap; elsewhere there can be no run. That is exact: nothing
is lost by it. The automaton compares words themselves; hashes only choose the stretches.

Each document is looked at whole, in one task, as rows of a partition stream by; nothing is shuffled. A null text has no
words; an empty one neither. A very long text takes memory for one automaton of its repeated stretch, about 400 bytes a
word. Repeated rows are rows of their own. Runs of equal start go by period; the longest run of a document is the first
one of equal length. An empty table has an empty result; other columns change nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Words of a run at least, and half of them: a window of so many words occurs twice in each run.
LEAST = 12
#: Positions in a block of an ordered set.
BLOCK = 4096
#: Times that stretches are narrowed to windows that repeat in them (more would only save time).
NARROWINGS = 6

Run = tuple[int, int, int]


class Ends:
    """End positions in ascending order, in blocks."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, end: int):
        self.blocks, self.firsts, self.size = [[end]], [end], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, end: int) -> tuple[int | None, int | None]:
        """Insert a position that is not there; its neighbours."""
        blocks = self.blocks
        b = max(bisect_right(self.firsts, end) - 1, 0) if len(blocks) > 1 else 0
        block = blocks[b]
        i = bisect_left(block, end)
        before = block[i - 1] if i else blocks[b - 1][-1] if b else None
        after = block[i] if i < len(block) else blocks[b + 1][0] if b + 1 < len(blocks) else None
        block.insert(i, end)
        self.size += 1
        if not i:
            self.firsts[b] = end
        if len(block) > BLOCK:
            half = len(block) // 2
            blocks[b : b + 1] = [block[:half], block[half:]]
            self.firsts.insert(b + 1, blocks[b + 1][0])
        return before, after


def automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton of a sequence: length and suffix link of each state, and the state of each prefix."""
    step, link, length, prefixes = [{}], [-1], [0], []
    last = 0
    for n, w in enumerate(words, 1):
        new = len(length)
        step.append({})
        length.append(n)
        link.append(0)
        prefixes.append(new)
        p = last
        while p >= 0 and w not in (edges := step[p]):
            edges[w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(length)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = copy
                    p = link[p]
        last = new
    return length, link, prefixes


def squares(words: list, least: int = LEAST) -> dict[int, list[int]]:
    """Ends of squares by their period, among them one in each run."""
    length, link, prefixes = automaton(words)
    ends: list[Ends | None] = [None] * len(length)
    for i, state in enumerate(prefixes):
        ends[state] = Ends(i)
    found: dict[int, list[int]] = {}
    half = least // 2
    for v in np.argsort(np.array(length), kind="stable")[::-1].tolist():
        p = link[v]
        if p < 0 or (reach := length[p]) < half:  # too short for the words that a run repeats
            ends[v] = None
            continue
        small, large = ends[v], ends[p]
        ends[v] = None
        if large is None:
            ends[p] = small
            continue
        if small.size > large.size:
            small, large = large, small
        ends[p] = large
        for e in small:
            before, after = large.add(e)
            if before is not None and (d := e - before) <= reach and d + reach >= least:
                found.setdefault(d, []).append(e)
            if after is not None and (d := after - e) <= reach and d + reach >= least:
                found.setdefault(d, []).append(after)
    return found


def runs_of(words: list, least: int = LEAST) -> list[Run]:
    """All runs (start, length, period) by start, then period."""
    n, best = len(words), {}
    for period, ends in squares(words, least).items():
        until = -1
        for end in sorted(ends):
            if end < until:
                continue  # in the stretch before
            until, start = end + 1, end - period
            while until < n and words[until] == words[until - period]:
                until += 1
            while start > 0 and words[start - 1] == words[start - 1 + period]:
                start -= 1
            if until - start >= max(least, 2 * period):
                best[start, until] = min(period, best.get((start, until), period))
    return sorted((start, until - start, period) for (start, until), period in best.items())


_FACTORS = np.random.default_rng(7).integers(1, 1 << 62, LEAST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def stretches(hashes: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches [a, b) that hold all runs: each is covered by windows that it has more than once."""
    n, size = len(hashes), least // 2
    if n < least:
        return []
    grams = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        grams += hashes[i : n - size + 1 + i] * _FACTORS[i % len(_FACTORS)]
    grams = shared.mix(grams)
    ordered = np.sort(grams)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    at, part = np.arange(len(grams)), np.zeros(len(grams), np.int64)  # windows still there, and their stretches
    firsts = lasts = np.zeros(0, np.int64)
    for _ in range(NARROWINGS):
        order = np.lexsort((grams[at], part))
        same = (grams[at][order][1:] == grams[at][order][:-1]) & (part[order][1:] == part[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        if twice.all() and len(firsts):
            break
        at = at[twice]
        if not len(at):
            return []
        breaks = np.flatnonzero(np.diff(at) > size)
        firsts, lasts = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])] + size
        part = np.searchsorted(firsts, at, side="right")
    return [(a, b) for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True) if b - a >= least]


def document_runs(words: list[bytes], least: int = LEAST) -> list[Run]:
    """All runs of a document by start, then period."""
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    return [(a + start, length, period) for a, b in stretches(hashes, least) for start, length, period in runs_of(words[a:b], least)]


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words but for those that repeat a run's first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


Reorder = Callable[[object, int], np.ndarray | None]
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(it: Iterator[pa.RecordBatch], least: int, reorder: Reorder | None) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i, j in shared.chunks(shared.utf8(batch.column("words"))[1], 1 << 20):
            part = batch.slice(i, j - i)
            found, texts = [], []
            for doc, text in zip(part.column("doc").to_pylist(), part.column("words").cast(pa.large_binary()).to_pylist(), strict=True):
                words = (text or b"").split()  # of bytes: at the six ASCII white space characters alone
                order = reorder(doc, len(words)) if reorder else None
                if order is not None:
                    words = [words[k] for k in order.tolist()]
                runs = document_runs(words, least)
                found.append(runs)
                texts.append(b" ".join(collapse(words, runs)))
            flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays([part.column("doc"), runs, pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())], names=["doc", "runs", "collapsed"])


def find_runs(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, reorder: Reorder | None = None) -> DataFrame:
    """doc_id, runs (start, length, period of each), collapsed (the text's words but for what runs repeat, by one space).

    reorder gives for an id and a number of words which word stands at each place (None: as they are).
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    source = documents.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("words"))
    schema = f"doc {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return source.mapInArrow(partial(_find, least=least, reorder=reorder), schema).withColumnRenamed("doc", doc_id)


def planted(doc: object, n: int) -> np.ndarray | None:
    """Of a tenth of the documents the end is made periodic. Without an id a document stays as it is."""
    if doc is None or not n:
        return None
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % period
    return at


def op13(spark, sf_dir: str) -> DataFrame:
    """Runs of each document, told by the longest one and by digests."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_runs(documents, reorder=planted)
    # The greatest length comes first; of equal ones the smallest start, then period.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    each = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.less")
    return each.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
