"""Vector bin packing of token sequences.

Each task packs the rows of its own partition, so nothing is shuffled. Waiting pieces stand in a bounded pool. A
sequence has limits on tokens, segments and loss-bearing tokens; the piece with the largest dot product of its demand
and the sequence's free room (both as shares of the limits) goes in next. Where pieces may be cut, the piece that
scores best among all is cut to fill a sequence that no piece fits; the last sequence of a task is cut to powers of
two. Sequence ids are the task's partition number and a counter, so a task that runs again gives the same ids.

Nulls: a null text is empty and gives the end id alone. Null token counts of examples count as 0. Repeated rows are
packed each. Ties go to the piece that came first. An example larger than a sequence has a row with a null sequence_id
and offset, so that it can be cut and packed again. An empty table has an empty result; other columns change nothing.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Tokens of a sequence, and pieces in it.
MAX_TOKENS, MAX_SEGMENTS = 2048, 512
#: Pieces that wait in a task's pool.
POOL = 1024
#: Distinct parts of chunks whose ids a task remembers, and bytes of text that are split in one go.
CACHE, SPLIT_BYTES = 300_000, 1 << 20
#: The id after each document.
END_ID = 1


#: How word_bpe_49k.json normalizes and splits texts, as its file states it (fixed values).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PRE_TOKENS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies, by Latin-1 code point as UTF-8."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    byte = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(byte[b] for b in chr(c).encode()) for c in range(256)}


# Kinds of bytes: space or line break, letter, digit, other printable, and those that leave their chunk whole.
_SPACE, _LETTER, _DIGIT, _OTHER, _HARD = range(5)
_KIND = np.full(256, _HARD, np.uint8)
_KIND[33:127] = _OTHER
_KIND[[10, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[128:192] = _KIND[0xC3] = _LETTER
_KIND[39] = _HARD  # an apostrophe may begin one of the endings that the rule names
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The parts of the chunks between spaces and line breaks of UTF-8 rows, and where each row's parts start.

    Chunks of ASCII without apostrophes and of letters from U+00C0 to U+00FF are lower-cased and cut into letters, single
    digits and runs of others, as the rule above cuts them. All other chunks are one part each, as they are.
    """
    n = len(data)
    if not n:
        return pa.array([], pa.large_string()), np.zeros(len(offsets), np.int64)
    kind, low = _KIND[data], _LOWER[data]
    second = np.flatnonzero(data == 0xC3) + 1
    value = data[second]
    low[second[(value <= 0x9E) & (value != 0x97)]] += 32
    kind[second[(value == 0x97) | (value == 0xB7)]] = _HARD  # the signs of multiplication and division
    less = np.flatnonzero(data[:-1] == 60)
    kind[less[data[less + 1] == 124]] = _HARD  # special strings begin with <|
    inside = kind != _SPACE
    row = offsets[:-1][offsets[:-1] < n]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[row] = inside[row]
    last[:-1] &= ~inside[1:] | first[1:]
    cut = first.copy()
    cut[1:] |= inside[1:] & (kind[1:] != kind[:-1])
    cut |= kind == _DIGIT
    hard = np.flatnonzero(kind == _HARD)
    if len(hard):
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        whole = np.unique(np.searchsorted(begin, hard, side="right") - 1)
        run, place = shared.spread(end[whole] - begin[whole])
        at = begin[whole][run] + place
        low[at], cut[at] = data[at], False
        cut[begin[whole]] = True
    start = np.flatnonzero(cut)
    kept = low[inside]
    ends = np.append(start - np.searchsorted(np.flatnonzero(~inside), start), len(kept))
    parts = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(kept))
    return parts, np.searchsorted(start, offsets)


class Numbers(dict):
    """Numbers of parts from 0 on, given when first asked for."""

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        return n


class ChunkTokenizer:
    """Ids of texts, made from the ids of the parts of their chunks between spaces and line breaks, which are remembered.

    It fits tokenizers whose file states the normalizer and pre-tokenizer above: they never look across white space and
    drop it. pieces() cuts plain chunks as they do; parts of printable Latin-1 go straight to the model, all others take
    the whole tokenizer. With another file whole texts go to the tokenizer, and nothing is remembered.
    """

    def __init__(self, path: str, most: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        self.by_chunk = (stated["normalizer"], stated["pre_tokenizer"], stated["post_processor"]) == (NORMALIZER, PRE_TOKENIZER, None)
        self.model, self.split, self.shown = self.tokenizer.model, regex.compile(PRE_TOKENS), byte_characters()
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def chunk_ids(self, chunk: str) -> list[int]:
        if not chunk.isascii() and max(chunk) > "\xff" or "<|" in chunk or not chunk.isprintable():
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        pre = [chunk.lower()] if chunk.isalpha() else self.split.findall(chunk.lower())
        if not chunk.isascii():
            pre = [x.translate(self.shown) for x in pre]
        return [t.id for x in pre for t in self.model.tokenize(x)]

    def _learn(self, new: list[str], at: int) -> None:
        each = [self.chunk_ids(x) for x in new]
        ids, lengths = np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while at + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[at : at + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[at : at + len(lengths)] = lengths
        self.used += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text (null is empty). Each distinct part is looked up once."""
        if not self.by_chunk:
            each = [x.ids for x in self.tokenizer.encode_batch([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))
        if len(self.number) > self.most:
            self.clear()
        number, known = self.number, len(self.number)
        parts, offsets = pieces(*shared.utf8(texts))
        words = parts.dictionary_encode()
        own = np.fromiter(map(number.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(words.dictionary))
        flat = own[words.indices.to_numpy()]
        if len(number) > known:
            self._learn(list(islice(reversed(number), len(number) - known))[::-1], known)
        lengths = self.length[flat]
        run, place = shared.spread(lengths)
        ids = self.ids[self.start[flat][run] + place]
        return ids, shared.segment_sums(lengths, offsets)


class Packer:
    """Packs pieces (key, start, tokens, loss tokens); place(key, start, length, sequence, offset) hears of each.

    What may not be cut and is larger than a sequence has none: its sequence and offset are None.
    """

    def __init__(self, place: Callable[[object, int, int, int | None, int | None], None], tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int | None = None, cut: bool = True, pool: int = POOL, first: int = 0):
        self.place, self.cut, self.pool, self.sequence = place, cut, pool, first
        self.limit = np.array([tokens, segments, tokens if loss is None else loss], np.float64)
        self.need = np.zeros((pool + 1, 3))
        self.what: list[tuple[object, int]] = []

    def add(self, key: object, tokens: int, loss: int | None = None) -> None:
        most, start = int(min(self.limit[0], self.limit[2])) if self.cut else 0, 0
        if self.cut and loss is None:
            while tokens - start >= most:
                self.place(key, start, most, self.sequence, 0)
                self.sequence += 1
                start += most
        if tokens - start or not tokens:
            self._wait(key, start, tokens - start, tokens - start if loss is None else loss)

    def _wait(self, key: object, start: int, tokens: int, loss: int) -> None:
        if not self.cut and (tokens > self.limit[0] or loss > self.limit[2]):
            self.place(key, start, tokens, None, None)
            return
        self.need[len(self.what)] = tokens, 1, loss
        self.what.append((key, start))
        if len(self.what) >= self.pool:
            self._fill()

    def _take(self, i: int) -> tuple[object, int, np.ndarray]:
        key, start = self.what.pop(i)
        need = self.need[i].copy()
        self.need[i : len(self.what)] = self.need[i + 1 : len(self.what) + 1]
        return key, start, need

    def _fill(self) -> list[tuple[object, int, int]]:
        """One sequence of pieces of the pool; they are placed unless it is the last one."""
        room, held = self.limit.copy(), []
        while self.what and room[1] and room[0]:
            need = self.need[: len(self.what)]
            score = (need / self.limit) @ (room / self.limit)
            fits = (need <= room).all(axis=1)
            if fits.any():
                key, start, use = self._take(int(np.argmax(np.where(fits, score, -1))))
                held.append((key, start, int(use[0])))
                room -= use
                continue
            size = int(min(room[0], room[2]))
            if not self.cut or not size:
                break
            key, start, use = self._take(int(np.argmax(score)))
            held.append((key, start, size))
            self.need[len(self.what)] = use[0] - size, 1, use[2] - size
            self.what.append((key, start + size))
            room -= size, 1, size
        if self.what or not self.cut:
            self._put(held)
            return []
        return held

    def _put(self, held: list[tuple[object, int, int]]) -> None:
        offset = 0
        for key, start, length in held:
            self.place(key, start, length, self.sequence, offset)
            offset += length
        self.sequence += 1

    def close(self) -> None:
        last: list[tuple[object, int, int]] = []
        while self.what:
            last = self._fill()
        left = sum(x[2] for x in last)
        if left == 0 and last:
            self._put(last)
        while left:  # the last sequence as powers of two, the largest first
            size, part = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                key, start, length = last.pop(0)
                use = min(size, length)
                part.append((key, start, use))
                size -= use
                if use < length:
                    last.insert(0, (key, start + use, length - use))
            self._put(part)


_TOKENIZERS: dict[str, ChunkTokenizer] = {}
_PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _pack(it: Iterator[pa.RecordBatch], path: str, tokens: int, segments: int, end_id: int) -> Iterator[pa.RecordBatch]:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    encoder = _TOKENIZERS[path]
    ids: dict[int, tuple[object, np.ndarray, int]] = {}  # by row: its id, its ids, and how many are not placed yet
    rows: list[tuple] = []

    def place(row: int, start: int, length: int, sequence: int, offset: int) -> None:
        doc, own, left = ids[row]
        rows.append((doc, start, length, zlib.crc32(own[start : start + length].tobytes()), len(own), sequence, offset))
        if left == length:
            del ids[row]
        else:
            ids[row] = doc, own, left - length

    names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(x, pa.int64()) for x in columns[1:])], names=names)

    packer = Packer(place, tokens, segments, first=TaskContext.get().partitionId() << 32)
    row, kind = 0, None
    for batch in it:
        kind = batch.column(0).type
        for i, j in shared.chunks(shared.utf8(batch.column(1))[1], SPLIT_BYTES):
            part = batch.slice(i, j - i)
            flat, counts = encoder.encode(part.column(1))
            flat = flat.astype("<u4")
            for doc, own in zip(part.column(0).to_pylist(), np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                own = np.append(own, np.uint32(end_id)).astype("<u4")
                ids[row] = doc, own, len(own)
                packer.add(row, len(own))
                row += 1
            if rows:
                yield out()
    encoder.clear()  # the worker may go on to other work
    packer.close()
    if rows:
        yield out()


def pack_documents(documents: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id bears loss, so that limit is the token limit. tokenizer is the path of a file for the tokenizers library,
    the same on all executors.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    source = documents.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("words"))
    packed = source.mapInArrow(partial(_pack, path=tokenizer, tokens=tokens, segments=segments, end_id=end_id), f"doc {kind}, {_PIECES}")
    return packed.withColumnRenamed("doc", doc_id)


def _pack_examples(it: Iterator[pa.RecordBatch], tokens: int, segments: int, loss: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held: dict[int, tuple[object, int]] = {}
    kind, row = None, 0

    def place(key: int, start: int, length: int, sequence: int | None, offset: int | None) -> None:
        example, bearing = held.pop(key)
        rows.append((example, length, bearing, sequence, offset))

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(x, pa.int64()) for x in columns[1:])], names=["example", "length", "loss_length", "sequence_id", "offset"])

    packer = Packer(place, tokens, segments, loss, cut=False, first=TaskContext.get().partitionId() << 32)
    for batch in it:
        kind = batch.column(0).type
        for key, n, m in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            held[row] = key, m
            packer.add(row, n, m)
            row += 1
        if rows:
            yield out()
    packer.close()
    if rows:
        yield out()


def pack_examples(examples: DataFrame, *, example_id: str, tokens: str, loss_tokens: str, max_tokens: int = MAX_TOKENS, max_segments: int = 64, max_loss: int = 1024) -> DataFrame:
    """Whole examples of instruction data in sequences under all three limits: id, length, loss_length, sequence_id, offset."""
    kind = examples.schema[example_id].dataType.simpleString()
    count = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0))
    source = examples.select(F.col(example_id).alias("example"), count(tokens).alias("n"), count(loss_tokens).alias("m"))
    packed = source.mapInArrow(partial(_pack_examples, tokens=max_tokens, segments=max_segments, loss=max_loss), f"example {kind}, length bigint, loss_length bigint, sequence_id bigint, offset bigint")
    return packed.withColumnRenamed("example", example_id)


def _count_tokens(it: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    encoder = _TOKENIZERS[path]
    for batch in it:
        for i, j in shared.chunks(shared.utf8(batch.column(1))[1], SPLIT_BYTES):
            part = batch.slice(i, j - i)
            _, counts = encoder.encode(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["key", "n"])
    encoder.clear()


def exchanges(conversations: DataFrame, tokenizer: str, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = "assistant") -> DataFrame:
    """Turns 2k and 2k + 1 of a conversation as an example: exchange (a struct of conv_id and k), tokens and loss_tokens.

    A turn has the ids of its text and an end id; those of the learned role bear loss. Counts alone are shuffled, summed
    in part first. A null turn or conversation is one of its own; rows that repeat a turn are all part of its exchange.
    """
    key = F.struct(F.col(conv_id).alias("conv_id"), F.floor(F.col(turn) / 2).cast("bigint").alias("k"), (F.col(role) == learned).alias("bears"))
    source = conversations.select(key.alias("key"), F.col(text).cast("string").alias("words"))
    kind = f"key {source.schema['key'].dataType.simpleString()}, n bigint"
    counted = source.mapInArrow(partial(_count_tokens, path=tokenizer), kind).select(F.struct("key.conv_id", "key.k").alias("exchange"), "key.bears", (F.col("n") + 1).alias("n"))
    return counted.groupBy("exchange").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("bears"), F.col("n")).otherwise(F.lit(0))).alias("loss_tokens"))


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(documents, public_tokenizers.path("word_bpe_49k.json"))


def pack_conversations(spark, sf_dir: str) -> DataFrame:
    """Whole exchanges of conversations under limits of 2048 tokens, 16 exchanges and 1024 tokens with loss."""
    import public_tokenizers

    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    known = exchanges(conversations, public_tokenizers.path("word_bpe_49k.json"))
    packed = pack_examples(known, example_id="exchange", tokens="tokens", loss_tokens="loss_tokens", max_segments=16)
    return packed.select("exchange.conv_id", F.col("exchange.k").alias("exchange"), "length", "loss_length", "sequence_id", "offset")
