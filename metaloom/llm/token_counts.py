"""Token counts of byte-level byte-pair vocabularies, by merging with a heap over a linked list.

A text is cut at the special strings of the vocabulary file (each is one token) and then into chunks by the file's rule.
The bytes of a chunk are the symbols of a linked list. A heap holds the adjacent pairs that may merge; the pair of lowest
rank, the leftmost of equal ones, is popped and merged, its new neighbours are pushed, and pairs whose symbols are gone
are passed over. A chunk has as many tokens as it has bytes less merges; no identifier is made. Tasks remember the counts
of distinct short chunks, as many as a fixed number.

A null text is empty; an empty text has no bytes and no tokens. A very long text is looked at whole, in time of n log n
for a chunk of n bytes. Repeated rows are counted each; there are no ties but those of equal ranks, above. An empty table
has an empty result; other columns change nothing.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import partial
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from . import shared

#: Tokens beyond which a document is over the limit.
LIMIT = 1024
#: Chunks whose counts a task remembers, and the longest of them in characters.
CACHE, LONGEST = 400_000, 64
#: How byte-level vocabularies cut a text into chunks (fixed value).
CHUNKS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class MergeCounter(dict):
    """Tokens of each chunk, made when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        model = stated["model"]
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False}
        if model["type"] != "BPE" or stated["normalizer"] is not None or stated["pre_tokenizer"] != PRE_TOKENIZER or any(model.get(k) != v for k, v in plain.items()):
            raise ValueError(f"{path} is not a byte-level vocabulary of byte-pair merges")
        shown = byte_names()
        # Symbols are numbers: a byte is itself, the others are told apart by the bytes that they stand for.
        names = {bytes([b]): b for b in range(256)}
        self.ranks: list[dict[int, int]] = [{} for _ in range(256)]
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = (bytes(shown[c] for c in part) for part in (pair if isinstance(pair, list) else pair.split(" ")))
            self.made.append(names.setdefault(left + right, len(names)))
            if len(names) > len(self.ranks):
                self.ranks.append({})
            self.ranks[names[left]][names[right]] = rank
        self.settled: set[str] = set()
        marks = [x["content"] for x in stated["added_tokens"]]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in stated["added_tokens"]):
            raise ValueError(f"{path} has special strings that take white space or whole words")
        self.special = regex.compile("|".join(map(regex.escape, sorted(marks, key=len, reverse=True)))) if marks else None
        self.chunks = regex.compile(CHUNKS)
        self.cutter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def merged(self, symbols: bytes) -> int:
        """Tokens that these bytes become."""
        n, ranks, made = len(symbols), self.ranks, self.made
        # An entry is rank * n + place of the left symbol: the rank tells the pair, so a stale entry tells itself.
        heap = [r * n + i for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks[a].get(b)) is not None]
        if not heap:
            return n
        heapify(heap)
        name, after, before, left = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            entry = heappop(heap)
            rank = entry // n
            i = entry - rank * n
            j = after[i]
            if j >= n or name[i] < 0 or ranks[name[i]].get(name[j]) != rank:
                continue  # one of the two has merged since
            new = name[i] = made[rank]
            name[j] = -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := ranks[new].get(name[k])) is not None:
                    heappush(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := ranks[name[h]].get(new)) is not None:
                heappush(heap, r * n + h)
        return left

    def __missing__(self, chunk: str) -> int:
        n = self.merged(chunk.encode())
        if len(chunk) <= LONGEST:
            self[chunk] = n
        return n

    def assigned(self, text: str) -> bool:
        """Whether Python's tables know all characters: whether others are letters depends on the Unicode version."""
        new = set(text) - self.settled
        self.settled.update(c for c in new if unicodedata.category(c) != "Cn")
        return new <= self.settled

    def count(self, text: str) -> int:
        """Tokens of a text, its special strings among them."""
        total, parts = 0, [text]
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            if part.isascii() or self.assigned(part):
                chunks = self.chunks.findall(part)
            else:  # the library's own tables cut it
                chunks = [part[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(part)]
            total += sum(map(self.__getitem__, chunks))
        if len(self) > CACHE:
            self.clear()
        return total


def byte_names() -> dict[str, int]:
    """The byte that each character of the file stands for: printable Latin-1 ones themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


_COUNTERS: dict[str, MergeCounter] = {}


def _count(it: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    counter = _COUNTERS[path]
    for batch in it:
        for i, j in shared.chunks(shared.utf8(batch.column("words"))[1], 1 << 20):
            part = batch.slice(i, j - i)
            n = [counter.count(x) if x else 0 for x in part.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("n_bytes"), pa.array(n, pa.int64())], names=["doc", "n_bytes", "n_tokens"])


def count_tokens(documents: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for each row.

    vocabulary is the path of a byte-level file for the tokenizers library, the same on all executors.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = documents.select(F.col(doc_id).alias("doc"), F.octet_length(words).cast("bigint").alias("n_bytes"), words.alias("words"))
    counted = source.mapInArrow(partial(_count, path=vocabulary), f"doc {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("doc").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(documents, public_tokenizers.path("byte_bpe_50k.json"))
