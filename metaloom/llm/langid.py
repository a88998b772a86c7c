"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the n-grams of one to three characters of a text in lower case, in which every run of other characters
than letters is one space. Counts of languages by feature are summed by Spark; the matrix of log probabilities has a
fixed number of features and is broadcast; texts are scored in batches as sparse rows of it.

Nulls: a text that is null or has no letter is "und" with score 0. Rows without a language or text teach nothing; with
no labelled row at all every text is "und". Ties go to the language that sorts first. Rows that repeat an id are rows of
their own; an empty table has an empty result. A very long text is scored whole; other columns change nothing. The matrix takes a quarter of a megabyte for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

FEATURES, SIZES = 1 << 16, (1, 2, 3)
#: About so many labelled rows, chosen by a hash of their id, teach the model.
TRAIN_ROWS = 50_000
SMOOTHING = 0.5
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and its lower case (itself if that is not one character)."""
    if not _LETTERS:
        every = [chr(i) for i in range(0x110000)]
        _LETTERS.append(np.array([c.isalpha() for c in every]))
        _LETTERS.append(np.array([ord(low) if len(low := c.lower()) == 1 else i for i, c in enumerate(every)], np.uint32))
    return _LETTERS[0], _LETTERS[1]


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each row in a run, where each row's start, and which rows have a letter."""
    letter, lower = _tables()
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    is_letter = letter[code]
    first = np.zeros(len(code) + 1, bool)
    first[starts] = True
    # Of characters other than letters, the first after a letter of the same row stays, as a space.
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] & ~first[1 : len(code)]
    kept = np.concatenate([[0], np.cumsum(keep)])
    at = kept[starts]
    row, _ = shared.spread(np.diff(at))
    c = np.where(is_letter, lower[code], 32)[keep].astype(np.uint64)
    parts, owners = [], []
    for n in SIZES:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + c[k : len(c) - n + 1 + k]
        own = row[: len(c) - n + 1] == row[n - 1 :]
        if n == 1:
            own &= c != 32
        parts.append((shared.mix(h)[own] >> np.uint64(64 - 16)).astype(np.int64))
        owners.append(row[: len(c) - n + 1][own])
    docs = len(offsets) - 1
    if not parts:
        return np.zeros(0, np.int64), np.zeros(docs + 1, np.int64), np.zeros(docs, bool)
    owner = np.concatenate(owners)
    by = np.argsort(owner, kind="stable")
    has = shared.segment_sums(is_letter.astype(np.int64), starts) > 0
    return np.concatenate(parts)[by], np.searchsorted(owner[by], np.arange(docs + 1)), has


class Model(NamedTuple):
    languages: list[str]
    #: Log probabilities, a row for each feature and a column for each language, and of the languages themselves.
    weights: np.ndarray
    prior: np.ndarray


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch, data, offsets in shared.batches(it, "words"):
        features, at, _ = ngrams(data, offsets)
        row, _ = shared.spread(np.diff(at))
        name = np.array(batch.column("lang").to_pylist(), object)
        for lang in set(name):
            on = name == lang
            rows[lang] = rows.get(lang, 0) + int(on.sum())
            total[lang] = total.get(lang, 0) + np.bincount(features[on[row]], minlength=FEATURES)
    for lang, counts in total.items():
        seen = np.flatnonzero(counts)
        feature = np.append(seen, -1)  # -1: the rows themselves
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(feature)), pa.array(feature, pa.int32()), pa.array(np.append(counts[seen], rows[lang]), pa.int64())], names=["lang", "feature", "n"])


def train(labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """The model of labelled texts. Of more than so many rows, a share chosen by a hash of doc_id is read."""
    known = labelled.select(F.col(doc_id).alias("doc"), F.col(text).alias("words"), F.col(lang).cast("string").alias("lang")).filter("lang IS NOT NULL AND words IS NOT NULL")
    share = rows / max(known.count(), 1)
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64(F.lit("langid"), F.col("doc").cast("string")), F.lit(1_000_000)) < int(share * 1_000_000))
    counts = known.select("words", "lang").mapInArrow(_count, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    place = {name: i for i, name in enumerate(names)}
    column = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
    feature, n = table.column("feature").to_numpy(), table.column("n").to_numpy().astype(np.float64)
    prior, weights = np.zeros(len(names)), np.full((FEATURES, len(names)), SMOOTHING)
    prior[column[feature < 0]] = n[feature < 0]
    weights[feature[feature >= 0], column[feature >= 0]] += n[feature >= 0]
    return Model(names, np.log(weights / weights.sum(axis=0)).astype(np.float32), np.log(prior / max(prior.sum(), 1)))


def score_batch(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    features, at, has = ngrams(data, offsets)
    if not model.languages:
        return [UNKNOWN] * (len(offsets) - 1), np.zeros(len(offsets) - 1)
    log = np.stack([shared.segment_sums(model.weights[features, k].astype(np.float64), at) for k in range(len(model.languages))], axis=1) + model.prior
    best = log.argmax(axis=1)
    share = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, share, 0.0)


def _predict(it: Iterator[pa.RecordBatch], handle) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in shared.batches(it, "words"):
        name, score = score_batch(handle.value, data, offsets)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(name, pa.string()), pa.array(score, pa.float64())], names=["doc", "lang_pred", "score"])


def predict(documents: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the posterior of that language) of whole texts."""
    handle = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[doc_id].dataType.simpleString()
    source = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("words"))
    return source.mapInArrow(partial(_predict, handle=handle), f"doc {kind}, lang_pred string, score double").withColumnRenamed("doc", doc_id)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text leaves 1 modulo 3."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def _name(it: Iterator[pa.RecordBatch], handle, text: int, lang: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        data, offsets = shared.utf8(batch.column(text))
        names = [x for i, j in shared.chunks(offsets) for x in score_batch(handle.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0]]
        names = pa.array(names, batch.column(lang).type)
        yield batch.set_column(lang, batch.schema.field(lang), names).filter(pc.not_equal(names, UNKNOWN))


def with_language(documents: DataFrame, model: Model, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose text has a language, with the predicted one in lang; those predicted as "und" go. What lang was
    before is no input."""
    handle = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index
    return documents.mapInArrow(partial(_name, handle=handle, text=at(text), lang=at(lang)), documents.schema)


def op3(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(documents.filter(~held_out()))
    found = predict(documents, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
