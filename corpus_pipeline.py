"""A training-data pipeline over documents, from texts to packed sequences of token ids.

Each stage takes all that the one before it kept and is written as Parquet, which the next one reads. All stages but
the last return the columns of documents.

In every stage: rows with a null id are documents of their own; rows that repeat an id are one document for line dedup
and stand for themselves elsewhere; very long texts are taken whole; an empty table gives an empty one; columns beside
those of documents stay as they are, whatever their names. Where a stage treats nulls, ties or repeats in a way of its
own, its docstring says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm import decontam, langid, line_dedup, ngram_join, packing, shared


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language (no letter in their text, so also null and empty ones) go; ties go to
    the language that sorts first."""
    return langid.with_language(docs, langid.train(docs.filter(~langid.held_out())))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: texts lose the lines that a later document repeats; n_chars follows. A null text stays null; a line of a
    row without an id never stays before one of a row with an id."""
    done = line_dedup.drop_repeated_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicate join: the document of each class with the least id stays. Texts without words are one class where
    their bytes are equal; rows without an id stay."""
    return ngram_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go, the others stay as they are. A null text has no words and
    stays; each row is judged by its own text."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of the documents in sequences of token ids. A null or empty text is its end id alone; repeated rows
    are packed each."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pack", pack)]

#: A trained model, MinHash and token ids are not SQL; tests/llm holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared.stored(docs, f"pipeline-{name}")
    return docs
