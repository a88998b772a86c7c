"""Histories in a folder: entries name their tables by content identity, and each entry's link covers those before it.

snapshot, observations and rules are Parquet in a folder for each entry; index has a row for each table of each entry (its
number of rows and digest), with the entry's context and link. All entries are verified in one aggregation for each
table, not one after the other.

Appending states which link it follows and claims the place after it, by making a file that only one writer can make. Of
two that follow the same link one wins; the other is told, before its index is written, and its tables count for nothing.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..shared import stored
from . import artifacts

#: The tables of an entry, the kind of identity of each, and their columns.
KINDS = {"snapshot": "snapshot", "observations": "property_observations", "rules": "authority"}
SCHEMAS = {
    "snapshot": "object_key string, pointer string, value_json string, entry_index bigint",
    "observations": "object_key string, namespace string, kind string, pointer string, value_json string, provenance array<struct<provider_type:string,source_ref:string,source_version:string,observation_mode:string>>, entry_index bigint",
    "rules": "kind string, pointer string, namespace string, provider_type string, source_ref string, entry_index bigint",
}
INDEX = "entry_index bigint, context string, table string, n_rows bigint, digest string, follows string, link string"
#: Which tables an entry has, by its context.
TABLES = {"none": ("snapshot",), "provenance": ("snapshot", "observations"), "full": ("snapshot", "observations", "rules")}


class HistoryError(ValueError):
    """A history that is not what its index says."""


class History(NamedTuple):
    entries: DataFrame
    snapshot: DataFrame
    observations: DataFrame
    rules: DataFrame


def _link(before: Column, tables: Column) -> Column:
    """The link of an entry: the digest of the one before and of its tables (an array of table and digest)."""
    own = F.transform(F.array_sort(tables), lambda t: F.concat_ws("=", t["table"], t["digest"]))
    return canonical.digest("history_entry_state", F.concat(F.coalesce(before, F.lit("")), F.lit("|"), F.array_join(own, "|")))


def _linked(states: DataFrame, first: str | None) -> DataFrame:
    """Entries (entry_index, context, tables) with follows and link. Entries are few, as each is a snapshot: their links
    are made in one row, which holds a digest for each table of each entry and nothing of the tables."""
    one = states.agg(F.array_sort(F.collect_list(F.struct("entry_index", "context", "tables"))).alias("all"))
    start = F.array(F.struct(F.lit(None).cast("bigint").alias("entry_index"), F.lit(None).cast("string").alias("context"), F.array().cast("array<struct<table:string,n_rows:bigint,digest:string>>").alias("tables"), F.lit(None).cast("string").alias("follows"), F.lit(first).cast("string").alias("link")))
    add = lambda done, x: F.concat(done, F.array(F.struct(x["entry_index"].alias("entry_index"), x["context"].alias("context"), x["tables"].alias("tables"), F.element_at(done, -1)["link"].alias("follows"), _link(F.element_at(done, -1)["link"], x["tables"]).alias("link"))))
    return one.select(F.explode(F.aggregate("all", start, add)).alias("x")).select("x.*").filter("entry_index IS NOT NULL")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with entry, the folder that a row lies in, beside the entry_index that it states."""
    return spark.read.schema(f"{SCHEMAS[name]}, entry bigint").parquet(f"{folder}/{name}")


def _identities(spark: SparkSession, folder: str, indexes: DataFrame | None = None) -> DataFrame:
    """entry_index, table, n_rows, digest of what is there."""
    found = []
    for name, kind in KINDS.items():
        rows = _table(spark, folder, name)
        if indexes is not None:
            rows = rows.join(F.broadcast(indexes.select(F.col("entry_index").alias("entry"))), "entry", "left_semi")
        found.append(artifacts.identity(rows, kind, "entry").select(F.col("entry").alias("entry_index"), F.lit(name).alias("table"), "n_rows", "digest"))
    return reduce(DataFrame.unionByName, found)


def last_link(spark: SparkSession, folder: str) -> str | None:
    """The link that the next entry follows."""
    row = spark.read.schema(INDEX).parquet(f"{folder}/index").agg(F.max_by("link", "entry_index").alias("link")).first()
    return row["link"]


def _claim(spark: SparkSession, folder: str, follows: str | None) -> str:
    """Makes the file that stands for the place after a link; an error if another writer has made it. A folder's file
    system decides: making a file that must not be there yet is one step on HDFS and local disks. A store that has no
    such step (some object stores) lets two in; problems() then reports the fork."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/claims/{follows or 'first'}")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where.getParent())
    try:
        files.create(where, False).close()
    except Py4JJavaError as e:
        if files.exists(where):
            raise HistoryError("another entry has been added since") from None
        raise HistoryError(f"the place after {follows or 'the start'} cannot be claimed") from e
    return where.toString()


def release(spark: SparkSession, folder: str, follows: str | None) -> None:
    """Gives back the place after a link that a writer claimed and died before it wrote its index. An error if there is
    an entry at that place."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/index")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(where) and not spark.read.schema(INDEX).parquet(f"{folder}/index").filter(F.col("follows").eqNullSafe(F.lit(follows))).isEmpty():
        raise HistoryError("there is an entry at that place")
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/claims/{follows or 'first'}"), False)


def append(folder: str, entries: DataFrame, tables: dict[str, DataFrame], *, follows: str | None = None) -> None:
    """Adds entries (entry_index, context) with their tables (each with entry_index) after the entry of that link (None:
    a new history). The index comes last, so tables without an index are no entries. A table that the context of an
    entry does not allow, or a link that another entry follows already, is an error.

    The claim comes after all tables are there and just before the index, so a writer that dies holds it only if it dies
    between two small files; release() gives such a place back."""
    spark = entries.sparkSession
    entries = entries.select(F.col("entry_index").cast("bigint").alias("entry_index"), "context")
    if follows is not None and last_link(spark, folder) != follows:
        raise HistoryError("another entry has been added since")
    contexts = {r["context"] for r in entries.select("context").distinct().take(len(TABLES) + 1)}
    if not contexts <= set(TABLES):
        raise HistoryError(f"unknown context: {sorted(map(str, contexts - set(TABLES)))}")
    for name in KINDS:
        allowed = entries.filter(F.col("context").isin(*(c for c, names in TABLES.items() if name in names))).select("entry_index")
        none = spark.createDataFrame([], SCHEMAS[name])
        rows = (tables[name] if name in tables else none).withColumn("entry_index", F.col("entry_index").cast("bigint"))
        if name in tables and rows.select("entry_index").distinct().join(allowed, "entry_index", "left_anti").take(1):
            raise HistoryError(f"{name} of an entry whose context has none")
        # Partitions of entries that are added anew, by an attempt that failed before its index, are written over.
        # Rebalanced, an entry has few files, and a large one is still written by several tasks.
        rows.select(*none.columns, F.col("entry_index").alias("entry")).hint("rebalance", "entry").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("entry").parquet(f"{folder}/{name}")
    told = F.explode(F.array(*(F.struct(F.lit(c).alias("context"), F.lit(name).alias("table")) for c, names in TABLES.items() for name in names)))
    due = entries.join(F.broadcast(spark.range(1).select(told.alias("x")).select("x.*")), "context")
    known = due.join(_identities(spark, folder, entries.select("entry_index")), ["entry_index", "table"], "left")
    empty = {name: artifacts.identity(spark.createDataFrame([], SCHEMAS[name]), kind).first()["digest"] for name, kind in KINDS.items()}
    nothing = F.create_map(*(F.lit(x) for pair in empty.items() for x in pair))
    known = known.select("entry_index", "context", F.struct("table", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("digest", nothing[F.col("table")]).alias("digest")).alias("t"))
    states = known.groupBy("entry_index", "context").agg(F.collect_list("t").alias("tables"))
    index = stored(_linked(states, follows), "history-index")
    _claim(spark, folder, follows)
    index.select("entry_index", "context", F.explode("tables").alias("t"), "follows", "link").select("entry_index", "context", "t.*", "follows", "link").coalesce(1).write.mode("append").parquet(f"{folder}/index")


def problems(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with a history: entry_index, table (null: the entry itself), problem."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    there = _identities(spark, folder).withColumnRenamed("n_rows", "own_rows").withColumnRenamed("digest", "own_digest")
    both = index.select("entry_index", "table", "n_rows", "digest").join(there, ["entry_index", "table"], "full")
    why = F.when(F.col("digest").isNull(), "rows of no entry").when(F.col("own_digest").isNull() & (F.col("n_rows") > 0), "rows are missing").when(F.col("own_digest").isNotNull() & (F.col("digest") != F.col("own_digest")), "content differs from its identity")
    content = both.select("entry_index", "table", why.alias("problem"))
    one = index.groupBy("entry_index", "context", "follows", "link").agg(F.collect_list(F.struct("table", "digest")).alias("tables"))
    told = lambda df, problem: df.select("entry_index", F.lit(None).cast("string").alias("table"), F.lit(problem).alias("problem"))
    broken = told(one.filter(_link(F.col("follows"), F.col("tables")) != F.col("link")), "its link is not that of its tables")
    before = one.select(F.col("link").alias("follows"), F.col("entry_index").alias("before"))
    loose = told(one.filter("follows IS NOT NULL").join(before, "follows", "left").filter("before IS NULL OR before >= entry_index"), "it follows no entry")
    forks = told(one.groupBy("follows").agg(F.count(F.lit(1)).alias("n"), F.max("entry_index").alias("entry_index")).filter("n > 1"), "two entries follow the same one")
    return content.filter("problem IS NOT NULL").unionByName(broken).unionByName(loose).unionByName(forks)


def read(spark: SparkSession, folder: str) -> History:
    """A history whose every entry is what the index says; anything else is an error that names the first problems."""
    found = problems(spark, folder).orderBy("entry_index", "table").take(5)
    if found:
        raise HistoryError("; ".join(f"entry {r['entry_index']} {r['table'] or ''}: {r['problem']}" for r in found))
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    entries = index.select("entry_index", "context", "follows", "link").distinct()
    return History(entries, *(_table(spark, folder, name).drop("entry") for name in KINDS))
