"""What all readers make: nodes, edges, observations and problems."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical, documents

Part = DataFrame | Callable[[], DataFrame]


class Mapped:
    """nodes, edges and observations as the operators take them; problems: path, message. Fit if it has no problems.

    A part that is given as a function is made when it is first asked for.
    """

    def __init__(self, nodes: Part, edges: Part, observations: Part, problems: Part):
        self._parts = {"nodes": nodes, "edges": edges, "observations": observations, "problems": problems}

    def _made(self, name: str) -> DataFrame:
        part = self._parts[name]
        return part if isinstance(part, DataFrame) else part()

    nodes = cached_property(lambda self: self._made("nodes"))
    edges = cached_property(lambda self: self._made("edges"))
    observations = cached_property(lambda self: self._made("observations"))
    problems = cached_property(lambda self: self._made("problems"))


class MappingError(ValueError):
    """A document that cannot be mapped."""


def checked(mapped: Mapped) -> Mapped:
    """mapped, if it has no problems; else an error that names the first of them."""
    found = mapped.problems.orderBy("path", "message").take(5)
    if found:
        raise MappingError("; ".join(f"{r['path']}: {r['message']}" for r in found))
    return mapped


NODE_COLUMNS = ["node_key", "namespace", "kind", "logical_id", "parent_key", "ancestor_keys", "name", "description", "attributes_json", "provenance"]
EDGE_COLUMNS = ["src_key", "kind", "dst_key", "attributes_json", "provenance"]
NO_PROVENANCE = "array<struct<provider_type:string,source_ref:string,source_version:string,observation_mode:string>>"


def whole_texts(spark: SparkSession, path: str, *suffixes: str) -> DataFrame:
    """path and text of documents, one row for each file; another suffix than these is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    bad = ~F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    return rows.withColumn("text", F.when(bad, F.raise_error(F.concat(F.lit("unsupported file: "), "path"))).otherwise(F.col("text")))


def provenance(provider: str, ref: Column, version: Column, mode: str = "declared") -> Column:
    return F.array(F.struct(F.lit(provider).alias("provider_type"), ref.alias("source_ref"), version.alias("source_version"), F.lit(mode).alias("observation_mode")))


def none_stated() -> Column:
    return F.array().cast(NO_PROVENANCE)


def json_text(c: Column) -> Column:
    """A string column as canonical JSON text."""
    return canonical.escaped(c)


def key_of(namespace: Column, kind: Column, logical_id: Column, parent: Column | None = None) -> Column:
    """The key of a node whose id may be any text."""
    own = F.concat_ws(",", json_text(namespace), json_text(kind), json_text(logical_id))
    return F.concat(F.lit("["), own, F.lit(","), parent if parent is not None else F.lit("null"), F.lit("]"))


def contains(nodes: DataFrame, provenance_column: Column | None = None) -> DataFrame:
    """A contains edge from each node's parent to it."""
    p = none_stated() if provenance_column is None else provenance_column
    return nodes.filter("parent_key IS NOT NULL").select(F.col("parent_key").alias("src_key"), F.lit("contains").alias("kind"), F.col("node_key").alias("dst_key"), F.lit("{}").alias("attributes_json"), p.alias("provenance"))


def finished(nodes: DataFrame) -> DataFrame:
    """Nodes with a map of attributes in the columns that all nodes have."""
    return nodes.withColumn("attributes_json", documents.object_text(F.col("attributes"))).select(*NODE_COLUMNS)


def observe(nodes: DataFrame) -> DataFrame:
    """Observations of nodes (with a map of attributes) that have provenance: /name, /description if there is one, and
    each attribute."""
    first = F.array(F.struct(F.lit("/name").alias("pointer"), json_text(F.col("name")).alias("value_json")), F.struct(F.lit("/description").alias("pointer"), F.when(F.col("description").isNotNull(), json_text(F.col("description"))).alias("value_json")))
    attributes = F.transform(F.map_entries("attributes"), lambda e: F.struct(F.concat(F.lit("/attributes/"), canonical.escape_token(e["key"])).alias("pointer"), e["value"].alias("value_json")))
    every = F.filter(F.concat(first, attributes), lambda x: x["value_json"].isNotNull())
    rows = nodes.filter(F.size("provenance") > 0).select(F.col("node_key").alias("object_key"), "namespace", "kind", F.explode(every).alias("x"), "provenance")
    return rows.select("object_key", "namespace", "kind", "x.pointer", "x.value_json", "provenance")


def containers(places: DataFrame, namespace: str) -> DataFrame:
    """The data source and dataset nodes of rows with database and schema, each once and without provenance."""
    ns, none = F.lit(namespace), F.lit(None).cast("string")
    source = key_of(ns, F.lit("data_source"), F.col("database"))
    level = lambda key, kind, name, parent, up: [key.alias("node_key"), ns.alias("namespace"), F.lit(kind).alias("kind"), F.col(name).alias("logical_id"), parent.alias("parent_key"), up.alias("ancestor_keys"), F.col(name).alias("name"), none.alias("description"), F.lit("{}").alias("attributes_json"), none_stated().alias("provenance")]
    sources = places.select("database").distinct().select(*level(source, "data_source", "database", none, F.array().cast("array<string>")))
    schemas = places.select("database", "schema").distinct().withColumn("up", source)
    return sources.unionByName(schemas.select(*level(key_of(ns, F.lit("dataset"), F.col("schema"), F.col("up")), "dataset", "schema", F.col("up"), F.array("up"))))


def with_table_key(rows: DataFrame, namespace: str, name: str = "logical_id") -> DataFrame:
    """Rows with database, schema and a table's name, with the table's node_key, parent_key and ancestor_keys."""
    ns = F.lit(namespace)
    rows = rows.withColumn("__source", key_of(ns, F.lit("data_source"), F.col("database"))).withColumn("parent_key", key_of(ns, F.lit("dataset"), F.col("schema"), F.col("__source")))
    return rows.withColumn("node_key", key_of(ns, F.lit("table"), F.col(name), F.col("parent_key"))).withColumn("ancestor_keys", F.array("parent_key", "__source")).drop("__source")
