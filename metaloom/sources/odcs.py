"""Data contracts: the contract governs datasets, which contain columns, nested as deep as the contract nests them."""

from __future__ import annotations

import json
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.canonical import dumps
from ..functions.documents import Rule, ancestor, filled, flatten, get, pairs, sorted_array, sorted_texts, text
from ..shared import stored
from .base import EDGE_COLUMNS, NODE_COLUMNS, Mapped, contains, finished, key_of, observe, provenance, whole_texts


@F.pandas_udf(StringType())
def yaml_to_json(document: pd.Series) -> pd.Series:
    """A YAML (or JSON) document as canonical JSON text."""
    try:
        import yaml
    except ImportError:
        yaml = None
    return document.map(lambda x: None if x is None else dumps(yaml.safe_load(x) if yaml else json.loads(x)))


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    return whole_texts(spark, path, ".yaml", ".yml", ".json").withColumn("text", yaml_to_json("text"))


_LISTS = {"customProperties": "custom_properties", "authoritativeDefinitions": "authoritative_definitions", "quality": "quality", "relationships": "relationships", "transformSourceObjects": "transform_source_objects"}
_VALUES = {"physicalName": "physical_name", "physicalType": "physical_type", "logicalType": "logical_type", "businessName": "business_name", "dataGranularityDescription": "data_granularity_description", "primaryKey": "primary_key", "primaryKeyPosition": "primary_key_position", "required": "required", "unique": "unique", "partitioned": "partitioned", "classification": "classification", "encryptedName": "encrypted_name", "criticalDataElement": "critical_data_element", "transformLogic": "transform_logic", "transformDescription": "transform_description"}

#: What a contract holds. Lists in lists (items of items) have no rows of their own: their properties belong to the column.
RULES = {
    "contract": Rule(rows={"schema/*": "dataset"}, open=("description",), lists=("tags", "team", "roles", "customProperties", "authoritativeDefinitions"), folded=("tenant",), keep=("id", "version")),
    "dataset": Rule(rows={"properties/*": "property"}, lists=("tags", *_LISTS), keep=("id", "name")),
    "property": Rule(rows={"properties/*": "property", "items": "items"}, lists=("tags", *_LISTS), keep=("id", "name")),
    "items": Rule(rows={"properties/*": "property", "items": "items"}, silent=True),
}


def _attributes(m: Column, lists: Column) -> Column:
    """Attributes of a dataset or column: plain members under their names here, lists in an order of their own."""
    parts = {to: F.when(get(m, name) != "null", get(m, name)) for name, to in _VALUES.items()}
    parts |= {to: sorted_array(get(lists, name)) for name, to in _LISTS.items()}
    return pairs(**parts, tags=sorted_texts(get(lists, "tags")), logical_type_options=F.when(get(m, "logicalTypeOptions").startswith("{"), get(m, "logicalTypeOptions")), data_type=F.coalesce(get(m, "physicalType"), get(m, "logicalType")))


def _contract_attributes(m: Column, lists: Column) -> Column:
    parts = {to: F.when(get(m, name) != "null", get(m, name)) for name, to in {"version": "version", "status": "status", "domain": "domain", "dataProduct": "data_product"}.items()}
    parts["tenant"] = F.when(filled(get(m, "tenant")).isNotNull(), get(m, "tenant/folded"))
    return pairs(**parts, tags=sorted_texts(get(lists, "tags")), team=F.coalesce(sorted_array(get(lists, "team")), get(m, "team")), roles=sorted_array(get(lists, "roles")), custom_properties=sorted_array(get(lists, "customProperties")), authoritative_definitions=sorted_array(get(lists, "authoritativeDefinitions")))


def _id(m: Column) -> Column:
    return F.coalesce(filled(get(m, "id")), filled(get(m, "name")))


def map_contracts(contracts: DataFrame, namespace: str) -> Mapped:
    """The graph and observations of contracts (column text, JSON). The id of an object is its id, else its name; the
    properties of the items of a list are columns of the list's own column. Each contract is parsed once."""
    ns, none, m, lists = F.lit(namespace), F.lit(None).cast("string"), F.col("m"), F.col("lists")
    parsed = cache(lambda: stored(flatten(contracts, "text", RULES, "contract"), "contracts", "rule"))
    rule = lambda name: parsed().filter(F.col("rule") == name)
    shown = [*(c for c in NODE_COLUMNS if c != "attributes_json"), "attributes"]
    top = {"namespace": ns, "parent_key": none, "ancestor_keys": F.array().cast("array<string>")}
    dataset_key = lambda at: key_of(ns, F.lit("dataset"), _id(at))

    def within(rows: DataFrame, at: Column) -> DataFrame:
        """Rows of contracts that state an id and a version, with those, the contract's key and provenance."""
        rows = rows.withColumns({"id": filled(get(at, "id")), "version": filled(get(at, "version"))}).filter("id IS NOT NULL AND version IS NOT NULL")
        return rows.withColumns({"contract_key": key_of(ns, F.lit("contract"), F.col("id")), "provenance": provenance("odcs", F.col("id"), F.col("version"))})

    def listed() -> DataFrame:
        return within(rule("dataset"), ancestor(0)).withColumns({"name": filled(get(m, "name")), "node_key": dataset_key(m)})

    def columns() -> DataFrame:
        """Columns of named datasets, whose names may be missing, with maps of attributes."""
        rows = within(rule("property"), ancestor(0)).filter(filled(get(ancestor(1), "name")).isNotNull())
        inner = F.slice("up", 3, F.greatest(F.size("up") - 2, F.lit(0)))
        above = F.aggregate(inner, F.array(dataset_key(ancestor(1))), lambda keys, x: F.concat(F.array(key_of(ns, F.lit("column"), F.coalesce(_id(x["m"]), F.lit("")), keys[0])), keys))
        rows = rows.withColumns({"namespace": ns, "kind": F.lit("column"), "name": filled(get(m, "name")), "logical_id": _id(m), "ancestor_keys": above, "description": text(get(m, "description")), "attributes": _attributes(m, lists)})
        rows = rows.withColumn("parent_key", F.col("ancestor_keys")[0])
        return rows.withColumn("node_key", key_of(ns, F.lit("column"), F.coalesce("logical_id", F.lit("")), F.col("parent_key"))).select(*shown)

    @cache
    def own() -> DataFrame:
        contract = within(rule("contract"), m).withColumns({**top, "node_key": F.col("contract_key"), "kind": F.lit("contract"), "logical_id": F.col("id"), "name": F.coalesce(F.trim(filled(get(m, "name"))), "id"), "description": text(get(m, "description/purpose")), "attributes": _contract_attributes(m, lists)})
        datasets = listed().filter("name IS NOT NULL").withColumns({**top, "kind": F.lit("dataset"), "logical_id": _id(m), "description": text(get(m, "description")), "attributes": _attributes(m, lists)})
        return contract.select(*shown).unionByName(datasets.select(*shown)).unionByName(columns().filter("name IS NOT NULL"))

    def edges() -> DataFrame:
        governs = listed().filter("name IS NOT NULL").select(F.col("contract_key").alias("src_key"), F.lit("governs").alias("kind"), F.col("node_key").alias("dst_key"), F.lit("{}").alias("attributes_json"), "provenance")
        return governs.unionByName(contains(columns().filter("name IS NOT NULL"), F.col("provenance"))).select(*EDGE_COLUMNS)

    def problems() -> DataFrame:
        contract = rule("contract")
        found = [contract.filter(filled(get(m, c)).isNull()).select(F.lit(f"/{c}").alias("path"), F.lit(f"contract {c} is required").alias("message")) for c in ("id", "version")]
        found.append(listed().filter("name IS NULL").select(F.concat(F.lit("/"), F.array_join("path", "/"), F.lit("/name")).alias("path"), F.lit("schema object name is required").alias("message")))
        found.append(columns().filter("name IS NULL").select(F.concat(F.lit("column of "), "parent_key").alias("path"), F.lit("property name is required").alias("message")))
        # Siblings share an id: the graph would take two columns for one.
        found.append(own().groupBy("node_key").count().filter("count > 1").select(F.col("node_key").alias("path"), F.lit("siblings share an identity").alias("message")))
        return reduce(DataFrame.unionByName, found)

    return Mapped(lambda: finished(own()), edges, lambda: observe(own()), problems)
