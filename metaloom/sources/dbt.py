"""Transformation manifests: models and sources as tables, their columns, and the dependencies between them."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import Rule, ancestor, filled, flatten, get, last_token, pairs, sorted_array, sorted_texts, text
from ..operators.graph import merge_nodes
from ..shared import stored
from .base import EDGE_COLUMNS, NODE_COLUMNS, Mapped, contains, containers, finished, json_text, key_of, observe, provenance, whole_texts

#: What a manifest holds: a resource's place in the graph is kept for its columns.
RULES = {
    "manifest": Rule(rows={"nodes/*": "resource", "sources/*": "resource", "parent_map/*": "parents", "disabled/*": "disabled"}, tell=(), open=("metadata",), keep=("metadata/dbt_version",)),
    "resource": Rule(rows={"columns/*": "column"}, open=("config",), lists=("tags",), keep=("resource_type", "name", "package_name", "fqn", "database", "schema", "alias", "identifier", "config/materialized")),
    "column": Rule(lists=("tags", "constraints")),
    "parents": Rule(),
    "disabled": Rule(tell=()),
}


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return whole_texts(spark, path, ".json")


def _placed(rows: DataFrame, m: Column, unique_id: Column, namespace: str, default_database: str | None) -> DataFrame:
    """Rows of models and sources (and of what lies in them) with the resource's key, kind, place and provenance."""
    ns = F.lit(namespace)
    rows = rows.withColumns({"r": m, "unique_id": unique_id, "version": text(get(ancestor(0), "metadata/dbt_version")), "resource_type": text(get(m, "resource_type"))})
    r, model = F.col("r"), F.col("resource_type") == "model"
    rows = rows.filter("resource_type IN ('model', 'source')").withColumns({
        "ephemeral": F.coalesce(model & (text(get(r, "config/materialized")) == "ephemeral"), F.lit(False)),
        "database": F.coalesce(filled(get(r, "database")), F.lit(default_database.strip() if default_database else None).cast("string")),
        "schema": text(get(r, "schema")),
        "relation": F.when(model, text(get(r, "alias"))).otherwise(text(get(r, "identifier"))),
    })
    source = key_of(ns, F.lit("data_source"), F.col("database"))
    rows = rows.withColumn("up_keys", F.when(~F.col("ephemeral"), F.array(key_of(ns, F.lit("dataset"), F.col("schema"), source), source)).otherwise(F.array().cast("array<string>")))
    step = F.concat(F.lit("["), get(r, "package_name"), F.lit(","), get(r, "fqn"), F.lit("]"))
    return rows.withColumns({
        "resource_kind": F.when(F.col("ephemeral"), "transformation").otherwise("table"),
        "resource_id": F.when(F.col("ephemeral"), step).otherwise(F.col("relation")),
        "provenance": provenance("dbt", F.col("unique_id"), F.col("version")),
        "namespace": ns,
    }).withColumn("resource_key", key_of(ns, F.col("resource_kind"), F.col("resource_id"), F.coalesce(F.get("up_keys", F.lit(0)), F.lit("null"))))


def _meta(m: Column) -> Column:
    """The metadata, if it is an object with members."""
    return F.when(get(m, "meta").startswith("{") & (get(m, "meta") != "{}"), get(m, "meta"))


def _attributes(m: Column, lists: Column) -> Column:
    model, materialized = F.col("resource_type") == "model", get(m, "config/materialized")
    return pairs(
        dbt_resource_type=json_text(F.col("resource_type")),
        dbt_name=get(m, "name"),
        package_name=get(m, "package_name"),
        fqn=F.when(get(m, "fqn").startswith("["), get(m, "fqn")),
        tags=sorted_texts(get(lists, "tags")),
        meta=_meta(m),
        materialized=F.when(model & materialized.startswith('"') & (materialized != '""'), materialized),
        source_name=F.when(~model, get(m, "source_name")),
        loader=F.when(~model & filled(get(m, "loader")).isNotNull(), get(m, "loader")),
    )


def _column_attributes(m: Column, lists: Column) -> Column:
    some = lambda name: F.when(get(m, name) != "null", get(m, name))
    constraints = sorted_array(get(lists, "constraints"), distinct=True)
    return pairs(data_type=some("data_type"), tags=sorted_texts(get(lists, "tags")), meta=_meta(m), quote=some("quote"), constraints=F.when(constraints != "[]", constraints))


def map_manifests(manifests: DataFrame, namespace: str, default_database: str | None = None) -> Mapped:
    """The graph and observations of manifests (column text). A model that is ephemeral is a transformation; a
    relation without a database takes the default one, and is a problem where there is none. Each manifest is parsed
    once; what is asked for is planned over its flat rows."""
    ns, m, lists = F.lit(namespace), F.col("m"), F.col("lists")
    parsed = cache(lambda: stored(flatten(manifests, "text", RULES, "manifest"), "manifests", "rule"))
    rule = lambda name: parsed().filter(F.col("rule") == name)
    fit = F.col("ephemeral") | F.col("database").isNotNull()
    resources = cache(lambda: _placed(rule("resource"), m, last_token(), namespace, default_database))

    def own() -> DataFrame:
        """Nodes that the manifests state, with maps of attributes."""
        made = resources().filter(fit).withColumns({"node_key": F.col("resource_key"), "kind": F.col("resource_kind"), "logical_id": F.col("resource_id"), "parent_key": F.get("up_keys", F.lit(0)), "ancestor_keys": F.col("up_keys"), "description": filled(get(m, "description")), "attributes": _attributes(m, lists)})
        made = made.withColumn("name", F.when(F.col("ephemeral"), text(get(m, "name"))).otherwise(F.col("relation")))
        place = F.col("up")[1]
        columns = _placed(rule("column"), place["m"], F.element_at(place["path"], -1), namespace, default_database).filter(fit).withColumn("name", text(get(m, "name")))
        columns = columns.withColumns({"kind": F.lit("column"), "logical_id": F.col("name"), "parent_key": F.col("resource_key"), "ancestor_keys": F.concat(F.array("resource_key"), "up_keys"), "node_key": key_of(ns, F.lit("column"), F.col("name"), F.col("resource_key")), "description": filled(get(m, "description")), "attributes": _column_attributes(m, lists)})
        shown = [*(c for c in NODE_COLUMNS if c != "attributes_json"), "attributes"]
        return made.select(*shown).unionByName(columns.select(*shown))

    def nodes() -> DataFrame:
        return finished(own()).unionByName(containers(resources().filter("NOT ephemeral AND database IS NOT NULL"), namespace))

    def linked() -> DataFrame:
        """Each child that is known with each parent that it names, and the parent's key where that is known."""
        known = stored(resources().filter(fit).select("unique_id", "resource_key", "provenance").distinct(), "resources")
        stated = F.transform(get(lists, ""), text)
        parents = rule("parents").select(last_token().alias("child"), F.explode(F.array_distinct(F.filter(stated, lambda x: x.isNotNull()))).alias("parent")).distinct()
        child = known.select(F.col("unique_id").alias("child"), F.col("resource_key").alias("src_key"), "provenance")
        parent = known.select(F.col("unique_id").alias("parent"), F.col("resource_key").alias("dst_key")).distinct()
        disabled = rule("disabled").select(last_token().alias("parent")).distinct().withColumn("off", F.lit(True))
        return parents.join(child, "child").join(parent, "parent", "left").join(disabled, "parent", "left")

    def edges() -> DataFrame:
        depends = linked().filter("dst_key IS NOT NULL").select("src_key", F.lit("depends_on").alias("kind"), "dst_key", F.lit("{}").alias("attributes_json"), "provenance")
        return contains(nodes()).distinct().unionByName(depends).select(*EDGE_COLUMNS)

    def problems() -> DataFrame:
        lost = resources().filter(~fit).select(F.concat(F.lit("/"), "unique_id", F.lit("/database")).alias("path"), F.lit("database is required where there is no default").alias("message"))
        unresolved = linked().filter("dst_key IS NULL AND off IS NULL").filter(F.substring_index("parent", ".", 1).isin("model", "source"))
        return lost.unionByName(unresolved.select(F.concat(F.lit("/parent_map/"), "child").alias("path"), F.concat(F.lit("unknown parent "), "parent").alias("message")))

    return Mapped(lambda: merge_nodes(nodes()), edges, lambda: observe(own()), problems)
