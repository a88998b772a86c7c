"""Lineage events: datasets with their facets, and dependencies of outputs on inputs and between columns.

Each event is parsed once, into flat rows (functions/documents.py); all that follows are joins and groupings of those.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import Rule, ancestor, documents_in, filled, flatten, get, last_token, list_text, object_text, pairs, sorted_array, string_member, text
from ..functions.text import is_uuid, is_zoned_timestamp, strip
from ..operators.graph import bit_of, few_told, merge_edges, merge_nodes, of_bits, provenance_union, stated
from ..shared import stored
from .base import EDGE_COLUMNS, NODE_COLUMNS, Mapped, contains, containers, finished, json_text, key_of, observe, whole_texts, with_table_key

#: Facets that say something about a dataset, and the member that each must have.
FACETS = {"schema": None, "hierarchy": "hierarchy", "datasetType": "datasetType", "storage": "storageLayer", "ownership": "owners"}

_FACET_ROWS = {f"facets/{name}": "schema" if name == "schema" else "facet" for name in FACETS} | {"facets/columnLineage": "lineage"}

#: What an event holds.
RULES = {
    "event": Rule(rows={"inputs/*": "input", "outputs/*": "output", "dataset": "dataset"}, open=("run", "job"), keep=("producer", "schemaURL", "eventTime", "dataset", "run/runId", "job/namespace", "job/name")),
    **{side: Rule(rows=_FACET_ROWS, keep=("namespace", "name")) for side in ("input", "output", "dataset")},
    "facet": Rule(lists=("hierarchy", "owners"), keep=("_producer",)),
    "schema": Rule(rows={"fields/*": "field"}, lists=("fields",)),
    "field": Rule(rows={"fields/*": "field"}, keep=("name",)),
    "lineage": Rule(rows={"fields/*": "lineage_field"}, keep=("_producer",)),
    "lineage_field": Rule(rows={"inputFields/*": "source"}, tell=("inputFields",)),
    "source": Rule(),
}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """One row (event, a JSON text) for each event; a file holds one event or an array of them."""
    return whole_texts(spark, path, ".json").select(F.explode(documents_in("text")).alias("event"))


def _event(m: Column) -> dict[str, Column]:
    """What is told of an event, from its members: kind (run, job, dataset), run_id, job, producer, time."""
    run, job = strip(text(get(m, "run/runId"))), strip(text(get(m, "job/name")))
    kind = F.when(run.isNotNull(), "run").when(get(m, "dataset").isNotNull(), "dataset").when(job.isNotNull(), "job")
    return {"producer": text(get(m, "producer")), "schema_url": text(get(m, "schemaURL")), "time": text(get(m, "eventTime")), "run_id": run, "job_namespace": strip(text(get(m, "job/namespace"))), "job_name": job, "kind": kind}


def _stated(ref: Column) -> Column:
    return F.array(F.struct(F.lit("openlineage").alias("provider_type"), ref.alias("source_ref"), F.col("schema_url").alias("source_version"), F.lit("observed").alias("observation_mode")))


class Parsed:
    """Events (column event) as flat rows in the shared folder; the order of events does not matter."""

    def __init__(self, events: DataFrame):
        self.rows = stored(flatten(events, "event", RULES, "event", distinct=True), "events", "rule")

    def rule(self, *names: str) -> DataFrame:
        """Rows of these rules with what is told of their event and, for what lies in a dataset, with its ns and name."""
        rows = self.rows.filter(F.col("rule").isin(*names))
        if names == ("event",):
            return rows.withColumns(_event(F.col("m")))
        own = F.col("m") if set(names) <= {"input", "output", "dataset"} else ancestor(1)
        return rows.withColumns(_event(ancestor(0)) | {"ns": strip(text(get(own, "namespace"))), "name": strip(text(get(own, "name")))})

    def datasets(self) -> DataFrame:
        """A row for each dataset of each event: side (input, output, dataset), ns, name, provenance."""
        rows = self.rule("input", "output", "dataset")
        return rows.select("kind", "run_id", "job_namespace", "job_name", "schema_url", F.col("doc").alias("event_key"), F.col("rule").alias("side"), "ns", "name", _stated(F.col("producer")).alias("provenance"))

    def problems(self) -> DataFrame:
        """What is wrong with events and their facets: path, message."""
        events = self.rule("event")
        why = F.when(get(F.col("m"), "").isNotNull(), "an event must be an object").when(F.col("kind").isNull(), "an event needs a run, a job or a dataset").when(~F.coalesce(is_zoned_timestamp(F.col("time")), F.lit(False)), "eventTime must be a time with a zone")
        why = why.when((F.col("kind") == "run") & ~is_uuid(F.col("run_id")), "runId must be a UUID")
        of_events = events.select(F.coalesce("run_id", "job_name", F.lit("")).alias("path"), why.alias("message")).filter("message IS NOT NULL")
        jobs = events.filter("kind = 'run'").groupBy("run_id").agg(F.count_distinct("job_namespace", "job_name").alias("n")).filter("n > 1").select(F.concat(F.lit("/run/"), "run_id").alias("path"), F.lit("run events disagree on their job").alias("message"))
        facets = self.rule("facet", "schema", "lineage").withColumn("facet", last_token())
        deleted = F.coalesce(get(F.col("m"), "_deleted"), F.lit("false"))
        needed = F.lit(None).cast("string")
        for name, member in (FACETS | {"columnLineage": "fields"}).items():
            if member:
                needed = F.when((F.col("facet") == name) & get(F.col("m"), member).isNull(), member).otherwise(needed)
        fault = F.when(get(F.col("m"), "").isNotNull(), "a facet must be an object").when(deleted == "true", "deletions are not supported").when(deleted != "false", "_deleted must be a boolean")
        fault = fault.when(needed.isNotNull(), F.concat(needed, F.lit(" is required")))
        at = F.concat(F.coalesce("run_id", "job_name", F.lit("")), F.lit("/"), F.array_join("path", "/"))
        return of_events.unionByName(jobs).unionByName(facets.select(at.alias("path"), fault.alias("message")).filter("message IS NOT NULL"))

    def facet_states(self) -> DataFrame:
        """Each facet of each dataset with its material, the attributes that it states, where it stands, and provenance;
        n_materials > 1 means that events disagree, and the least material is told."""
        m, lists = F.col("m"), F.col("lists")
        rows = self.rule("facet", "schema").withColumn("facet", last_token())
        stripped = lambda name: F.when(filled(get(m, name)).isNotNull(), json_text(strip(text(get(m, name)))))
        types = pairs(dataset_type=json_text(strip(text(get(m, "datasetType")))), dataset_subtype=stripped("subType"))
        storage = pairs(storage_layer=json_text(strip(text(get(m, "storageLayer")))), file_format=F.when(get(m, "fileFormat").startswith('"'), get(m, "fileFormat")))
        rows = rows.withColumn("said", F.when(F.col("facet") == "datasetType", types).when(F.col("facet") == "storage", storage))
        material = F.when(F.col("facet") == "schema", F.coalesce(sorted_array(get(lists, "fields")), F.lit("[]"))).when(F.col("facet") == "hierarchy", list_text(get(lists, "hierarchy"))).when(F.col("facet") == "ownership", sorted_array(get(lists, "owners"), distinct=True)).otherwise(object_text(F.col("said")))
        rows = rows.withColumn("material", material)
        whole = F.when(F.col("facet").isin("hierarchy", "ownership") & F.col("material").isNotNull(), F.map_entries(F.create_map("facet", "material")))
        entries = F.coalesce(F.map_entries("said"), whole)
        rows = rows.select("ns", "name", "facet", F.struct("material", "doc", "path", get(lists, "hierarchy").alias("levels"), entries.alias("entries")).alias("first"), F.get(_stated(F.coalesce(text(get(m, "_producer")), F.lit(""))), F.lit(0)).alias("provenance"))
        found = rows.groupBy("ns", "name", "facet").agg(F.min("first").alias("first"), F.max("first.material").alias("last"), provenance_union())
        return found.select("ns", "name", "facet", F.when(F.col("first.material").eqNullSafe(F.col("last")), 1).otherwise(2).alias("n_materials"), "first.*", "provenance")

    def sources(self) -> DataFrame:
        """A row for each input field that column lineage names, with its own in_ns and in_name."""
        m = F.col("m")
        return self.rule("source").withColumns({"in_ns": strip(text(get(m, "namespace"))), "in_name": strip(text(get(m, "name"))), "in_field": strip(text(get(m, "field"))), "field": strip(F.element_at(F.col("up")[3]["path"], -1)), "by": F.coalesce(text(get(ancestor(2), "_producer")), F.lit(""))})


def identities(named: DataFrame, facets: DataFrame, namespace: str) -> DataFrame:
    """The node of each dataset (ns, name): a table if its hierarchy is exactly database, schema, table; else a dataset."""
    level = lambda i, c: strip(string_member(F.get("levels", F.lit(i)), c))
    h = facets.filter("facet = 'hierarchy'").select("ns", "name", "levels")
    each = named.select("ns", "name").distinct().join(h, ["ns", "name"], "left")
    kinds = [F.upper(level(i, "type")) == kind for i, kind in enumerate(("DATABASE", "SCHEMA", "TABLE"))]
    physical = reduce(Column.__and__, kinds, F.size("levels") == 3)
    each = each.withColumns({"physical": F.coalesce(physical, F.lit(False)), "database": level(0, "name"), "schema": level(1, "name"), "relation": level(2, "name")})
    tables = with_table_key(each.filter("physical").withColumn("logical_id", F.col("relation")), namespace).withColumn("kind", F.lit("table"))
    logical = F.concat(F.lit("["), json_text(F.col("ns")), F.lit(","), json_text(F.col("name")), F.lit("]"))
    others = each.filter("NOT physical").withColumn("logical_id", logical).withColumns({"kind": F.lit("dataset"), "parent_key": F.lit(None).cast("string"), "ancestor_keys": F.array().cast("array<string>")})
    return tables.unionByName(others.withColumn("node_key", key_of(F.lit(namespace), F.lit("dataset"), F.col("logical_id"))), allowMissingColumns=True)


def _columns(parsed: Parsed, known: DataFrame, facets: DataFrame, namespace: str) -> DataFrame:
    """Columns of the schema facets that are told, with the fields nested in them and maps of attributes."""
    ns, m = F.lit(namespace), F.col("m")
    at = facets.filter("facet = 'schema'").join(known, ["ns", "name"]).select("doc", F.array_join("path", "\0").alias("at"), F.col("node_key").alias("table_key"), F.col("ancestor_keys").alias("table_up"), "provenance")
    rows = parsed.rule("field").select("doc", F.array_join(F.col("up")[2]["path"], "\0").alias("at"), "up", "m").join(at, ["doc", "at"])
    column = lambda name, parent: key_of(ns, F.lit("column"), name, parent)
    named = lambda of: strip(text(get(of, "name")))
    above = F.aggregate(F.slice("up", 4, F.greatest(F.size("up") - 3, F.lit(0))), F.concat(F.array("table_key"), F.col("table_up")), lambda keys, x: F.concat(F.array(column(named(x["m"]), keys[0])), keys))
    rows = rows.withColumn("ancestor_keys", above).withColumns({"parent_key": F.col("ancestor_keys")[0], "name": named(m), "namespace": ns, "kind": F.lit("column"), "description": filled(get(m, "description")), "attributes": pairs(data_type=F.when(filled(get(m, "type")).isNotNull(), get(m, "type")))})
    return rows.withColumns({"logical_id": F.col("name"), "node_key": column(F.col("name"), F.col("parent_key"))}).select(*(c for c in NODE_COLUMNS if c != "attributes_json"), "attributes")


def lineage(rows: DataFrame, known: DataFrame) -> DataFrame:
    """depends_on edges of each run's (all its events') or job's outputs on its inputs, one for each pair of datasets."""
    unit = F.when(F.col("kind") == "run", F.concat(F.lit("run:"), "run_id")).otherwise(F.concat(F.lit("job:"), F.col("event_key").cast("string")))
    ends = rows.filter("kind IN ('run', 'job')").withColumn("unit", unit)
    stating = ends.select("unit", F.get(_stated(F.concat_ws("/", "job_namespace", "job_name")), F.lit(0)).alias("provenance"))
    # Few provenances are united as bits, so that the many pairs are hashed; more are collected, which sorts them.
    told = few_told(stating)
    said = stating.distinct() if told is None else stating.crossJoin(F.broadcast(told)).groupBy("unit").agg(F.bit_or(bit_of()).alias("bits"))
    ends = ends.select("unit", "side", "ns", "name").join(known.select("ns", "name", "node_key"), ["ns", "name"])
    one = lambda side, name: ends.filter(F.col("side") == side).select("unit", F.col("node_key").alias(name)).repartition("unit").distinct()
    both = one("output", "src_key").join(said, "unit").join(one("input", "dst_key"), "unit")
    pairs = both.groupBy("src_key", "dst_key")
    united = pairs.agg(provenance_union()) if told is None else pairs.agg(F.bit_or("bits").alias("bits")).crossJoin(F.broadcast(told)).withColumn("provenance", of_bits("bits"))
    return united.select("src_key", F.lit("depends_on").alias("kind"), "dst_key", F.lit("{}").alias("attributes_json"), "provenance")


def column_lineage(sources: DataFrame, known: DataFrame, namespace: str) -> DataFrame:
    """Assertions of columnLineage facets: output_key, input_key, their parents and names, provenance."""
    ins = stated(sources.withColumn("provenance", _stated(F.col("by")))).groupBy("ns", "name", "field", "in_ns", "in_name", "in_field").agg(provenance_union())
    node = known.select("ns", "name", F.col("node_key").alias("out_parent"), F.col("ancestor_keys").alias("out_up"))
    source = known.select(F.col("ns").alias("in_ns"), F.col("name").alias("in_name"), F.col("node_key").alias("in_parent"), F.col("ancestor_keys").alias("in_up"))
    both = ins.join(node, ["ns", "name"]).join(source, ["in_ns", "in_name"])
    key = lambda field, parent: key_of(F.lit(namespace), F.lit("column"), F.col(field), F.col(parent))
    return both.withColumns({"output_key": key("field", "out_parent"), "input_key": key("in_field", "in_parent")})


def map_events(events: DataFrame, namespace: str) -> Mapped:
    """The graph and observations of lineage events (column event). The order of events does not matter.

    What is used more than once is written to the shared folder, when a part that needs it is asked for.
    """
    ns, none = F.lit(namespace), F.lit(None).cast("string")
    parsed = cache(lambda: Parsed(events))
    facets = cache(lambda: stored(parsed().facet_states(), "facets"))

    @cache
    def known() -> DataFrame:
        named = parsed().datasets().select("ns", "name").unionByName(parsed().sources().select(F.col("in_ns").alias("ns"), F.col("in_name").alias("name")))  # inputs of column lineage are datasets too
        return stored(identities(named, facets(), namespace), "identities")

    claims = cache(lambda: stored(column_lineage(parsed().sources(), known(), namespace), "claims"))

    @cache
    def datasets() -> DataFrame:
        """Nodes of datasets with maps of attributes."""
        of_facets = facets().groupBy("ns", "name").agg(F.flatten(F.collect_list("entries")).alias("entries"))  # one of each facet
        every = parsed().datasets().select("ns", "name", "provenance").unionByName(facets().select("ns", "name", "provenance"))
        by = stated(every).groupBy("ns", "name").agg(provenance_union())
        nodes = known().join(of_facets, ["ns", "name"], "left").join(by, ["ns", "name"], "left")
        said = F.filter(F.coalesce("entries", F.array().cast("array<struct<key:string,value:string>>")), lambda e: (e["key"] != "hierarchy") | ~F.col("physical"))
        shown = F.when(F.col("physical"), F.col("relation")).otherwise(F.col("name"))
        return nodes.withColumns({"namespace": ns, "attributes": F.map_from_entries(said), "description": none, "name": shown}).select(*(c for c in NODE_COLUMNS if c != "attributes_json"), "attributes")

    columns = cache(lambda: _columns(parsed(), known(), facets(), namespace))

    @cache
    def new_columns() -> DataFrame:
        """Columns that column lineage alone names."""
        end = lambda key, field, parent, up: claims().select(F.col(key).alias("node_key"), F.col(field).alias("logical_id"), F.col(parent).alias("parent_key"), F.concat(F.array(parent), up).alias("ancestor_keys"), "provenance")
        ends = end("output_key", "field", "out_parent", "out_up").unionByName(end("input_key", "in_field", "in_parent", "in_up"))
        new = stated(ends).groupBy("node_key", "logical_id", "parent_key", "ancestor_keys").agg(provenance_union()).join(columns().select("node_key"), "node_key", "left_anti")
        return new.withColumns({"namespace": ns, "kind": F.lit("column"), "name": F.col("logical_id"), "description": none, "attributes": F.create_map().cast("map<string,string>")})

    @cache
    def placed() -> DataFrame:
        own = finished(datasets()).unionByName(finished(columns())).unionByName(finished(new_columns()))
        return own.unionByName(containers(known().filter("physical"), namespace))

    def edges() -> DataFrame:
        depends = claims().select(F.col("output_key").alias("src_key"), F.lit("depends_on").alias("kind"), F.col("input_key").alias("dst_key"), F.lit("{}").alias("attributes_json"), "provenance")
        return merge_edges(contains(placed()).distinct().unionByName(lineage(parsed().datasets(), known())).unionByName(depends).select(*EDGE_COLUMNS))

    def observations() -> DataFrame:
        """A property of a dataset is stated by the facet that says it, not by all events."""
        fact = facets().join(known().select("ns", "name", "node_key", "kind", "physical"), ["ns", "name"]).filter("facet != 'hierarchy' OR NOT physical")
        of_facets = fact.select(F.col("node_key").alias("object_key"), ns.alias("namespace"), "kind", F.explode("entries").alias("e"), "provenance").select("object_key", "namespace", "kind", F.concat(F.lit("/attributes/"), "e.key").alias("pointer"), F.col("e.value").alias("value_json"), "provenance")
        named_only = observe(datasets().withColumn("attributes", F.create_map().cast("map<string,string>")))
        return named_only.unionByName(of_facets).unionByName(observe(columns())).unionByName(observe(new_columns()))

    def problems() -> DataFrame:
        disagree = parsed().facet_states().filter("n_materials > 1").select(F.concat_ws("/", F.lit(""), "ns", "name", "facet").alias("path"), F.lit("events disagree on a facet").alias("message"))
        return parsed().problems().unionByName(disagree)

    return Mapped(lambda: merge_nodes(placed()), edges, observations, problems)
