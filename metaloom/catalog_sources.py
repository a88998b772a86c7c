"""Registered queries over documents and system tables, which are made of the supplied tables and then read as any others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import projections as P
from .catalog import Query
from .operators import compare, reconcile
from .sources import catalog, dbt, odcs, openlineage, snapshot

S = F.struct
NS = "ns"


def _text(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


# --- a relational catalog --------------------------------------------------------------------------------------


def system_tables(spark, d) -> dict[str, DataFrame]:
    """Nations as schemas of one database, customers as tables (some are views), their orders as columns (low ones are
    dropped). A customer's key is the orders that four divides; every third refers to the next customer."""
    t = lambda name: P.table(spark, d, name)
    rows = lambda data, kind: spark.createDataFrame(data, kind)
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    spaces = t("nation").select((F.col("n_nationkey") + 100).alias("oid"), F.col("n_name").alias("nspname"), (F.col("n_regionkey") + 10).alias("nspowner"))
    spaces = spaces.unionByName(rows([(1, "pg_catalog", 10), (2, "information_schema", 10)], "oid bigint, nspname string, nspowner bigint"))
    classes = t("customer").select((c + 10_000).alias("oid"), F.col("c_name").alias("relname"), (F.col("c_nationkey") + 100).alias("relnamespace"), F.when(c % 10 == 9, "v").otherwise("r").alias("relkind"), (c % 5 + 10).alias("relowner"))
    orders = t("orders")
    attributes = orders.select((F.col("o_custkey") + 10_000).alias("attrelid"), (o + 1).alias("attnum"), _text("o", "o_orderkey").alias("attname"), (F.col("o_orderstatus") == "F").alias("attnotnull"), (F.col("o_orderpriority") == "5-LOW").alias("attisdropped"), F.col("o_orderpriority").alias("type_name"))
    keys = orders.filter(o % 4 == 0).groupBy("o_custkey").agg(F.array_sort(F.collect_list(o + 1)).alias("conkey"))
    none = F.lit(None).cast("array<bigint>")
    first = orders.filter("o_orderpriority != '5-LOW'").groupBy("o_custkey").agg((F.min("o_orderkey") + 1).alias("first"))
    refers = first.filter(F.col("o_custkey") % 3 == 0).join(first.select((F.col("o_custkey") - 1).alias("o_custkey"), F.col("first").alias("there")), "o_custkey")
    constraints = keys.select(F.lit("pk").alias("conname"), F.lit("p").alias("contype"), (F.col("o_custkey") + 10_000).alias("conrelid"), F.lit(0).cast("bigint").alias("confrelid"), "conkey", none.alias("confkey"))
    constraints = constraints.unionByName(refers.select(F.lit("fk").alias("conname"), F.lit("f").alias("contype"), (F.col("o_custkey") + 10_000).alias("conrelid"), (F.col("o_custkey") + 10_001).alias("confrelid"), F.array("first").alias("conkey"), F.array("there").alias("confkey")))
    said = t("customer").filter("c_mktsegment != 'BUILDING'").select((c + 10_000).alias("objoid"), F.lit(0).cast("bigint").alias("objsubid"), F.lit("pg_class").alias("about"), F.col("c_mktsegment").alias("description"))
    said = said.unionByName(orders.filter("o_orderstatus = 'P'").select((F.col("o_custkey") + 10_000).alias("objoid"), (o + 1).alias("objsubid"), F.lit("pg_class").alias("about"), F.lit("pending").alias("description")))
    return {
        "databases": rows([(1, "shop", 10, True), (2, "other", 10, False)], "oid bigint, datname string, datdba bigint, here boolean"),
        "namespaces": spaces,
        "classes": classes,
        "attributes": attributes,
        "constraints": constraints,
        "descriptions": said,
        "shared_descriptions": rows([(1, "the shop")], "objoid bigint, description string"),
        "roles": t("region").select((F.col("r_regionkey") + 10).alias("oid"), F.col("r_name").alias("rolname")),
    }


def _model(spark, d) -> catalog.Model:
    return catalog.build_model(catalog.rows_of(system_tables(spark, d)), "src")


def catalog_objects(spark, d):
    return catalog.objects(_model(spark, d))


def catalog_kinds(spark, d):
    return catalog.summary(_model(spark, d))


def catalog_keys(spark, d):
    """Primary and foreign keys with their columns in order."""
    m = _model(spark, d)
    own = lambda df: df.select("local_id", F.array_join("columns", ",").alias("columns"), (F.array_join("to_columns", ",") if "to_columns" in df.columns else F.lit("")).alias("to_columns"))
    return own(m.primary_keys).unionByName(own(m.foreign_keys))


def catalog_properties(spark, d):
    return catalog.snapshot(_model(spark, d))[1].select("object_key", "pointer", "value_json")


def catalog_unfit_properties(spark, d):
    """Orders as columns of which some carry a property of tables, a number as a type or a text where a truth is due."""
    o = P.table(spark, d, "orders").select(_text("col:", "o_orderkey").alias("object_key"), "o_orderstatus", "o_orderpriority")
    status, priority = F.concat(F.lit('"'), "o_orderstatus", F.lit('"')), F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))
    pairs = F.array(
        S(F.when(F.col("o_orderstatus") == "P", "/ownership").otherwise("/description").alias("pointer"), status.alias("value_json")),
        S(F.lit("/data_type").alias("pointer"), F.when(F.col("o_orderpriority") == "5-LOW", F.lit("5")).otherwise(priority).alias("value_json")),
        S(F.lit("/nullable").alias("pointer"), F.when(F.col("o_orderstatus") == "F", F.lit('"true"')).otherwise(F.lit("true")).alias("value_json")),
    )
    properties = o.select("object_key", F.explode(pairs).alias("p")).select("object_key", "p.*", F.lit(True).alias("has_value"))
    return catalog.unfit_properties(o.filter("o_orderpriority != '1-URGENT'").select("object_key", F.lit("column").alias("kind")), properties)


def catalog_assets(spark, d):
    found = catalog.desired_assets(_model(spark, d), {"description": "d", "owner": "o", "data_type": "t"})
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    return found.select("local_id", "name", "display_name", at("d").alias("described"), at("o").alias("owned"), at("t").alias("typed"))


def catalog_relations(spark, d):
    return catalog.desired_relationships(_model(spark, d))


def catalog_index(spark, d):
    return catalog.physical_index(_model(spark, d), NS)


def catalog_index_conflicts(spark, d):
    """Local ids that a graph gives to another node than the index: what lies in a schema that it names in lower case."""
    index = catalog.physical_index(_model(spark, d), NS)
    known = index.select("local_id", F.when(F.col("local_id").rlike("/NATION_1(/|$)"), F.replace("node_key", F.lit("NATION_1"), F.lit("nation_1"))).otherwise(F.col("node_key")).alias("node_key"))
    return reconcile.index_conflicts(known, index).select("local_id", "indexed")


# --- manifests -------------------------------------------------------------------------------------------------


def manifests(spark, d) -> DataFrame:
    """A manifest for each nation, segment and ten thousand keys: customers as models that depend on their nation, a source, and on a macro.
    Furniture is ephemeral; a model with a negative balance has no database; machinery wants a parent that is not there."""
    c = P.table(spark, d, "customer")
    name, none = _text("c", "c_custkey"), F.lit(None).cast("string")
    column = S(F.lit("id").alias("name"), F.lit("int").alias("data_type"), F.array(F.lit("b"), F.lit("a"), F.lit("b")).alias("tags"))
    model = S(
        F.lit("model").alias("resource_type"), name.alias("name"), F.lit("p").alias("package_name"), F.when(F.col("c_acctbal") >= 0, F.lit("db")).alias("database"), F.col("c_mktsegment").alias("schema"), name.alias("alias"),
        F.array(F.lit("p"), name).alias("fqn"), S(F.when(F.col("c_mktsegment") == "FURNITURE", "ephemeral").otherwise("table").alias("materialized")).alias("config"), F.create_map(F.lit("id"), column).alias("columns"), F.col("c_name").alias("description"),
    )
    nation = _text("n", "c_nationkey")
    source = S(F.lit("source").alias("resource_type"), nation.alias("name"), F.lit("raw").alias("source_name"), F.lit("p").alias("package_name"), F.lit("db").alias("database"), F.lit("raw").alias("schema"), nation.alias("identifier"), F.array(F.lit("p"), F.lit("raw"), nation).alias("fqn"))
    unique, parent = F.concat(F.lit("model.p."), name), F.concat(F.lit("source.p.raw."), nation)
    parents = F.filter(F.array(parent, F.lit("macro.x"), F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("model.p.gone")).otherwise(none)), lambda x: x.isNotNull())
    rows = c.select("c_nationkey", "c_mktsegment", F.floor(F.col("c_custkey") / 10_000).alias("part"), S(unique.alias("key"), model.alias("value")).alias("node"), S(parent.alias("key"), source.alias("value")).alias("source"), S(unique.alias("key"), parents.alias("value")).alias("up"))
    entries = lambda x: F.map_from_entries(F.collect_list(x))
    one = rows.groupBy("c_nationkey", "c_mktsegment", "part").agg(entries("node").alias("nodes"), F.map_from_entries(F.array(F.first("source"))).alias("sources"), entries("up").alias("parent_map"))
    return one.select(F.to_json(S(S(F.lit("1.8").alias("dbt_version")).alias("metadata"), "nodes", "sources", "parent_map")).alias("text"))


def _manifest(spark, d):
    return dbt.map_manifests(manifests(spark, d), NS)


def dbt_nodes(spark, d):
    return _manifest(spark, d).nodes.select("node_key", "kind", "name", "description", "attributes_json", F.size("provenance").alias("n_sources"))


def dbt_edges(spark, d):
    return _manifest(spark, d).edges.select("src_key", "kind", "dst_key", F.size("provenance").alias("n_sources")).distinct()


def dbt_problems(spark, d):
    return _manifest(spark, d).problems


def dbt_observations(spark, d):
    return _manifest(spark, d).observations.select("object_key", "pointer", "value_json").distinct()


# --- contracts -------------------------------------------------------------------------------------------------


def contracts(spark, d) -> DataFrame:
    """A contract for each part. Economy parts state no version; the column below six lists is named by the size."""
    p = P.table(spark, d, "part")
    inner = S(F.array(S(_text("s", "p_size").alias("name"), F.lit("integer").alias("logicalType"))).alias("properties"))
    for _ in range(5):
        inner = S(inner.alias("items"))
    brand = S(F.lit("b").alias("id"), F.lit("brand").alias("name"), F.array(S(F.lit("maker").alias("name"), F.array(F.lit("z"), F.lit("a"), F.lit("z")).alias("tags"))).alias("properties"))
    # All properties need one type in an array, so each is its own text and the texts are joined.
    properties = [F.to_json(S(F.lit("key").alias("name"), F.lit("integer").alias("logicalType"), F.lit(True).alias("primaryKey"))), F.to_json(brand), F.to_json(S(F.lit("lists").alias("name"), inner.alias("items")))]
    head = F.to_json(S(_text("p", "p_partkey").alias("id"), F.when(F.col("p_type") != "ECONOMY", F.lit("1.0")).alias("version"), F.col("p_name").alias("name"), F.col("p_brand").alias("tenant")))
    schema = F.concat(F.lit('"schema":[{"name":"'), _text("d", "p_partkey"), F.lit('","properties":['), F.concat_ws(",", *properties), F.lit("]}]}"))
    both = p.select(head.alias("head"), schema.alias("tail"))
    return both.select(F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(","), F.col("tail")).alias("text"))


def _contract(spark, d):
    return odcs.map_contracts(contracts(spark, d), NS)


def odcs_nodes(spark, d):
    return _contract(spark, d).nodes.select("node_key", "kind", "name", "attributes_json")


def odcs_edges(spark, d):
    return _contract(spark, d).edges.select("src_key", "kind", "dst_key")


def odcs_problems(spark, d):
    return _contract(spark, d).problems.groupBy("path", "message").agg(F.count(F.lit(1)).alias("n_problems"))


def odcs_observations(spark, d):
    return _contract(spark, d).observations.select("object_key", "pointer", "value_json")


# --- lineage events --------------------------------------------------------------------------------------------


def events(spark, d) -> DataFrame:
    """A run for each customer: it reads its nation, a table of a database, and writes the customer, whose balance comes
    from the nation's. Runs of furniture state a time without a zone. A second event of each run reads the market
    segment, whose owners it names, and tells the customer's type, on which it disagrees with the first for machinery;
    that of household deletes the facet."""
    c = P.table(spark, d, "customer")
    level = lambda kind, name: S(F.lit(kind).alias("type"), name.alias("name"))
    nation = _text("n", "c_nationkey")
    hierarchy = S(F.lit("q").alias("_producer"), F.array(level("DATABASE", F.lit("db")), level("schema", F.lit("s")), level("TABLE", nation)).alias("hierarchy"))
    read = S(F.lit("w").alias("namespace"), nation.alias("name"), S(hierarchy.alias("hierarchy")).alias("facets"))
    field = S(F.lit("balance").alias("name"), F.lit("decimal").alias("type"), F.array(S(F.lit("cents").alias("name"))).alias("fields"))
    lineage = F.create_map(F.lit("balance"), S(F.array(S(F.lit("w").alias("namespace"), nation.alias("name"), F.lit("total").alias("field"))).alias("inputFields")))
    facets = S(S(F.lit("q").alias("_producer"), F.array(field).alias("fields")).alias("schema"), S(F.lit("r").alias("_producer"), F.lower("c_mktsegment").alias("storageLayer")).alias("storage"), S(F.lit("q").alias("_producer"), lineage.alias("fields")).alias("columnLineage"))
    written = S(F.lit("w").alias("namespace"), _text("c", "c_custkey").alias("name"), facets.alias("facets"))
    typed = lambda kind: S(S(F.lit("t").alias("_producer"), kind.alias("datasetType"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", True).alias("_deleted")).alias("datasetType"))
    run = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    when = F.when(F.col("c_mktsegment") == "FURNITURE", "2024-01-01").otherwise("2024-01-01T00:00:00Z")
    event = S(when.alias("eventTime"), F.lit("p").alias("producer"), F.lit("u").alias("schemaURL"), S(run.alias("runId")).alias("run"), S(F.lit("j").alias("namespace"), F.col("c_mktsegment").alias("name")).alias("job"), F.array(read).alias("inputs"), F.array(written).alias("outputs"))
    owner = lambda kind: S(F.lower("c_mktsegment").alias("name"), F.lit(kind).alias("type"))
    segment = S(F.lit("w").alias("namespace"), F.col("c_mktsegment").alias("name"), S(S(F.lit("o").alias("_producer"), F.array(owner("team"), owner("lead"), owner("team")).alias("owners")).alias("ownership")).alias("facets"))
    again = lambda kind: S(F.lit("w").alias("namespace"), _text("c", "c_custkey").alias("name"), typed(kind).alias("facets"))
    kinds = F.array(F.lit("VIEW"), F.when(F.col("c_mktsegment") == "MACHINERY", "TABLE"))
    second = [S(F.lit("2024-01-02T00:00:00Z").alias("eventTime"), F.lit("p").alias("producer"), F.lit("u").alias("schemaURL"), S(run.alias("runId")).alias("run"), S(F.lit("j").alias("namespace"), F.col("c_mktsegment").alias("name")).alias("job"), F.array(segment).alias("inputs"), F.array(again(kinds[i])).alias("outputs")) for i in range(2)]
    texts = F.array(F.to_json(event), F.to_json(second[0]), F.when(kinds[1].isNotNull(), F.to_json(second[1])))
    return c.select(F.explode(F.filter(texts, lambda x: x.isNotNull())).alias("event"))


def _events(spark, d):
    return openlineage.map_events(events(spark, d), NS)


def lineage_nodes(spark, d):
    return _events(spark, d).nodes.select("node_key", "kind", "name", "attributes_json")


def lineage_edges(spark, d):
    return _events(spark, d).edges.select("src_key", "kind", "dst_key", F.size("provenance").alias("n_sources"))


def lineage_problems(spark, d):
    return _events(spark, d).problems


def lineage_observations(spark, d):
    return _events(spark, d).observations.select("object_key", "pointer", "value_json")


# --- snapshot documents ----------------------------------------------------------------------------------------


def snapshots(spark, d) -> DataFrame:
    """A snapshot document for each nation and hundred customers: customers as tables of the nation's schema, whose name
    holds a slash and a tilde, their orders as columns. Orders that four divides are the key; every third customer's
    first column refers to its last one, and a relationship tells so.

    Planted: ids of keys that are their table's (8 divides the customer), another schema named (10 leaves 9), a
    referenced column that is not there (6 divides), a relationship's unknown foreign key (6 leaves 3), columns without
    nullable (50 divides the order), another contract version (nation 3), an envelope that names another database
    (nation 4), a repeated key (nation 5)."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    nation = F.concat(F.lit("n/"), F.col("c_nationkey"), F.lit("~"))
    table_id, column_id = _text("t", "c_custkey"), _text("k", "o_orderkey")
    column = S(column_id.alias("id"), F.concat(F.lit("o/"), o).alias("name"), F.col("o_orderpriority").alias("data_type"), o.alias("ordinal_position"), F.when(o % 50 != 0, F.col("o_orderstatus") != "F").alias("nullable"), F.when(F.col("o_orderstatus") == "P", S(F.col("o_orderpriority").alias("a/b"))).alias("technical_attributes"))
    orders = P.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.array_sort(F.collect_list(S(o.alias("at"), column.alias("x")))), lambda v: v["x"]).alias("columns"))
    rows = P.table(spark, d, "customer").join(orders, "c_custkey")
    ids = F.transform("columns", lambda v: v["id"])
    in_key = F.transform(F.filter("columns", lambda v: v["ordinal_position"] % 4 == 0), lambda v: v["id"])
    primary = F.when(F.size(in_key) > 0, S(F.when(c % 8 == 0, table_id).otherwise(_text("p", "c_custkey")).alias("id"), F.lit("pk").alias("name"), table_id.alias("table_id"), in_key.alias("column_ids")))
    foreign = S(_text("f", "c_custkey").alias("id"), F.lit("fk").alias("name"), table_id.alias("table_id"), F.array(ids[0]).alias("column_ids"), table_id.alias("referenced_table_id"), F.array(F.when(c % 6 == 0, "gone").otherwise(F.element_at(ids, -1))).alias("referenced_column_ids"))
    refers = c % 3 == 0
    table = S(table_id.alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("s"), F.col("c_nationkey"), F.when(c % 10 == 9, "x").otherwise("")).alias("schema_id"), "columns", primary.alias("primary_key"), F.filter(F.array(F.when(refers, foreign)), lambda v: v.isNotNull()).alias("foreign_keys"))
    relation = S(_text("r", "c_custkey").alias("id"), F.lit("to/self").alias("name"), table_id.alias("from_table_id"), table_id.alias("to_table_id"), F.when(c % 6 == 3, "nope").otherwise(_text("f", "c_custkey")).alias("foreign_key_id"))
    by = rows.groupBy("c_nationkey", F.floor(c / 100).alias("part")).agg(F.transform(F.array_sort(F.collect_list(S(c.alias("at"), table.alias("x")))), lambda v: v["x"]).alias("tables"), F.filter(F.transform(F.array_sort(F.collect_list(S(c.alias("at"), F.when(refers, relation).alias("x")))), lambda v: v["x"]), lambda v: v.isNotNull()).alias("relationships"))
    schema = S(F.concat(F.lit("s"), "c_nationkey").alias("id"), nation.alias("name"), F.lit("db").alias("database_id"), "tables")
    database = S(F.lit("db").alias("id"), F.lit("shop").alias("name"), F.lit("ds").alias("datasource_id"), F.array(schema).alias("schemas"))
    source = S(F.lit("ds").alias("id"), F.lit("src").alias("name"), F.lit("postgresql").alias("system_type"), F.array(database).alias("databases"))
    known = S(F.lit("src").alias("name"), F.when(F.col("c_nationkey") == 4, "other").otherwise("shop").alias("database"), F.lit("postgresql").alias("system_type"))
    scan = S(F.lit("p").alias("scanner"), F.when(F.col("c_nationkey") == 3, "2").otherwise("1").alias("scanner_contract_version"))
    whole = F.to_json(S(known.alias("source"), scan.alias("scan"), S(F.array(source).alias("data_sources"), "relationships").alias("governance")))
    return by.select(F.when(F.col("c_nationkey") == 5, F.concat(F.lit('{"scan":{},'), F.substring(whole, F.lit(2), F.length(whole)))).otherwise(whole).alias("text"))


def snapshot_objects(spark, d):
    return snapshot.Snapshots(snapshots(spark, d)).objects.select("kind", "raw_id", "object_key", "parent_key")


def snapshot_properties(spark, d):
    """All properties, of which references are identities."""
    return snapshot.Snapshots(snapshots(spark, d)).properties().select("object_key", "pointer", "value_json")


def snapshot_problems(spark, d):
    """The faults by what they are and where in a document they stand."""
    found = snapshot.Snapshots(snapshots(spark, d)).problems()
    return found.groupBy(F.regexp_replace("path", "/[0-9]+(?=/|$)", "/*").alias("place"), "problem").agg(F.count(F.lit(1)).alias("n_problems"))


def inventory_tables(spark, d):
    return snapshot.inventory(_model(spark, d))


# --- comparisons that are stored -------------------------------------------------------------------------------


def compare_orphans(spark, d):
    """Orders whose customer was added or removed with them differ from the customers that were not."""
    (bo, bp), (co, cp) = P.snapshot(spark, d, "baseline"), P.snapshot(spark, d, "candidate")
    changes = compare.object_changes(bo, co, bp, cp)
    ancestors = bo.unionByName(co).select("object_key", F.concat(F.lit("o:"), F.substring_index("parent_key", ":", -1)).alias("ancestor_key")).distinct()
    return compare.orphans(changes, ancestors)


def compare_out_of_order(spark, d):
    """Orders in the order of their keys as numbers, which is not the report order: rank of change, then the key as text."""
    o = P.table(spark, d, "orders")
    change = F.when(F.col("o_orderstatus") == "P", "added").when(F.col("o_orderstatus") == "F", "removed").otherwise("changed")
    return compare.out_of_order(o.select(F.col("o_orderkey").alias("at"), change.alias("change"), _text("o:", "o_orderkey").alias("object_key")), "at")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    catalog_objects, catalog_kinds, catalog_keys, catalog_properties, catalog_unfit_properties, catalog_assets, catalog_relations, catalog_index, catalog_index_conflicts,
    dbt_nodes, dbt_edges, dbt_problems, dbt_observations, odcs_nodes, odcs_edges, odcs_problems, odcs_observations,
    lineage_nodes, lineage_edges, lineage_problems, lineage_observations, snapshot_objects, snapshot_properties, snapshot_problems, inventory_tables, compare_orphans, compare_out_of_order,
)}
