"""Relational catalogs: rows of the system catalog as a model of levels, and the model as a snapshot.

Levels are DataFrames with a local_id: databases, schemas, tables, columns, primary_keys, foreign_keys, relationships.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import local_id
from ..shared import stored
from .base import json_text, key_of

# The system tables that are read, with the columns that are used of each. All joins are Spark's.
SYSTEM = {
    "databases": "select oid, datname, datdba, datname = current_database() as here from pg_database",
    "namespaces": "select oid, nspname, nspowner from pg_namespace",
    "classes": "select oid, relname, relnamespace, relkind, relowner from pg_class",
    "attributes": "select attrelid, attnum, attname, attnotnull, attisdropped, format_type(atttypid, atttypmod) as type_name from pg_attribute",
    "constraints": "select conname, contype, conrelid, confrelid, conkey, confkey from pg_constraint",
    "descriptions": "select objoid, objsubid, classoid::regclass::text as about, description from pg_description",
    "shared_descriptions": "select objoid, description from pg_shdescription",
    "roles": "select oid, rolname from pg_roles",
}


class Rows(NamedTuple):
    database: DataFrame
    schemas: DataFrame
    columns: DataFrame
    primary_keys: DataFrame
    foreign_keys: DataFrame


class Model(NamedTuple):
    databases: DataFrame
    schemas: DataFrame
    tables: DataFrame
    columns: DataFrame
    primary_keys: DataFrame
    foreign_keys: DataFrame
    relationships: DataFrame
    problems: DataFrame


class CatalogError(ValueError):
    """A catalog that cannot be read as one."""


#: How a reader joins the snapshot of another transaction; a fetch size takes it out of autocommit, so that both hold.
JOIN_SNAPSHOT = "SET TRANSACTION ISOLATION LEVEL REPEATABLE READ READ ONLY; SET TRANSACTION SNAPSHOT '{}'"
#: What a reader says of its own transaction, beside each row.
PROOF = "current_setting('transaction_isolation') as tx_isolation, current_setting('transaction_read_only') as tx_read_only"
_EXPORT = ("SET TRANSACTION ISOLATION LEVEL REPEATABLE READ READ ONLY", "SET LOCAL statement_timeout = '10000ms'")


def _connect(spark: SparkSession, url: str, options: dict[str, str]):
    """A connection of the driver's own, by the JDBC driver that the reads use."""
    properties = spark._jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in options:
            properties.setProperty(k, options[k])
    if "driver" in options:
        spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    return spark._jvm.java.sql.DriverManager.getConnection(url, properties)


@contextmanager
def exported_snapshot(spark: SparkSession, url: str, connect: Callable = _connect, **options: str) -> Iterator[str]:
    """The name of a snapshot that readers can join for as long as this holds, whatever else changes in the catalog."""
    connection = connect(spark, url, options)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for sql in _EXPORT:
            statement.execute(sql)
        rows = statement.executeQuery("SELECT pg_export_snapshot()")
        if not rows.next():
            raise CatalogError("the catalog exports no snapshot")
        name = rows.getString(1)
        if not re.fullmatch(r"[0-9A-Fa-f-]+", name):
            raise CatalogError("the catalog's snapshot has an unexpected name")
        yield name
    finally:
        connection.rollback()
        connection.close()


def read_system(spark: SparkSession, url: str, *, snapshot: str | None = None, **options: str) -> dict[str, DataFrame]:
    """The system tables by JDBC, read only. With the name of an exported snapshot all reads are of that one state, and
    rows of a reader that does not say so are an error; without one, each read is a transaction of its own."""
    start = JOIN_SNAPSHOT.format(snapshot) if snapshot else "SET default_transaction_read_only = on"
    read = spark.read.format("jdbc").option("url", url).option("sessionInitStatement", start).option("fetchsize", "10000").option("queryTimeout", "10").options(**options)
    return {name: _proven(read.option("query", _with_proof(query) if snapshot else query).load()) for name, query in SYSTEM.items()}


def _with_proof(query: str) -> str:
    return query.replace(" from ", f", {PROOF} from ", 1)


def _proven(rows: DataFrame) -> DataFrame:
    """Rows without what they say of their transaction, which must be the right thing."""
    if "tx_isolation" not in rows.columns:
        return rows
    ok = (F.col("tx_isolation") == "repeatable read") & (F.col("tx_read_only") == "on")
    first = next(c for c in rows.columns if not c.startswith("tx_"))
    told = F.when(F.coalesce(ok, F.lit(False)), F.col(first)).otherwise(F.raise_error(F.lit("a reader was not in the snapshot")).cast(rows.schema[first].dataType))
    return rows.withColumn(first, told).drop("tx_isolation", "tx_read_only")


def rows_of(system: dict[str, DataFrame]) -> Rows:
    """The rows of a catalog from its system tables."""
    t = system
    owner = lambda df, c, name: df.join(t["roles"].select(F.col("oid").alias(c), F.col("rolname").alias(name)), c, "left").drop(c)
    about = lambda what, name: t["descriptions"].filter(F.col("about") == what).select(F.col("objoid").alias("oid"), "objsubid", F.col("description").alias(name))
    whole = lambda what, name: about(what, name).filter("objsubid = 0").drop("objsubid")
    database = owner(t["databases"].filter("here"), "datdba", "owner_name").join(t["shared_descriptions"].withColumnRenamed("objoid", "oid"), "oid", "left")
    schemas = owner(t["namespaces"].filter(is_user_schema(F.col("nspname"))), "nspowner", "owner_name").join(whole("pg_namespace", "description"), "oid", "left")
    named = schemas.select(F.col("oid").alias("relnamespace"), F.col("nspname").alias("schema_name"))
    relations = t["classes"].join(named, "relnamespace").select("oid", "schema_name", F.col("relname").alias("table_name"), "relkind", "relowner")
    tables = owner(relations.filter("relkind IN ('r', 'p')"), "relowner", "table_owner").join(whole("pg_class", "table_description"), "oid", "left").drop("relkind")
    attributes = t["attributes"].filter("attnum > 0 AND NOT attisdropped").select(F.col("attrelid").alias("oid"), F.col("attnum").cast("int").alias("ordinal_position"), F.col("attname").alias("column_name"), F.col("type_name").alias("data_type"), (~F.col("attnotnull")).alias("nullable"))
    columns = tables.join(attributes, "oid", "left").join(about("pg_class", "column_description").withColumnRenamed("objsubid", "ordinal_position"), ["oid", "ordinal_position"], "left").drop("oid")
    # A constraint lists its columns by number, in order; those of a foreign key beside the ones that they refer to.
    ends = t["constraints"].select("conname", "contype", F.col("conrelid").alias("oid"), F.col("confrelid").alias("to_oid"), F.posexplode(F.arrays_zip(F.col("conkey").alias("own"), F.coalesce("confkey", "conkey").alias("other"))).alias("at", "pair"))
    ends = ends.select("conname", "contype", "oid", "to_oid", (F.col("at") + 1).cast("bigint").alias("key_ordinal"), F.col("pair.own").cast("int").alias("ordinal_position"), F.col("pair.other").cast("int").alias("to_position"))
    place = attributes.select("oid", "ordinal_position", "column_name").join(relations.select("oid", "schema_name", "table_name"), "oid")
    keyed = ends.join(place, ["oid", "ordinal_position"]).withColumnRenamed("conname", "constraint_name")
    target = place.select(F.col("oid").alias("to_oid"), F.col("ordinal_position").alias("to_position"), F.col("schema_name").alias("referenced_schema_name"), F.col("table_name").alias("referenced_table_name"), F.col("column_name").alias("referenced_column_name"))
    common = ["schema_name", "table_name", "constraint_name", "column_name", "key_ordinal"]
    return Rows(
        database.select(F.col("datname").alias("database_name"), "owner_name", "description"),
        schemas.select(F.col("nspname").alias("schema_name"), "owner_name", "description"),
        columns.select("schema_name", "table_name", "table_owner", "table_description", "column_name", "ordinal_position", "data_type", "nullable", "column_description"),
        keyed.filter("contype = 'p'").select(*common),
        keyed.filter("contype = 'f'").join(target, ["to_oid", "to_position"]).select(*common, "referenced_schema_name", "referenced_table_name", "referenced_column_name"),
    )


def read_rows(spark: SparkSession, url: str, *, connect: Callable = _connect, read: Callable = read_system, **options: str) -> Rows:
    """The rows of a catalog by JDBC, all of one state of it. The system tables are written to the shared folder while
    the snapshot holds, so that no later action reads the catalog again."""
    with exported_snapshot(spark, url, connect, **options) as name:
        system = {table: stored(df, f"system-{table}") for table, df in read(spark, url, snapshot=name, **options).items()}
    return rows_of(system)


def is_user_schema(c):
    return (c != "information_schema") & ~c.startswith("pg_")


def build_model(rows: Rows, source: str) -> Model:
    """The model of catalog rows, of exactly one database. A foreign key to a table or column that is not there is left
    out; a primary key with such a column, and a table without columns, is a problem."""
    if len(found := rows.database.select("database_name").take(2)) != 1:
        raise ValueError(f"a catalog has one database, not {'none' if not found else 'several'}")
    s = F.lit(source)
    database = rows.database.select(F.col("database_name").alias("database"), F.col("owner_name").alias("owner"), "description")
    one = database.select("database")
    here = lambda df: df.filter(is_user_schema(F.col("schema_name"))).join(F.broadcast(one))
    db, sch, tbl, col = F.col("database"), F.col("schema_name"), F.col("table_name"), F.col("column_name")
    databases = database.withColumns({"local_id": local_id("database", s, db), "parent_id": local_id("data_source", s), "name": db})
    schemas = here(rows.schemas).select(local_id("schema", s, db, sch).alias("local_id"), local_id("database", s, db).alias("parent_id"), sch.alias("name"), F.col("owner_name").alias("owner"), "description")
    every = here(rows.columns)
    tables = every.groupBy("database", "schema_name", "table_name").agg(F.first("table_owner").alias("owner"), F.first("table_description").alias("description"), F.count("column_name").alias("n_columns"))
    tables = tables.select(local_id("table", s, db, sch, tbl).alias("local_id"), local_id("schema", s, db, sch).alias("parent_id"), tbl.alias("name"), "owner", "description", "n_columns")
    columns = every.filter("column_name IS NOT NULL").select(local_id("column", s, db, sch, tbl, col).alias("local_id"), local_id("table", s, db, sch, tbl).alias("parent_id"), col.alias("name"), "ordinal_position", "data_type", "nullable", F.col("column_description").alias("description"))
    known = columns.select(F.col("local_id").alias("known"))
    part = lambda df: here(df).withColumn("column_id", local_id("column", s, db, sch, tbl, col))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("key_ordinal", c))), lambda x: x[c])
    pk_rows = part(rows.primary_keys)
    primary = pk_rows.groupBy("database", "schema_name", "table_name", "constraint_name").agg(ordered("column_id").alias("columns"))
    primary = primary.select(local_id("primary_key", s, db, sch, tbl, F.col("constraint_name")).alias("local_id"), local_id("table", s, db, sch, tbl).alias("parent_id"), F.col("constraint_name").alias("name"), "columns")
    fk_rows = part(rows.foreign_keys).withColumn("to_column_id", local_id("column", s, db, F.col("referenced_schema_name"), F.col("referenced_table_name"), F.col("referenced_column_name")))
    at = ["database", "schema_name", "table_name", "constraint_name"]
    lost = fk_rows.select(*at, F.explode(F.array("column_id", "to_column_id")).alias("known")).join(known, "known", "left_anti").select(*at).distinct()
    foreign = fk_rows.join(lost, at, "left_anti").groupBy(*at, "referenced_schema_name", "referenced_table_name").agg(ordered("column_id").alias("columns"), ordered("to_column_id").alias("to_columns"))
    foreign = foreign.select(local_id("foreign_key", s, db, sch, tbl, F.col("constraint_name")).alias("local_id"), local_id("table", s, db, sch, tbl).alias("parent_id"), F.col("constraint_name").alias("name"), "columns", "to_columns", local_id("table", s, db, F.col("referenced_schema_name"), F.col("referenced_table_name")).alias("to_table_id"))
    relationships = foreign.select(F.concat(F.lit("rel:"), "local_id").alias("local_id"), F.col("parent_id").alias("from_id"), F.col("to_table_id").alias("to_id"), F.col("local_id").alias("foreign_key_id"))
    empty = tables.filter("n_columns = 0").select(F.col("local_id").alias("path"), F.lit("a table has no columns").alias("message"))
    unknown = pk_rows.join(known, F.col("column_id") == F.col("known"), "left_anti").select(F.col("column_id").alias("path"), F.lit("a primary key has an unknown column").alias("message"))
    return Model(databases, schemas, tables.drop("n_columns"), columns, primary, foreign, relationships, empty.unionByName(unknown))


def objects(model: Model) -> DataFrame:
    """All objects of a model in one table: kind, local_id, parent_id, name, owner, description."""
    none = F.lit(None).cast("string")
    level = lambda df, kind: df.select(F.lit(kind).alias("kind"), "local_id", "parent_id", "name", *((F.col(c) if c in df.columns else none).alias(c) for c in ("owner", "description")))
    out = level(model.databases, "database")
    for kind, df in (("schema", model.schemas), ("table", model.tables), ("column", model.columns), ("primary_key", model.primary_keys), ("foreign_key", model.foreign_keys)):
        out = out.unionByName(level(df, kind))
    return out


def summary(model: Model) -> DataFrame:
    return objects(model).groupBy("kind").agg(F.count(F.lit(1)).alias("n_objects"))


def snapshot(model: Model) -> tuple[DataFrame, DataFrame]:
    """The objects and properties that comparisons take."""
    every = objects(model)
    keyed = every.select(F.col("local_id").alias("object_key"), "kind", F.col("parent_id").alias("parent_key"))
    null = F.lit("null")
    text = lambda c: F.when(F.col(c).isNull(), null).otherwise(json_text(F.col(c)))
    pair = lambda pointer, value: F.struct(F.lit(pointer).alias("pointer"), value.alias("value_json"))
    owned = F.col("kind").isin("database", "schema", "table")
    described = ~F.col("kind").isin("primary_key", "foreign_key")
    base = every.select(F.col("local_id").alias("object_key"), F.explode(F.filter(F.array(F.when(described, pair("/description", text("description"))), F.when(owned, pair("/ownership", text("owner")))), lambda x: x.isNotNull())).alias("p"))
    columns = model.columns.select(F.col("local_id").alias("object_key"), F.explode(F.array(pair("/data_type", text("data_type")), pair("/nullable", F.col("nullable").cast("string")), pair("/ordinal_position", F.col("ordinal_position").cast("string")))).alias("p"))
    listed = lambda df, c: df.select(F.col("local_id").alias("object_key"), pair(f"/{c}", F.concat(F.lit("["), F.array_join(F.transform(c, json_text), ","), F.lit("]"))).alias("p"))
    keys = listed(model.primary_keys, "columns").unionByName(listed(model.foreign_keys, "columns")).unionByName(listed(model.foreign_keys, "to_columns"))
    rows = base.unionByName(columns).unionByName(keys).select("object_key", "p.pointer", F.lit(True).alias("has_value"), "p.value_json")
    return keyed, rows


def physical_index(model: Model, namespace: str) -> DataFrame:
    """local_id, kind, node_key of the graph node that each database, schema, table and column of a model is."""
    ns = F.lit(namespace)
    up = model.databases.select("local_id", F.lit("data_source").alias("kind"), key_of(ns, F.lit("data_source"), F.col("name")).alias("node_key"))
    out = up
    for level, kind in ((model.schemas, "dataset"), (model.tables, "table"), (model.columns, "column")):
        above = up.select(F.col("local_id").alias("parent_id"), F.col("node_key").alias("above"))
        up = level.select("local_id", "parent_id", "name").join(above, "parent_id").select("local_id", F.lit(kind).alias("kind"), key_of(ns, F.lit(kind), F.col("name"), F.col("above")).alias("node_key"))
        out = out.unionByName(up)
    return out


# The properties of a snapshot's objects by kind, and the kinds of JSON values of each.
PROPERTY_KINDS = {
    "database": ("/description", "/ownership"),
    "schema": ("/description", "/ownership"),
    "table": ("/description", "/ownership"),
    "column": ("/description", "/data_type", "/nullable", "/ordinal_position"),
    "primary_key": ("/columns",),
    "foreign_key": ("/columns", "/to_columns"),
}
VALUE_PATTERNS = {
    "/description": '^(null|".*")$',
    "/ownership": '^(null|".*")$',
    "/data_type": '^".+"$',
    "/nullable": "^(true|false)$",
    "/ordinal_position": "^[1-9][0-9]*$",
    "/columns": r'^\[".+"\]$',
    "/to_columns": r'^\[".+"\]$',
}


def unfit_properties(objects_: DataFrame, properties: DataFrame) -> DataFrame:
    """Properties that an object of that kind cannot have, or whose value is of another type: object_key, pointer, problem."""
    allowed = F.array_contains(F.try_element_at(F.create_map(*(x for k, v in PROPERTY_KINDS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("kind")), F.col("pointer"))
    pattern = F.try_element_at(F.create_map(*(F.lit(x) for pair in VALUE_PATTERNS.items() for x in pair)), F.col("pointer"))
    fits = F.expr("value_json RLIKE pattern")
    why = F.when(F.col("kind").isNull(), "unknown_object").when(~F.coalesce(allowed, F.lit(False)), "property_of_another_kind").when(F.col("has_value") & ~F.coalesce(fits, F.lit(False)), "value_of_another_type").when(~F.col("has_value") & F.col("value_json").isNotNull(), "value_without_presence")
    both = properties.join(objects_.select("object_key", "kind"), "object_key", "left").withColumn("pattern", pattern)
    return both.select("object_key", "pointer", why.alias("problem")).filter("problem IS NOT NULL")


def desired_assets(model: Model, type_refs: dict[str, str]) -> DataFrame:
    """Assets that a remote catalog should have: dotted names, and attributes that are not blank as text.

    type_refs: the attribute for description, owner, data_type.
    """
    every = objects(model).filter("kind IN ('database', 'schema', 'table', 'column')")
    types = model.columns.select("local_id", "data_type")
    dotted = F.replace(F.substring_index("local_id", ":", -1), F.lit("/"), F.lit("."))
    value = {"description": F.col("description"), "owner": F.col("owner"), "data_type": F.col("data_type")}
    pairs = F.array(*(F.struct(F.lit(ref).alias("key"), value[name].alias("value")) for name, ref in type_refs.items()))
    kept = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull() & (F.trim(p["value"]) != "")))
    return every.join(types, "local_id", "left").select("local_id", dotted.alias("name"), F.col("name").alias("display_name"), kept.alias("attributes"), F.col("kind").alias("type_ref"))


def desired_relationships(model: Model) -> DataFrame:
    """contains relations from each parent to its child, and one relation for each foreign key."""
    inner = objects(model).filter("kind IN ('schema', 'table', 'column')").select(F.col("parent_id").alias("source_id"), F.col("local_id").alias("target_id"), F.lit("contains").alias("type_ref"))
    return inner.unionByName(model.relationships.select(F.col("from_id").alias("source_id"), F.col("to_id").alias("target_id"), F.lit("references").alias("type_ref")))


def problems(objects_: DataFrame) -> DataFrame:
    """Objects that share a local id, and those whose parent is not there (roots aside)."""
    twice = objects_.groupBy("local_id").count().filter("count > 1").select("local_id", F.lit("repeated_id").alias("problem"))
    lost = objects_.filter("kind != 'database'").join(objects_.select(F.col("local_id").alias("up")), F.col("parent_id") == F.col("up"), "left_anti").select("local_id", F.lit("missing_parent").alias("problem"))
    return twice.unionByName(lost)
