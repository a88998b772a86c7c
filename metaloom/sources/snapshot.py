"""Snapshot documents: a tree of one database as levels of rows, with structured identities and every fault as a row.

An object's identity is its kind and the list of names that lead to it (schema, table, its own), as canonical JSON, so a
name may hold any character. References by raw id (columns of keys, referenced tables, the foreign key of a relationship)
become identities by joins within their document. A document is parsed once; documents are told apart by doc, their
digest.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import escape_token
from ..functions.documents import FAULT, Rule, ancestor, flatten, get, last_token, list_text, text
from ..shared import stored
from .base import json_text, whole_texts
from .catalog import Model

#: The version of the scanner's contract that is read.
CONTRACT = "1"

_NAMED = ("id", "name")
RULES = {
    "snapshot": Rule(rows={"governance/data_sources/*": "data_source", "governance/relationships/*": "relationship"}, tell=("governance",), open=("source", "scan"), keep=("source/name", "source/database", "source/system_type")),
    "data_source": Rule(rows={"databases/*": "database", "technical_attributes/*": "attribute"}, keep=_NAMED),
    "database": Rule(rows={"schemas/*": "schema"}, keep=_NAMED),
    "schema": Rule(rows={"tables/*": "table"}, keep=_NAMED),
    "table": Rule(rows={"columns/*": "column", "primary_key": "primary_key", "foreign_keys/*": "foreign_key", "technical_attributes/*": "attribute"}, keep=_NAMED),
    "column": Rule(rows={"technical_attributes/*": "attribute"}, keep=_NAMED),
    "primary_key": Rule(lists=("column_ids",), keep=_NAMED),
    "foreign_key": Rule(lists=("column_ids", "referenced_column_ids"), keep=_NAMED),
    "relationship": Rule(),
    "attribute": Rule(whole=True),
}
#: Objects by the number of objects that they lie in, and the member that names the one around them.
LEVELS = {"data_source": 1, "database": 2, "schema": 3, "table": 4, "column": 5, "primary_key": 5, "foreign_key": 5}
AROUND = {"database": "datasource_id", "schema": "database_id", "table": "schema_id", "primary_key": "table_id", "foreign_key": "table_id"}
#: The properties of each kind whose values are as they stand (null where they are missing).
PLAIN = {
    "data_source": ("name", "system_type", "description", "ownership"),
    "database": ("name", "description", "ownership"),
    "schema": ("name", "description", "ownership"),
    "table": ("name", "description", "ownership"),
    "column": ("name", "data_type", "ordinal_position", "nullable", "description"),
    "primary_key": ("name",),
    "foreign_key": ("name",),
    "relationship": ("name", "description"),
}
#: What the JSON text of a member must look like, by kind.
SHAPES = {
    **{(kind, c): r'^".*\S.*"$' for kind in (*LEVELS, "relationship") for c in _NAMED},
    ("data_source", "system_type"): r'^".*\S.*"$',
    ("column", "data_type"): r'^".*\S.*"$',
    ("column", "ordinal_position"): r"^[1-9][0-9]*$",
    ("column", "nullable"): r"^(true|false)$",
    ("relationship", "from_table_id"): r'^".*\S.*"$',
    ("relationship", "to_table_id"): r'^".*\S.*"$',
    ("foreign_key", "referenced_table_id"): r'^".*\S.*"$',
    **{(kind, "description"): r'^(null|".*")$' for kind in ("data_source", "database", "schema", "table", "column", "relationship")},
    **{(kind, "ownership"): r"^(null|\{.*\})$" for kind in ("data_source", "database", "schema", "table")},
}


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return whole_texts(spark, path, ".json")


def identity(kind: Column, path: Column) -> Column:
    """The canonical JSON of a kind and a list of names."""
    return F.concat(F.lit('{"kind":'), json_text(kind), F.lit(',"path":'), list_text(F.transform(path, json_text)), F.lit("}"))


class Snapshots:
    """Snapshot documents (column text) as levels; parts are made when first asked for."""

    def __init__(self, documents: DataFrame, contract: str = CONTRACT):
        self.documents, self.contract = documents, contract

    @cached_property
    def rows(self) -> DataFrame:
        return stored(flatten(self.documents, "text", RULES, "snapshot", faults=True), "snapshots", "rule")

    def rule(self, *names: str) -> DataFrame:
        return self.rows.filter(F.col("rule").isin(*names))

    @cached_property
    def objects(self) -> DataFrame:
        """doc, kind, raw_id, object_key, parent_key, names, place (pointer of its place in the document), table_id, m, lists."""
        m = F.col("m")
        place = F.concat(F.lit("/"), F.array_join(F.transform("path", escape_token), "/"))
        # Names of schema, table and the object itself; the roots have none.
        above = F.transform(F.slice("up", 4, F.greatest(F.size("up") - 3, F.lit(0))), lambda x: F.coalesce(text(get(x["m"], "name")), F.lit("")))
        own = F.array(F.coalesce(text(get(m, "name")), F.lit("")))
        rows = self.rule(*LEVELS).withColumns({"kind": F.col("rule"), "raw_id": text(get(m, "id")), "place": place})
        rows = rows.withColumn("names", F.when(F.col("kind").isin("data_source", "database"), F.array().cast("array<string>")).otherwise(F.concat(above, own)))
        around = F.when(F.col("kind") == "data_source", F.lit(None)).when(F.col("kind") == "database", "data_source").when(F.col("kind") == "schema", "database").when(F.col("kind") == "table", "schema").otherwise("table")
        rows = rows.withColumn("around", around).withColumn("parent_key", F.when(F.col("around").isNotNull(), identity(F.col("around"), F.when(F.size("names") > 0, F.slice("names", 1, F.size("names") - 1)).otherwise(F.col("names")))))
        rows = rows.withColumn("table_id", F.when(F.col("kind").isin("column", "primary_key", "foreign_key"), text(get(F.element_at("up", -1)["m"], "id"))))
        shown = ["doc", "kind", "raw_id", "object_key", "parent_key", "names", "place", "table_id", "m", "lists", "up"]
        tree = rows.withColumn("object_key", identity(F.col("kind"), F.col("names"))).select(*shown)
        # A relationship stands beside the tree; its place in it is the table that it comes from.
        tables = tree.filter("kind = 'table'").select("doc", F.col("raw_id").alias("from_id"), F.col("object_key").alias("parent_key"), F.col("names").alias("above"))
        beside = self.rule("relationship").withColumns({"kind": F.col("rule"), "raw_id": text(get(m, "id")), "place": place, "from_id": text(get(m, "from_table_id"))}).join(tables, ["doc", "from_id"])
        beside = beside.withColumn("names", F.concat("above", own)).withColumns({"object_key": identity(F.col("kind"), F.col("names")), "table_id": F.col("from_id")})
        return stored(tree.unionByName(beside.select(*shown)), "snapshot-objects")

    @cached_property
    def references(self) -> DataFrame:
        """Every reference by raw id: doc, object_key, place, pointer, at (its place in a list; null if it is none),
        ref_id, and the identity that it stands for (null where it does not resolve)."""
        m, lists = F.col("m"), F.col("lists")
        entry = lambda pointer, ref, kind, within, at: F.struct(F.lit(pointer).alias("pointer"), ref.alias("ref_id"), F.lit(kind).alias("want_kind"), within.alias("want_table"), at.alias("at"))
        none, no_place = F.lit(None).cast("string"), F.lit(None).cast("int")
        column_refs = lambda name, within: F.coalesce(F.transform(get(lists, name), lambda x, i: entry(f"/{name}", text(x), "column", within, i)), F.array())
        target = text(get(m, "referenced_table_id"))
        keys = F.when(F.col("kind").isin("primary_key", "foreign_key"), column_refs("column_ids", F.col("table_id"))).otherwise(F.array())
        foreign = F.when(F.col("kind") == "foreign_key", F.concat(F.array(entry("/referenced_table_id", target, "table", none, no_place)), column_refs("referenced_column_ids", target))).otherwise(F.array())
        relation = F.when(F.col("kind") == "relationship", F.filter(F.array(entry("/to_table_id", text(get(m, "to_table_id")), "table", none, no_place), F.when(text(get(m, "foreign_key_id")).isNotNull(), entry("/foreign_key_id", text(get(m, "foreign_key_id")), "foreign_key", F.col("table_id"), no_place))), lambda x: x.isNotNull())).otherwise(F.array())
        refs = self.objects.filter(F.col("kind").isin("primary_key", "foreign_key", "relationship")).select("doc", "kind", "object_key", "place", F.explode(F.concat(keys, foreign, relation)).alias("r")).select("doc", "kind", "object_key", "place", "r.*")
        known = self.objects.select("doc", F.col("raw_id").alias("ref_id"), F.col("kind").alias("want_kind"), F.col("table_id").alias("in_table"), F.col("object_key").alias("found"))
        joined = refs.join(known, ["doc", "ref_id", "want_kind"], "left")
        fits = F.col("want_table").isNull() | F.col("in_table").eqNullSafe(F.col("want_table"))
        return joined.select("doc", "kind", "object_key", "place", "pointer", "at", "ref_id", F.when(fits, F.col("found")).alias("identity"))

    def properties(self) -> DataFrame:
        """doc, object_key, pointer, has_value, value_json: plain members, technical attributes, references as identities."""
        m = F.col("m")
        plain = F.lit(None)
        for kind, members in PLAIN.items():
            each = F.array(*(F.struct(F.lit(f"/{c}").alias("pointer"), F.coalesce(get(m, c), F.lit("null")).alias("value_json")) for c in members))
            plain = F.when(F.col("kind") == kind, each).otherwise(plain)
        own = self.objects.select("doc", "object_key", F.explode(plain).alias("p")).select("doc", "object_key", "p.*")
        depth = F.size("up")
        names = F.transform(F.slice("up", 4, F.greatest(depth - 3, F.lit(0))), lambda x: F.coalesce(text(get(x["m"], "name")), F.lit("")))
        holder = identity(F.when(depth == 2, "data_source").when(depth == 5, "table").otherwise("column"), names)
        technical = self.rule("attribute").select("doc", holder.alias("object_key"), F.concat(F.lit("/technical_attributes/"), escape_token(last_token())).alias("pointer"), get(m, "").alias("value_json"))
        listed = self.references.filter("at IS NOT NULL").groupBy("doc", "object_key", "pointer").agg(F.array_sort(F.collect_list(F.struct("at", "identity"))).alias("refs"))
        listed = listed.select("doc", "object_key", "pointer", list_text(F.transform("refs", lambda r: F.coalesce(r["identity"], F.lit("null")))).alias("value_json"))
        single = self.references.filter("at IS NULL").select("doc", "object_key", "pointer", F.coalesce("identity", F.lit("null")).alias("value_json"))
        loose = self.objects.filter(F.col("kind") == "relationship").filter(text(get(m, "foreign_key_id")).isNull()).select("doc", "object_key", F.lit("/foreign_key_id").alias("pointer"), F.lit("null").alias("value_json"))
        return reduce(DataFrame.unionByName, [own, technical, listed, single, loose]).withColumn("has_value", F.lit(True)).select("doc", "object_key", "pointer", "has_value", "value_json")

    def problems(self) -> DataFrame:
        """doc, path, problem for every fault. A document is fit if it has none."""
        m = F.col("m")
        told = lambda df, path, problem: df.select("doc", path.alias("path"), (F.lit(problem) if isinstance(problem, str) else problem).alias("problem"))
        found = [told(self.rule(FAULT), F.lit(""), text(get(m, "")))]
        every = self.objects
        shapes = F.filter(F.array(*(F.when((F.col("kind") == kind) & ~F.coalesce(get(m, c), F.lit("null")).rlike(shape), F.lit(c)) for (kind, c), shape in SHAPES.items())), lambda x: x.isNotNull())
        found.append(every.select("doc", "place", F.explode(shapes).alias("c")).select("doc", F.concat("place", F.lit("/"), "c").alias("path"), F.lit("value of another type").alias("problem")))
        around = F.lit(None).cast("string")
        for kind, c in AROUND.items():
            wrong = ~text(get(m, c)).eqNullSafe(text(get(F.element_at("up", -1)["m"], "id")))
            around = F.when((F.col("kind") == kind) & wrong, c).otherwise(around)
        found.append(every.select("doc", "place", around.alias("c")).filter("c IS NOT NULL").select("doc", F.concat("place", F.lit("/"), "c").alias("path"), F.lit("does not name the object around it").alias("problem")))
        twice = lambda c: every.filter(F.col(c).isNotNull()).groupBy("doc", c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found += [told(twice("raw_id"), F.col("raw_id"), "repeated id"), told(twice("object_key"), F.col("object_key"), "repeated identity")]
        lost = self.references.filter("identity IS NULL")
        found.append(told(lost, F.concat("place", "pointer", F.coalesce(F.concat(F.lit("/"), F.col("at").cast("string")), F.lit(""))), "reference does not resolve"))
        sizes = every.filter("kind = 'foreign_key'").filter(~F.size(get(F.col("lists"), "column_ids")).eqNullSafe(F.size(get(F.col("lists"), "referenced_column_ids"))))
        found.append(told(sizes, F.col("place"), "as many columns are referenced as refer"))
        known = every.filter("kind = 'table'").select("doc", F.col("raw_id").alias("from_id"))
        homeless = self.rule("relationship").withColumn("from_id", text(get(m, "from_table_id"))).join(known, ["doc", "from_id"], "left_anti")
        found.append(told(homeless, F.concat(F.lit("/"), F.array_join("path", "/"), F.lit("/from_table_id")), "reference does not resolve"))
        top = self.rule("snapshot")
        counts = every.filter(F.col("kind").isin("data_source", "database")).groupBy("doc").pivot("kind", ["data_source", "database"]).count()
        wanted = top.select("doc").join(counts, "doc", "left").select("doc", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(k, F.lit(0)).alias("n")) for k in ("data_source", "database")))).alias("x")).filter("x.n != 1")
        found.append(told(wanted, F.concat(F.lit("/governance/"), "x.k"), "exactly one is needed"))
        found.append(told(top.filter(~get(m, "scan/scanner_contract_version").eqNullSafe(F.lit(f'"{self.contract}"'))), F.lit("/scan/scanner_contract_version"), "unsupported contract version"))
        same = {"source/name": ("data_source", "name"), "source/system_type": ("data_source", "system_type"), "source/database": ("database", "name")}
        for c, (kind, member) in same.items():
            roots = every.filter(F.col("kind") == kind)
            found.append(told(roots.filter(~get(m, member).eqNullSafe(get(ancestor(0), c))), F.lit(f"/{c}"), "envelope and model differ"))
        # A relationship and its foreign key lead to the same table.
        ends = self.references.filter("kind = 'relationship'").groupBy("doc", "object_key", "place").agg(F.max(F.when(F.col("pointer") == "/to_table_id", F.col("identity"))).alias("to_key"), F.max(F.when(F.col("pointer") == "/foreign_key_id", F.col("identity"))).alias("fk_key"))
        targets = self.references.filter("pointer = '/referenced_table_id'").select("doc", F.col("object_key").alias("fk_key"), F.col("identity").alias("target"))
        found.append(told(ends.join(targets, ["doc", "fk_key"]).filter("to_key IS NOT NULL AND target IS NOT NULL AND to_key != target"), F.concat("place", F.lit("/foreign_key_id")), "foreign key leads to another table"))
        return reduce(DataFrame.unionByName, found)


def inventory(model: Model) -> DataFrame:
    """Each table of a model as one JSON object with its columns, keys and relationships, folded level by level:
    local_id, json. Columns go by their position, all else by id."""
    json = lambda **c: F.concat(F.lit("{"), F.array_join(F.array(*(F.concat(F.lit(f'"{k}":'), c[k]) for k in sorted(c))), ","), F.lit("}"))
    string = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(json_text(F.col(c)))
    strings = lambda c: list_text(F.transform(c, json_text))
    column = json(id=string("local_id"), name=string("name"), data_type=string("data_type"), ordinal_position=F.col("ordinal_position").cast("string"), nullable=F.col("nullable").cast("string"), description=string("description"))
    columns = model.columns.select("parent_id", F.col("ordinal_position").cast("bigint").alias("at"), "local_id", column.alias("json"), F.lit("columns").alias("part"))
    primary = model.primary_keys.select("parent_id", F.lit(0).cast("bigint").alias("at"), "local_id", json(id=string("local_id"), name=string("name"), column_ids=strings("columns")).alias("json"), F.lit("primary_key").alias("part"))
    foreign = model.foreign_keys.select("parent_id", F.lit(0).cast("bigint").alias("at"), "local_id", json(id=string("local_id"), name=string("name"), column_ids=strings("columns"), referenced_column_ids=strings("to_columns"), referenced_table_id=string("to_table_id")).alias("json"), F.lit("foreign_keys").alias("part"))
    below = columns.unionByName(primary).unionByName(foreign).groupBy("parent_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "local_id", "json"))), lambda x: x["json"]).alias("all"))
    folded = below.groupBy("parent_id").agg(F.map_from_entries(F.collect_list(F.struct("part", "all"))).alias("parts"))
    part = lambda name: F.coalesce(F.try_element_at("parts", F.lit(name)), F.array().cast("array<string>"))
    table = json(id=string("local_id"), schema_id=string("schema_id"), name=string("name"), description=string("description"), owner=string("owner"), columns=list_text(part("columns")), primary_key=F.coalesce(F.get(part("primary_key"), F.lit(0)), F.lit("null")), foreign_keys=list_text(part("foreign_keys")))
    rows = model.tables.withColumnRenamed("parent_id", "schema_id").join(folded.withColumnRenamed("parent_id", "local_id"), "local_id", "left")
    return rows.select("local_id", table.alias("json"))


def write_inventory(model: Model, path: str) -> None:
    """The inventory as lines of JSON in the order of ids: range partitions, so that file after file is in order."""
    inventory(model).orderBy("local_id").select("json").write.text(path)
