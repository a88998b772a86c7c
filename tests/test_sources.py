"""Readers on small documents written by the tests."""

import json

import pytest
from pyspark.sql import functions as F

from metaloom.functions import canonical
from metaloom.operators import graph, impact
from metaloom.sources import base, catalog, dbt, odcs, openlineage, registry, snapshot

MANIFEST = {
    "metadata": {"dbt_version": "1.8"},
    "nodes": {
        "model.p.totals": {"resource_type": "model", "name": "totals", "package_name": "p", "database": "db", "schema": "s", "alias": "order_totals", "fqn": ["p", "totals"], "config": {"materialized": "table"}, "columns": {"id": {"name": "id", "data_type": "int", "tags": ["b", "a", "a"]}}, "description": "Sums"},
        "model.p.eph": {"resource_type": "model", "name": "eph", "package_name": "p", "schema": "s", "alias": "eph", "fqn": ["p", "eph"], "config": {"materialized": "ephemeral"}, "columns": {}, "description": " "},
        "test.p.t": {"resource_type": "test", "name": "t"},
    },
    "sources": {"source.p.raw.orders": {"resource_type": "source", "name": "orders", "source_name": "raw", "package_name": "p", "database": "db", "schema": "raw", "identifier": "orders", "columns": {}}},
    "parent_map": {"model.p.totals": ["model.p.eph", "macro.x", "model.p.off"], "model.p.eph": ["source.p.raw.orders"]},
    "disabled": {"model.p.off": []},
}


def texts(spark, *documents):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in documents], "text string")


def names(df):
    return {(r["kind"], r["name"]) for r in df.collect()}


def test_manifest(spark):
    m = base.checked(dbt.map_manifests(texts(spark, MANIFEST), "ns"))
    assert names(m.nodes) == {("data_source", "db"), ("dataset", "s"), ("dataset", "raw"), ("table", "order_totals"), ("table", "orders"), ("transformation", "eph"), ("column", "id")}
    assert graph.problems(graph.Graph(m.nodes, graph.merge_edges(m.edges))).count() == 0
    key = {r["name"]: r["node_key"] for r in m.nodes.collect()}
    assert key["eph"] == '["ns","transformation","[\\"p\\",[\\"p\\",\\"eph\\"]]",null]'
    found = impact.downstream(m.edges, spark.createDataFrame([(key["orders"],)], "root string"))
    assert {r["target"]: r["distance"] for r in found.targets.collect()} == {key["eph"]: 1, key["order_totals"]: 2, key["id"]: 3}
    seen = {(r["object_key"], r["pointer"]): r["value_json"] for r in m.observations.collect()}
    assert seen[key["id"], "/attributes/tags"] == '["a","b"]' and seen[key["order_totals"], "/description"] == '"Sums"'
    assert (key["eph"], "/description") not in seen and (key["db"], "/name") not in seen


def test_manifest_problems(spark):
    bad = json.loads(json.dumps(MANIFEST))
    bad["nodes"]["model.p.totals"]["database"] = " "
    bad["parent_map"]["model.p.eph"].append("model.p.gone")
    found = dbt.map_manifests(texts(spark, bad), "ns").problems.collect()
    assert {r["path"] for r in found} == {"/model.p.totals/database", "/parent_map/model.p.eph"}
    with pytest.raises(base.MappingError):
        base.checked(dbt.map_manifests(texts(spark, bad), "ns"))
    assert {r["path"] for r in dbt.map_manifests(texts(spark, bad), "ns", "fallback").problems.collect()} == {"/parent_map/model.p.eph"}


CONTRACT = {
    "id": "c1", "version": "2.0", "name": " Orders ", "status": "active", "description": {"purpose": "sell"},
    "schema": [{"name": "orders", "properties": [{"name": "id", "logicalType": "integer", "primaryKey": True}, {"id": "addr", "name": "address", "properties": [{"name": "city", "tags": ["z", "a"]}]}, {"name": "lines", "items": {"items": {"properties": [{"name": "sku"}]}}}]}],
}


def test_contract(spark):
    m = base.checked(odcs.map_contracts(texts(spark, CONTRACT), "ns"))
    assert names(m.nodes) == {("contract", "Orders"), ("dataset", "orders"), *(("column", c) for c in ("id", "address", "city", "lines", "sku"))}
    parent = {r["name"]: r["parent_key"] for r in m.nodes.collect()}
    key = {r["name"]: r["node_key"] for r in m.nodes.collect()}
    assert parent["city"] == key["address"] and parent["sku"] == key["lines"] and parent["id"] == key["orders"]
    assert sorted(r["kind"] for r in m.edges.collect()) == ["contains"] * 5 + ["governs"]
    assert odcs.map_contracts(texts(spark, {"version": "1"}), "ns").problems.count() == 1


def test_items_are_followed_to_their_end(spark):
    below = {"properties": [{"name": "deep"}]}
    for _ in range(6):
        below = {"items": below}
    m = base.checked(odcs.map_contracts(texts(spark, {"id": "c", "version": "1", "tenant": " ACME ß ", "schema": [{"name": "d", "properties": [{"name": "lists", **below}]}]}), "ns"))
    assert names(m.nodes) == {("contract", "c"), ("dataset", "d"), ("column", "lists"), ("column", "deep")}
    assert [r["value_json"] for r in m.observations.filter("pointer = '/attributes/tenant'").collect()] == ['"acme ss"']


def event(run, job, inputs, outputs, **more):
    return {"eventTime": "2024-01-01T00:00:00Z", "producer": "p", "schemaURL": "u", "run": {"runId": run}, "job": {"namespace": "j", "name": job}, "inputs": inputs, "outputs": outputs, **more}


RUN = "00000000-0000-0000-0000-00000000000"


def test_lineage_events(spark):
    a, b = {"namespace": "n", "name": "a"}, {"namespace": "n", "name": "b"}
    levels = [{"type": "DATABASE", "name": "db"}, {"type": "SCHEMA", "name": "s"}, {"type": "TABLE", "name": "t"}]
    facets = {"schema": {"_producer": "q", "fields": [{"name": "x", "type": "int", "fields": [{"name": "deep"}]}]}, "hierarchy": {"_producer": "q", "hierarchy": levels}, "storage": {"_producer": "q", "storageLayer": "delta"}, "columnLineage": {"_producer": "q", "fields": {"y": {"inputFields": [{**a, "field": "k"}]}}}}
    events = [event(RUN + "1", "one", [a], []), event(RUN + "1", "one", [], [{**b, "facets": facets}]), event(RUN + "2", "two", [a], [])]
    for order in (events, events[::-1]):
        m = base.checked(openlineage.map_events(spark.createDataFrame([(json.dumps(e),) for e in order], "event string"), "ns"))
        assert names(m.nodes) == {("data_source", "db"), ("dataset", "s"), ("table", "t"), ("dataset", "a"), *(("column", c) for c in ("x", "deep", "y", "k"))}
        key = {r["name"]: r["node_key"] for r in m.nodes.collect()}
        assert {(r["src_key"], r["dst_key"]) for r in m.edges.filter("kind = 'depends_on'").collect()} == {(key["t"], key["a"]), (key["y"], key["k"])}
        assert key["a"] == '["ns","dataset","[\\"n\\",\\"a\\"]",null]'
        seen = {(r["object_key"], r["pointer"]): [p["source_ref"] for p in r["provenance"]] for r in m.observations.collect()}
        assert seen[key["t"], "/attributes/storage_layer"] == ["q"] and seen[key["t"], "/name"] == ["p", "q"]


def test_lineage_problems(spark):
    rows = [event("no", "one", [], []), event(RUN + "1", "one", [], []), event(RUN + "1", "two", [], []), {**event(RUN + "2", "x", [], []), "eventTime": "2024-01-01"}]
    found = openlineage.map_events(spark.createDataFrame([(json.dumps(e),) for e in rows], "event string"), "ns").problems
    assert sorted(r["message"] for r in found.collect()) == ["eventTime must be a time with a zone", "run events disagree on their job", "runId must be a UUID"]


def catalog_rows(spark):
    return catalog.Rows(
        spark.createDataFrame([("shop", "me", None)], "database_name string, owner_name string, description string"),
        spark.createDataFrame([("sales", "me", None), ("pg_catalog", "x", None), ("information_schema", "x", None)], "schema_name string, owner_name string, description string"),
        spark.createDataFrame([("sales", "orders", "me", "d", "id", 1, "int", False, None), ("sales", "orders", "me", "d", "who", 2, "int", True, "c"), ("sales", "people", "me", None, "id", 1, "int", False, None), ("pg_toast", "t", "x", None, "c", 1, "int", True, None)], "schema_name string, table_name string, table_owner string, table_description string, column_name string, ordinal_position int, data_type string, nullable boolean, column_description string"),
        spark.createDataFrame([("sales", "orders", "pk", "id", 1)], "schema_name string, table_name string, constraint_name string, column_name string, key_ordinal bigint"),
        spark.createDataFrame([("sales", "orders", "fk", "who", 1, "sales", "people", "id"), ("sales", "orders", "gone", "who", 1, "sales", "people", "nope")], "schema_name string, table_name string, constraint_name string, column_name string, key_ordinal bigint, referenced_schema_name string, referenced_table_name string, referenced_column_name string"),
    )


def test_catalog_model(spark):
    m = catalog.build_model(catalog_rows(spark), "src")
    assert {r["kind"]: r["n_objects"] for r in catalog.summary(m).collect()} == {"database": 1, "schema": 1, "table": 2, "column": 3, "primary_key": 1, "foreign_key": 1}
    assert m.problems.count() == 0 and [r["name"] for r in m.foreign_keys.collect()] == ["fk"]
    assert m.tables.filter("name = 'orders'").first()["local_id"] == "tbl:src/shop/sales/orders"
    assert {r["type_ref"] for r in catalog.desired_relationships(m).collect()} == {"contains", "references"}
    assets = {r["local_id"]: r for r in catalog.desired_assets(m, {"description": "d", "owner": "o", "data_type": "t"}).collect()}
    assert assets["col:src/shop/sales/orders/who"]["attributes"] == {"d": "c", "t": "int"}
    objects, properties = catalog.snapshot(m)
    assert objects.count() == 9 and properties.filter("pointer = '/nullable'").count() == 3
    for data in ([], [("a", "me", None), ("b", "me", None)]):
        with pytest.raises(ValueError, match="one database"):
            catalog.build_model(catalog_rows(spark)._replace(database=spark.createDataFrame(data, "database_name string, owner_name string, description string")), "src")
    index = {r["local_id"]: r["node_key"] for r in catalog.physical_index(m, "ns").collect()}
    assert index["col:src/shop/sales/people/id"] == '["ns","column","id",["ns","table","people",["ns","dataset","sales",["ns","data_source","shop",null]]]]'
    assert catalog.unfit_properties(objects, properties).count() == 0
    lost = catalog.build_model(catalog_rows(spark)._replace(primary_keys=spark.createDataFrame([("sales", "orders", "pk", "nope", 1)], "schema_name string, table_name string, constraint_name string, column_name string, key_ordinal bigint")), "src")
    assert lost.problems.count() == 1


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": 1.0, "a": "é"}',), ("[true, 1]",), (None,)], "t string")
    assert [r[0] for r in df.select(canonical.canonical_json("t")).collect()] == ['{"a":"\\u00e9","b":1.0}', "[true,1]", None]
    bad = spark.createDataFrame([("NaN",), ('{"a":1,"a":2}',), ("[" * 70 + "]" * 70,), ("{}",)], "t string")
    assert [r[0] is None for r in bad.select(canonical.json_problem("t")).collect()] == [False, False, False, True]


def test_any_text_as_a_json_string(spark):
    rows = ["", 'a"b\\c', "é€😀", "\x01\x1f\x7f\n\t\b\f\r", "plain", "a$1/", None]
    got = spark.createDataFrame([(x,) for x in rows], "t string").select("t", canonical.escaped(F.col("t"))).collect()
    assert {a: b for a, b in got} == {x: None if x is None else json.dumps(x) for x in rows}


def test_pointers(spark):
    df = spark.createDataFrame([("a/b~c",)], "t string")
    p = canonical.pointer(F.col("t"), F.lit("x"))
    assert df.select(p, canonical.tokens(p), canonical.is_pointer(p)).first()[:] == ("/a~1b~0c/x", ["a/b~c", "x"], True)


def test_registry_runs_sources_as_one(spark, tmp_path):
    known = registry.builtin()
    assert known.only("lineage").name == "openlineage"
    assert [p.name for p in known.with_capability("governance_graph")] == ["dbt", "odcs", "openlineage"]
    for bad in (lambda: known.add(known.get("dbt")), lambda: known.get("x"), lambda: known.only("remote_state_read"), lambda: known.add(registry.Provider("y", frozenset({"fly"}), None)), lambda: registry.run(spark, [])):
        with pytest.raises(registry.ProviderError):
            bad()
    (tmp_path / "m.json").write_text(json.dumps(MANIFEST))
    (tmp_path / "e.json").write_text(json.dumps([event(RUN + "1", "one", [{"namespace": "n", "name": "a"}], [{"namespace": "n", "name": "b"}])]))
    jobs = [registry.Job("openlineage", str(tmp_path / "e.json"), "ns"), registry.Job("dbt", str(tmp_path / "m.json"), "ns")]
    m = base.checked(registry.run(spark, jobs))
    assert {("dataset", "a"), ("dataset", "b"), ("table", "order_totals")} <= names(m.nodes)
    assert m.edges.filter("kind = 'depends_on'").count() == 3
    assert m.observations.filter("pointer = '/name'").count() == 6


SNAPSHOT = {
    "source": {"name": "src", "database": "shop", "system_type": "postgresql"}, "scan": {"scanner": "p", "scanner_contract_version": "1"},
    "governance": {"data_sources": [{"id": "ds", "name": "src", "system_type": "postgresql", "databases": [{"id": "db", "name": "shop", "datasource_id": "ds", "schemas": [{"id": "s", "name": "a/b", "database_id": "db", "tables": [
        {"id": "t", "name": "x~y", "schema_id": "s", "technical_attributes": {"k/l": [1]}, "ownership": {"owner_name": "me"}, "primary_key": {"id": "pk", "name": "pk", "table_id": "t", "column_ids": ["c2", "c1"]}, "foreign_keys": [],
         "columns": [{"id": "c1", "name": "é\"", "data_type": "int", "ordinal_position": 1, "nullable": False}, {"id": "c2", "name": "b", "data_type": "int", "ordinal_position": 2, "nullable": True, "technical_attributes": {"deep": {"z": 1}}}]},
        {"id": "u", "name": "u", "schema_id": "s", "foreign_keys": [{"id": "fk", "name": "fk", "table_id": "u", "column_ids": ["c3"], "referenced_table_id": "t", "referenced_column_ids": ["c1"]}], "columns": [{"id": "c3", "name": "c", "data_type": "int", "ordinal_position": 1, "nullable": True}]}]}]}]}],
        "relationships": [{"id": "r", "name": "r", "from_table_id": "u", "to_table_id": "t", "foreign_key_id": "fk"}]},
}


def test_snapshot_references_are_identities(spark):
    s = snapshot.Snapshots(texts(spark, SNAPSHOT))
    assert s.problems().count() == 0
    name = lambda kind, *path: json.dumps({"kind": kind, "path": path}, separators=(",", ":"))
    seen = {(r["object_key"], r["pointer"]): json.loads(r["value_json"]) for r in s.properties().collect()}
    table = name("table", "a/b", "x~y")
    assert seen[name("primary_key", "a/b", "x~y", "pk"), "/column_ids"] == [{"kind": "column", "path": ["a/b", "x~y", "b"]}, {"kind": "column", "path": ["a/b", "x~y", 'é"']}]
    assert seen[name("foreign_key", "a/b", "u", "fk"), "/referenced_table_id"] == json.loads(table)
    assert seen[name("relationship", "a/b", "u", "r"), "/foreign_key_id"] == json.loads(name("foreign_key", "a/b", "u", "fk"))
    assert seen[table, "/technical_attributes/k~1l"] == [1] and seen[name("column", "a/b", "x~y", "b"), "/technical_attributes/deep"] == {"z": 1}
    assert seen[table, "/ownership"] == {"owner_name": "me"} and seen[name("data_source"), "/system_type"] == "postgresql"
    assert {r["object_key"]: r["parent_key"] for r in s.objects.collect()}[name("schema", "a/b")] == name("database")


def test_snapshot_faults_are_rows(spark):
    def bad(change):
        document = json.loads(json.dumps(SNAPSHOT))
        change(document, document["governance"]["data_sources"][0]["databases"][0]["schemas"][0])
        return document

    changes = {
        "reference does not resolve": [lambda d, s: s["tables"][0]["primary_key"].update(column_ids=["c3"]), lambda d, s: s["tables"][1]["foreign_keys"][0].update(referenced_table_id="zz"), lambda d, s: d["governance"]["relationships"][0].update(from_table_id="zz")],
        "repeated id": [lambda d, s: s["tables"][1]["columns"][0].update(id="u")],
        "repeated identity": [lambda d, s: s["tables"][0]["columns"][1].update(name='é"')],
        "does not name the object around it": [lambda d, s: s.update(database_id="x")],
        "value of another type": [lambda d, s: s["tables"][0]["columns"][0].update(ordinal_position=0), lambda d, s: s["tables"][0].update(description=5), lambda d, s: s.pop("name")],
        "exactly one is needed": [lambda d, s: d["governance"]["data_sources"][0]["databases"].append({"id": "o", "name": "shop", "datasource_id": "ds", "schemas": []})],
        "envelope and model differ": [lambda d, s: d["source"].update(system_type="other")],
        "unsupported contract version": [lambda d, s: d["scan"].update(scanner_contract_version=1)],
        "as many columns are referenced as refer": [lambda d, s: s["tables"][1]["foreign_keys"][0].update(referenced_column_ids=["c1", "c2"])],
        "foreign key leads to another table": [lambda d, s: d["governance"]["relationships"][0].update(to_table_id="u")],
    }
    rows = [(why, json.dumps(bad(change))) for why, each in changes.items() for change in each]
    df = spark.createDataFrame(rows, "why string, text string").withColumn("doc", F.sha2("text", 256))
    found = {}
    for r in snapshot.Snapshots(df.select("text").unionByName(texts(spark, "[", '{"a":1,"a":2}'))).problems().collect():
        found.setdefault(r["doc"], set()).add(r["problem"])
    for r in df.collect():
        assert r["why"] in found.pop(r["doc"]), r["why"]
    assert len(found) == 2 and {"a JSON object repeats a key"} in found.values()


def test_inventory_in_order(spark, tmp_path):
    snapshot.write_inventory(catalog.build_model(catalog_rows(spark), "src"), str(tmp_path / "lines"))
    got = [json.loads(line) for f in sorted((tmp_path / "lines").glob("part-*")) for line in f.read_text().splitlines()]
    assert [t["id"] for t in got] == ["tbl:src/shop/sales/orders", "tbl:src/shop/sales/people"]
    assert [c["name"] for c in got[0]["columns"]] == ["id", "who"] and got[0]["foreign_keys"][0]["referenced_table_id"] == "tbl:src/shop/sales/people" and got[1]["primary_key"] is None


def test_deleted_facets_are_problems_however_they_are_written(spark):
    facets = {"storage": {"_producer": "q", "storageLayer": "x", "_deleted": True}, "datasetType": {"_producer": "q", "_deleted": 1, "datasetType": "T"}, "ownership": {"_producer": "q"}, "own": {"_deleted": True}}
    one = json.dumps(event(RUN + "1", "one", [], [{"namespace": "n", "name": "_deleted", "facets": facets}]), indent=2)
    found = openlineage.map_events(spark.createDataFrame([(one,)], "event string"), "ns").problems.collect()
    assert {(r["path"].split("/")[-1], r["message"]) for r in found} == {("storage", "deletions are not supported"), ("datasetType", "_deleted must be a boolean"), ("ownership", "owners is required")}
