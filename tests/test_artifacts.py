"""Artifacts, reports, rule documents, plans and streams."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from metaloom.operators import compare, conflicts, impact, reconcile
from metaloom.plans import plan
from metaloom.shared import shared_dir
from metaloom.sinks import artifacts, reports
from metaloom.sources import rules
from metaloom.streaming import events


def folder(spark):
    return f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"


def test_identity_does_not_depend_on_order_but_on_content(spark):
    rows = [(i, None if i % 3 else f"v{i}", {"b": "1", "a": str(i)}) for i in range(200)]
    schema = "k int, v string, m map<string,string>"
    one = artifacts.identity(spark.createDataFrame(rows, schema), "graph").first()
    two = artifacts.identity(spark.createDataFrame([(k, v, dict(reversed(m.items()))) for k, v, m in rows[::-1]], schema).repartition(7).select("m", "v", "k"), "graph").first()
    assert one == two and one["n_rows"] == 200
    others = [[*rows, rows[0]], rows[1:], [(0, "", {}), *rows[1:]], [(0, "-", {}), *rows[1:]]]
    assert len({one["digest"], *(artifacts.identity(spark.createDataFrame(r, schema), "graph").first()["digest"] for r in others)}) == 5
    assert artifacts.identity(spark.createDataFrame([], schema), "graph").first()["n_rows"] == 0


def test_separators_in_values_do_not_mix_columns(spark):
    digest = lambda a, b: artifacts.identity(spark.createDataFrame([(a, b)], "a string, b string"), "graph").first()["digest"]
    assert digest("x\x1f=y", "z") != digest("x", "y\x1f=z")


def test_artifact_round_trip(spark):
    at = folder(spark)
    artifacts.write(at, "drift_result", {"rows": spark.range(10), "empty": spark.range(0)}, {"source": "s"})
    back = artifacts.read(spark, at, "drift_result")
    assert back.names == {"source": "s"} and back.tables["rows"].count() == 10 and back.tables["empty"].count() == 0
    with pytest.raises(artifacts.ArtifactError, match="not graph"):
        artifacts.read(spark, at, "graph")
    spark.range(1).write.mode("append").parquet(f"{at}/rows")
    with pytest.raises(artifacts.ArtifactError, match="content"):
        artifacts.read(spark, at, "drift_result")
    with pytest.raises(artifacts.ArtifactError):
        artifacts.write(at, "no_such_kind", {"rows": spark.range(1)})


def test_reports(spark):
    e = spark.createDataFrame([(f"t<{i}>", "depends_on", "root") for i in range(30)], "src_key string, kind string, dst_key string")
    found = impact.downstream(e, spark.createDataFrame([("root",)], "root string"))
    text = reports.impact_text(found, shown=5)
    assert "Direct: 30" in text and "... and 25 more" in text and "Transitive: 0" in text
    page = reports.impact_html(found, "A & B", shown=3)
    assert "A &amp; B" in page and "t&lt;0&gt;" in page and "t<0" not in page
    a = spark.createDataFrame([("x",), ("y",)], "object_key string")
    p = spark.createDataFrame([("x", "/d", True, '"1"')], "object_key string, pointer string, has_value boolean, value_json string")
    none = p.limit(0)
    text = reports.comparison_text(compare.object_changes(a, a, p, none), compare.changed_properties(a, a, p, none))
    assert 'x /d: "1" -> (missing)' in text and "changed 1" in text
    assert reports.markdown_table(spark.createDataFrame([("a|b\nc", None)], "x string, y int"), ["x", "y"]).endswith("| a\\|b c |  |")


POLICY = """
policies:
  - id: owners
    severity: error
    rule: {type: require_owner, select: {kind: table, id_prefix: "tbl:a_"}}
"""


def test_rule_documents(spark):
    pytest.importorskip("yaml")
    assert rules.policies(spark, [rules.parse(POLICY)]).first()["id_prefix"] == "tbl:a_"
    for bad in (POLICY.replace("require_owner", "nonsense"), POLICY.replace("error", "loud"), POLICY + POLICY.split("policies:")[1]):
        with pytest.raises(rules.RuleError):
            rules.policies(spark, [rules.parse(bad)])
    with pytest.raises(rules.RuleError, match="repeats"):
        rules.parse("a: 1\na: 2")
    rule = {"id": "r", "select": {"kind": "table", "property": "/description"}, "authority": {"provider_type": "dbt"}}
    assert rules.authority(spark, [{"rules": [rule]}]).first()["provider_type"] == "dbt"
    with pytest.raises(rules.RuleError):
        rules.authority(spark, [{"rules": [rule, {**rule, "id": "s", "authority": {"provider_type": "odcs"}}]}])
    match = {"change": "changed", "object": {"kind": "table", "path": ["s", "d", "x", "t"]}, "property": "/description"}
    made = rules.drift_rules(spark, [{"rules": [{"id": "d", "match": match, "expected": {"candidate": {"value": "u"}, "baseline": {"present": False}}}]}]).first()
    assert (made["object_key"], made["exp_base_has"], made["exp_base_json"], made["exp_cand_json"]) == ("tbl:s/d/x/t", False, None, '"u"')
    with pytest.raises(rules.RuleError):
        rules.drift_rules(spark, [{"rules": [{"id": "d", "match": {**match, "change": "added"}}]}])


def test_changed_roots_and_mapping(spark):
    up = {"namespace": "ns", "kind": "table", "logical_id": "t", "parent": None}
    node = {"namespace": "ns", "kind": "column", "logical_id": "ü", "parent": up}
    assert rules.changed_roots(spark, {"changed_nodes": [node, node]}, "ns").collect()[0]["root"] == '["ns","column","\\u00fc",["ns","table","t",null]]'
    for bad in ([], [{**node, "parent": {**up, "namespace": "x"}}], [{"kind": "table"}]):
        with pytest.raises(rules.RuleError):
            rules.changed_roots(spark, {"changed_nodes": bad}, "ns")
    refs = {"domain_ref": "d", "asset_type_refs": {"table": "1"}, "relation_type_refs": {}, "attribute_type_refs": {"note": "<fill in>"}}
    assert {(r["ref"], r["problem"]) for r in reconcile.missing_types(rules.mapping(spark, refs), spark.createDataFrame([("d",)], "ref string")).collect()} == {("1", "unknown"), ("<fill in>", "placeholder")}


def test_rule_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"policies": []}))
    assert rules.read(spark, str(tmp_path / "a.json")) == [{"policies": []}]


ASSET = "local_id string, name string, display_name string, attributes map<string,string>"
REL = "source_id string, target_id string, type_ref string"


def sides(spark):
    desired = spark.createDataFrame([("db:d", "d", None, {}), ("tbl:t", "t", None, {"note": "n"}), ("col:c", "c", None, {"a": "1", "b": "2"}), ("tbl:u", "u", None, {})], ASSET)
    remote = spark.createDataFrame([("db:d", "d", None, {}), ("tbl:t", "t", None, {"note": "old"}), ("tbl:gone", "g", None, {})], ASSET)
    return desired, remote, spark.createDataFrame([("tbl:t", "col:c", "contains"), ("db:d", "tbl:t", "contains"), ("db:d", "tbl:u", "contains")], REL), spark.createDataFrame([("db:d", "tbl:t", "contains")], REL)


def test_plan_is_saved_checked_and_compiled(spark):
    desired, remote, drel, rrel = sides(spark)
    digests = plan.digests_of(spark, {"remote_state": remote}, {"config": "1"})
    made = plan.build(desired, remote, drel, rrel, digests)
    assert {(r["object_kind"], r["action"]): r["n_actions"] for r in plan.counts(made).collect()} == {("asset", "create"): 2, ("asset", "update"): 1, ("asset", "unchanged"): 1, ("asset", "remote_only"): 1, ("relationship", "create"): 2, ("relationship", "unchanged"): 1}
    at = folder(spark)
    plan.save(made, at)
    back = plan.load(spark, at)
    assert plan.stale(back, digests) == []
    assert plan.stale(back, plan.digests_of(spark, {"remote_state": remote.limit(1)}, {"config": "2"})) == ["config", "remote_state"]
    compiled = plan.commands(back, desired)
    got = {r["local_id"]: (r["operation"], r["position"], len(r["relations"]), r["n_characteristics"]) for r in compiled.collect()}
    assert got == {"tbl:u": ("create", 0, 1, 1), "col:c": ("create", 1, 0, 2), "tbl:t": ("update", 2, 1, 2)}
    batched = plan.batches(compiled, max_resources=2)
    assert {r["local_id"]: r["batch"] for r in batched.collect()} == {"tbl:u": 0, "col:c": 0, "tbl:t": 1}
    ids = plan.batch_identities(batched).collect()
    assert len({r["digest"] for r in ids}) == 2 and sum(r["n_commands"] for r in ids) == 3
    assert sorted(ids) == sorted(plan.batch_identities(batched.repartition(3)).collect())


def test_an_unsafe_decision_forbids_a_plan(spark):
    desired, remote, drel, rrel = sides(spark)
    target = F.struct(F.lit(True).alias("ok"), F.lit(True).alias("has_value"), F.lit("new").alias("value"))
    decisions = lambda safe, who: spark.createDataFrame([(who, "description")], "local_id string, field string").select("*", F.lit(safe).alias("safe"), F.lit(True).alias("applicable"), target.alias("target"), F.lit("x").alias("digest"))
    build = lambda d: plan.build(desired, remote, drel, rrel, plan.digests_of(spark, {}, {"config": "1"}), decisions=d, type_refs={"description": "note"})
    with pytest.raises(plan.PlanError, match="tbl:u"):
        build(decisions(False, "tbl:u"))
    build(decisions(False, "tbl:gone"))
    made = build(decisions(True, "tbl:u"))
    assert [(r["local_id"], r["overlay"]) for r in made.assumptions.collect()] == [("tbl:u", True)]
    assert plan.stale(made, made.digests, decisions(True, "tbl:u").withColumn("digest", F.lit("y"))) == ["reconciliation"]


def event(k):
    return {"eventTime": f"2024-01-0{1 + k % 3}T00:00:00Z", "producer": f"p{k % 2}", "job": {"namespace": "j", "name": str(k)}}


def test_events_land_once(spark, tmp_path):
    inbox, landed, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps([event(0), event(1), event(1)]))
    events.land(events.read_stream(spark, inbox), landed, checkpoint).awaitTermination(60)
    (tmp_path / "in/b.json").write_text(json.dumps(event(2)))
    (tmp_path / "in/c.json").write_text(json.dumps(event(1)))
    events.land(events.read_stream(spark, inbox), landed, checkpoint).awaitTermination(60)
    assert sorted(json.loads(r["event"])["job"]["name"] for r in spark.read.parquet(landed).collect()) == ["0", "1", "2"]


def test_late_events_land_whatever_the_number_of_micro_batches(spark, tmp_path):
    inbox, landed, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    for k in range(6):  # the newest first, then ever older ones, a copy of the first, and one without a time
        event = {"job": {"name": str(k % 5)}} | ({"eventTime": f"2024-0{6 - k % 5}-01T00:00:00Z"} if k % 5 != 4 else {})
        (tmp_path / f"in/{k}.json").write_text(json.dumps([event, event]))
        os.utime(tmp_path / f"in/{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    events.land(events.read_stream(spark, inbox, files_per_trigger=1), landed, checkpoint).awaitTermination(120)
    got = spark.read.parquet(landed)
    assert sorted(json.loads(r["event"])["job"]["name"] for r in got.collect()) == ["0", "1", "2", "3", "4"]
    assert set(got.columns) >= {"event", "digest", "event_time"}


def test_a_micro_batch_that_runs_again_lands_its_events_once(spark, tmp_path):
    inbox, landed = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps([event(k) for k in range(3)]))
    for checkpoint in ("check", "check", "other"):
        events.land(events.read_stream(spark, inbox), landed, str(tmp_path / checkpoint)).awaitTermination(120)
        for noted in (tmp_path / checkpoint / "commits").glob("*0*"):  # as after a failure before the end of batch 0
            noted.unlink()
    assert sorted(json.loads(r["event"])["job"]["name"] for r in spark.read.parquet(landed).collect()) == ["0", "1", "2"]


def test_a_folder_of_a_streaming_sink_is_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out/_spark_metadata").mkdir(parents=True)
    with pytest.raises(ValueError, match="new folder"):
        events.land(events.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))


def test_events_are_counted_in_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps([event(k) for k in range(6)]))
    out = f"counts_{uuid.uuid4().hex}"
    events.counts(events.read_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(out).outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    assert {(r["window"]["start"].day, r["producer"]): r["n_events"] for r in spark.table(out).collect()} == {(1, "p0"): 1, (1, "p1"): 1, (2, "p0"): 1, (2, "p1"): 1, (3, "p0"): 1, (3, "p1"): 1}


def test_observations_are_folded(spark, tmp_path):
    p = F.array(F.struct(F.col("ref").alias("provider_type"), F.col("ref").alias("source_ref"), F.lit(None).cast("string").alias("source_version"), F.lit("observed").alias("observation_mode")))
    shape = lambda df: df.select(F.col("k").alias("object_key"), F.lit("ns").alias("namespace"), F.lit("table").alias("kind"), F.lit("/d").alias("pointer"), F.col("v").alias("value_json"), p.alias("provenance"))
    source, state, checkpoint = (str(tmp_path / x) for x in ("in", "state", "check"))
    schema = "k string, v string, ref string"
    parts = [[("a", "1", "x"), ("b", "1", "x")], [("a", "1", "y"), ("c", "2", "x")], [("a", "2", "x"), ("a", "1", "x")]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        events.fold_observations(shape(spark.readStream.schema(schema).parquet(source)), state, checkpoint, buckets=4).awaitTermination(120)
    want = conflicts.normalize(shape(spark.createDataFrame([r for part in parts for r in part], schema)))
    got = events.latest(spark, state).drop("bucket")
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())
