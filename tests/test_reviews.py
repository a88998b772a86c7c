"""Review results, sides of comparisons, steps of runs, claims of histories, formats, providers, one state of a catalog."""

import hashlib
import json

import pytest
from conftest import SF
from pyspark.sql import functions as F

from metaloom import catalog_reviews
from metaloom.functions.canonical import PREFIXES, dumps
from metaloom.operators import compare, reconcile
from metaloom.sinks import histories
from metaloom.sources import base, catalog, dbt, formats, odcs, openlineage, registry, review


def identity(kind, value):
    return {"algorithm": "sha256", "hashing_contract_version": "1", "digest": hashlib.sha256((PREFIXES[kind] + dumps(value)).encode()).hexdigest()}


def sealed(r):
    r = {k: v for k, v in r.items() if k != "content_identity"}
    return r | {"content_identity": identity("ci_review", r)}


def good():
    some = identity("snapshot", {})
    states = ["AGREEMENT", "UNRESOLVED_CONFLICT"]
    report = {"conflict_schema": "governance-property-conflicts", "conflict_version": "1", "results": [{"object": {"kind": "table", "path": ["é", str(i)]}, "property": "/name", "state": s} for i, s in enumerate(states)]}
    assessments = [{"object": r["object"], "property": "/name", "applicable": i == 0, "safe": i == 0, "reason": "x"} for i, r in enumerate(report["results"])]
    summary = {"properties_analyzed": 2, "single_observation": 0, "agreement": 1, "resolved_by_authority": 0, "unresolved_conflict": 1, "invalid_or_ambiguous_authority": 0, "reconciliation_safe": 1, "reconciliation_blocked": 0, "reconciliation_not_applicable": 1}
    conflicts = {"status": "findings", "observations_content_identity": some, "authority_content_identity": some, "conflict_report_content_identity": identity("property_conflicts", report), "summary": summary, "conflict_report": report, "reconciliation_assessments": assessments}
    drift = {"status": "no_difference", "baseline_snapshot_identity": some, "candidate_snapshot_identity": some, "comparison_content_identity": some, "drift_policy_identity": None, "drift_result_content_identity": some, "summary": {"affected_objects": 0, "expected_differences": 0, "property_drift": 0, "unexpected_drift": 0}}
    return sealed({"conflicts": conflicts, "drift": drift, "review_schema": "governance-ci-review-result", "review_version": "1", "status": "passed", "writes_performed": 0})


def changed(path, value):
    r = json.loads(json.dumps(good()))
    at = r
    *above, last = path
    for k in above:
        at = at[k]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return r if path[0] == "content_identity" else sealed(r)


CASES = [
    (("review_schema",), "other", "/review_schema"),
    (("review_version",), 1, "/review_version"),
    (("content_identity",), ..., "/content_identity"),
    (("content_identity", "digest"), "0" * 64, "/content_identity"),
    (("status",), "blocked", "/status"),
    (("writes_performed",), 1, "/writes_performed"),
    (("conflicts",), ..., "/conflicts"),
    (("conflicts", "authority_content_identity"), None, "/conflicts/authority_content_identity"),
    (("conflicts", "summary", "agreement"), 2, "/conflicts/summary/agreement"),
    (("conflicts", "summary", "agreement"), "1", "/conflicts/summary/agreement"),
    (("conflicts", "summary"), None, "/conflicts/summary"),
    (("conflicts", "conflict_report"), [], "/conflicts/conflict_report"),
    (("conflicts", "conflict_report", "conflict_version"), "2", "/conflicts/conflict_report/conflict_version"),
    (("conflicts", "conflict_report", "results", 0, "state"), "ELSE", "/conflicts/conflict_report/results/0/state"),
    (("conflicts", "reconciliation_assessments", 1), ..., "/conflicts/reconciliation_assessments"),
    (("conflicts", "reconciliation_assessments", 1, "object"), {}, "/conflicts/reconciliation_assessments/1/object"),
    (("conflicts", "reconciliation_assessments", 1, "safe"), "no", "/conflicts/reconciliation_assessments/1/safe"),
    (("conflicts", "status"), "clear", "/conflicts/status"),
    (("conflicts", "status"), "not_run", "/conflicts"),
    (("drift", "status"), "not_run", "/drift/summary"),
    (("drift", "status"), "else", "/drift/status"),
    (("drift", "status"), "expected_difference", "/drift/drift_policy_identity"),
    (("drift", "summary", "property_drift"), 1, "/drift/summary"),
    (("drift", "summary", "property_drift"), -1, "/drift/summary"),
    (("drift", "comparison_content_identity"), None, "/drift/comparison_content_identity"),
]


def test_faults_of_reviews(spark):
    texts = [json.dumps(good(), indent=1)] + [json.dumps(changed(path, value)) for path, value, _ in CASES] + ["{", '{"status":"passed","status":"passed"}', None, "[]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    doc = rows.filter("text IS NOT NULL").select("i", F.sha2(F.col("text").cast("binary"), 256).alias("doc"))
    found = {}
    for r in review.Reviews(rows).problems().join(doc, "doc").collect():
        found.setdefault(r["i"], set()).add(r["path"])
    assert 0 not in found
    for i, (path, _, told) in enumerate(CASES, 1):
        assert told in found[i], (path, found.get(i))
    assert found[len(CASES) + 1] == found[len(CASES) + 2] == {"/"} and "/review_schema" in found[len(CASES) + 4]


def test_load_reviews(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(good()))
    loaded = review.load(spark, str(tmp_path))
    row = loaded.reviews.first()
    assert (row["status"], row["conflict_status"], row["n_results"]) == ("passed", "findings", 2)
    assert [(r["state"], r["safe"]) for r in loaded.properties.orderBy("position").collect()] == [("AGREEMENT", True), ("UNRESOLVED_CONFLICT", False)]
    formats.register(spark)
    assert review.Reviews(spark.read.format("metaloom_review").load(str(tmp_path))).problems().isEmpty()
    (tmp_path / "b.json").write_text(json.dumps(changed(("status",), "blocked")))
    with pytest.raises(base.MappingError, match="/status"):
        review.load(spark, str(tmp_path))


def test_reviews_of_the_query_are_canonical(spark):
    for (text,) in catalog_reviews.reviews(spark, SF).take(20):
        assert dumps(json.loads(text)) == text


def test_sides_of_comparisons_with_names_that_need_escapes(spark):
    side = "struct<system_type:string,scanner:string,scanner_contract_version:string,source:string,database:string>"
    pair = "struct<baseline:string,candidate:string>"
    one = ("postgres", "s", "1", 'a"/~', "d")
    rows = spark.createDataFrame([(1, one, (*one[:3], "é", "d"), ('a"/~', "é"), None), (2, one, one, None, None), (3, one, (None, *one[1:]), None, None)], f"comparison int, baseline {side}, candidate {side}, aligned_source {pair}, aligned_database {pair}")
    renamed = spark.createDataFrame([(1, "data_source", True, json.dumps('a"/~'), True, json.dumps("é")), (2, "table", True, '"x"', True, '"y"')], "comparison int, kind string, base_has boolean, base_json string, cand_has boolean, cand_json string")
    assert [tuple(r) for r in compare.metadata_problems(rows, renamed).collect()] == [(3, "/candidate/system_type", "must be that of the baseline")]
    twice = renamed.unionByName(renamed)
    assert compare.metadata_problems(rows.filter("comparison = 1"), twice).first()["problem"].endswith("is not what the sides say")
    assert compare.metadata_problems(rows.limit(0), renamed).isEmpty()


def test_steps_that_state_two_identities(spark):
    stated = [(1, s, n, "x") for n, steps in reconcile.AGREEING.items() for s in steps]
    frame = lambda rows: spark.createDataFrame(rows, "run int, step string, name string, digest string")
    assert reconcile.disagreements(frame(stated)).isEmpty()
    assert [r["name"] for r in reconcile.disagreements(frame([*stated, (1, "plan", "policy", "y")])).collect()] == ["policy"]
    assert reconcile.disagreements(frame([(2, "plan", "config", None)])).count() == 3


# --- two writers of a history ----------------------------------------------------------------------------------


def entry(spark, i):
    return spark.createDataFrame([(i, "none")], "entry_index int, context string"), {"snapshot": spark.createDataFrame([("a", "/name", str(i), i)], "object_key string, pointer string, value_json string, entry_index int")}


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "h")
    histories.append(folder, *entry(spark, 0))
    last = histories.last_link(spark, folder)
    # The second writer looks before the first one has written its index.
    looked = iter([last, last])
    monkeypatch.setattr(histories, "last_link", lambda *_: next(looked))
    histories.append(folder, *entry(spark, 1), follows=last)
    with pytest.raises(histories.HistoryError, match="added since"):
        histories.append(folder, *entry(spark, 2), follows=last)
    monkeypatch.undo()
    assert {r["entry_index"] for r in spark.read.parquet(f"{folder}/index").collect()} == {0, 1}
    with pytest.raises(histories.HistoryError, match="added since"):
        histories.append(folder, *entry(spark, 3))


def test_the_place_of_a_writer_that_died(spark, tmp_path):
    folder = str(tmp_path / "h")
    histories._claim(spark, folder, None)
    with pytest.raises(histories.HistoryError):
        histories.append(folder, *entry(spark, 0))
    histories.release(spark, folder, None)
    histories.append(folder, *entry(spark, 0))
    assert histories.read(spark, folder).entries.count() == 1
    with pytest.raises(histories.HistoryError, match="an entry at that place"):
        histories.release(spark, folder, None)


# --- formats and providers -------------------------------------------------------------------------------------


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", ["dbt", "odcs", "openlineage"])
def test_formats_give_what_readers_give(spark, tmp_path, name):
    event = {"eventTime": "2024-01-01T00:00:00Z", "producer": "p", "schemaURL": "u", "run": {"runId": "6f9619ff-8b86-d011-b42d-00c04fc964ff"}, "job": {"namespace": "n", "name": "j"}, "inputs": [{"namespace": "n", "name": "a"}], "outputs": [{"namespace": "n", "name": "b"}]}
    manifest = {"metadata": {"dbt_version": "1"}, "sources": {}, "nodes": {"model.p.m": {"resource_type": "model", "name": "m", "package_name": "p", "fqn": ["p", "m"], "database": "d", "schema": "s", "alias": "m", "columns": {"c": {"name": "c"}}}}, "parent_map": {"model.p.m": []}}
    contract = {"id": "x", "version": "1", "schema": [{"name": "t", "properties": [{"name": "c", "logicalType": "string"}]}]}
    if name == "odcs":
        import yaml

        for i in range(3):
            (tmp_path / f"c{i}.yaml").write_text(yaml.safe_dump(contract | {"id": f"x{i}"}))
        plain, mapping = odcs.read_contracts(spark, str(tmp_path)), odcs.map_contracts
    elif name == "dbt":
        (tmp_path / "m.json").write_text(json.dumps(manifest))
        plain, mapping = dbt.read_manifests(spark, str(tmp_path)), dbt.map_manifests
    else:
        (tmp_path / "e.json").write_text(json.dumps([event, event | {"eventTime": "2024-01-02T00:00:00Z"}]))
        (tmp_path / "again.json").write_text(json.dumps(event))
        plain, mapping = openlineage.read_events(spark, str(tmp_path)), openlineage.map_events
    formats.register(spark)
    flat = spark.read.format(f"metaloom_{name}").option("partitionBytes", "1").load(str(tmp_path))
    a, b = mapping(plain, "ns"), mapping(flat, "ns")
    assert a.nodes.count() > 0
    for part in ("nodes", "edges", "observations", "problems"):
        assert rows_of(getattr(a, part)) == rows_of(getattr(b, part)), part


def test_formats_refuse_and_deal_files(spark, tmp_path):
    formats.register(spark)
    for i in range(4):
        (tmp_path / f"{i}.json").write_text(json.dumps({"nodes": {}, "metadata": {"dbt_version": str(i)}}))
    reader = lambda **o: formats.Reader("metaloom_dbt", {"path": str(tmp_path)} | o)
    assert len(reader().partitions()) == 1 and len(reader(partitionBytes="1").partitions()) == 4
    assert spark.read.format("metaloom_dbt").load(str(tmp_path)).filter("rule = 'manifest'").count() == 4
    (tmp_path / "x.txt").write_text("")
    with pytest.raises(ValueError, match="unsupported file"):
        reader().partitions()


class Point:
    def __init__(self, name, value, made):
        self.name, self.value, self.made = name, value, made

    def load(self):
        if isinstance(self.made, Exception):
            raise self.made
        return self.made


def test_providers_of_installed_packages(spark):
    own = registry.Provider("own", frozenset({"lineage"}), lambda *a, **o: None)
    found = registry.discover(registry.builtin(), [Point("own", "p:own", lambda: own)])
    assert [p.name for p in found.with_capability("lineage")] == ["openlineage", "own"]
    assert "own" not in registry.builtin().providers
    for points in ([Point("own", "p", own), Point("own", "q", own)], [Point("other", "p", own)], [Point("own", "p", ImportError())], [Point("dbt", "p", registry.builtin().get("dbt"))], [Point("own", "p", 3)]):
        with pytest.raises(registry.ProviderError):
            registry.discover(registry.builtin(), points)


# --- one state of a catalog ------------------------------------------------------------------------------------


class Connection:
    """Stands in for a JDBC connection and tells what it was asked."""

    def __init__(self, name="00000003-0000001B-1"):
        self.name, self.asked = name, []

    def __getattr__(self, what):
        return lambda *args: self.asked.append((what, *args))

    def createStatement(self):
        return self

    def executeQuery(self, sql):
        self.asked.append(("executeQuery", sql))
        return self

    def next(self):
        return self.name is not None

    def getString(self, _):
        return self.name


def test_all_reads_join_one_snapshot(spark):
    c = Connection()
    known = catalog_system(spark)

    def read(_, url, *, snapshot, **options):
        assert ("close",) not in c.asked and (url, snapshot, options) == ("jdbc:x", "00000003-0000001B-1", {"user": "u"})
        return known

    rows = catalog.read_rows(spark, "jdbc:x", connect=lambda *_: c, read=read, user="u")
    assert [a[0] for a in c.asked] == ["setAutoCommit", "execute", "execute", "executeQuery", "rollback", "close"]
    assert c.asked[0] == ("setAutoCommit", False) and "REPEATABLE READ READ ONLY" in c.asked[1][1]
    assert rows.database.first()["database_name"] == "db"
    for bad in (Connection("x'; drop"), Connection(None)):
        with pytest.raises(catalog.CatalogError):
            catalog.read_rows(spark, "jdbc:x", connect=lambda *_, c=bad: c, read=read)
        assert bad.asked[-1] == ("close",)


def catalog_system(spark):
    from metaloom import catalog_sources

    t = catalog_sources.system_tables(spark, SF)
    return t | {"databases": t["databases"].withColumn("datname", F.when(F.col("here"), "db").otherwise(F.col("datname")))}


def test_readers_outside_the_snapshot_are_told(spark):
    assert "tx_isolation" in catalog._with_proof(catalog.SYSTEM["databases"]) and catalog._with_proof(catalog.SYSTEM["databases"]).count(" from ") == 1
    rows = lambda level: catalog._proven(spark.createDataFrame([(1, "a", level, "on")], "oid int, name string, tx_isolation string, tx_read_only string"))
    assert rows("repeatable read").collect() == [(1, "a")]
    with pytest.raises(Exception, match="not in the snapshot"):
        rows("read committed").collect()
