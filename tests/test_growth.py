"""What steps carry, so that what is shuffled and parsed grows no faster than the input."""

from metaloom import projections as P
from metaloom.functions import documents
from metaloom.operators import graph, impact
from metaloom.sources import openlineage

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hops_carry_their_ends_once_and_repeated_edges_change_nothing(spark):
    edges = spark.createDataFrame([("b", "depends_on", "a"), ("b", "depends_on", "a"), ("b", "contains", "c")], "src_key string, kind string, dst_key string")
    assert impact.hops(edges).columns == ["from_key", "to_key", "kind"]
    found = impact.paths(impact.downstream(edges, spark.createDataFrame([("a",)], "root string")))
    assert {(r["target"], r["path_key"]) for r in found.collect()} == {("b", "a>[depends_on,b,a]"), ("c", "a>[depends_on,b,a]>[contains,b,c]")}


def test_edges_of_lines_are_made_different_by_their_numbers(spark):
    assert "Aggregate [l_orderkey" in plan(P.graph(spark, DIR).edges)


def test_ends_are_sought_without_rows_for_each_end(spark):
    edges = spark.createDataFrame([("a", "k", "a"), ("a", "k", "x"), ("y", "k", "x")], "src_key string, kind string, dst_key string")
    found = graph.dangling(graph.Graph(spark.createDataFrame([("a",)], "node_key string"), edges))
    assert "Generate" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("a", "k", "x", "dst"), ("y", "k", "x", "dst"), ("y", "k", "x", "src")]


def _pairs(spark, jobs):
    said = [("run", str(i % 9), "j", f"n{i % jobs}", None, 0, "ns", side, name) for i in range(90) for side, name in (("input", f"i{i % 4}"), ("output", f"o{i % 2}"))]
    rows = spark.createDataFrame(said, "kind string, run_id string, job_namespace string, job_name string, schema_url string, event_key bigint, ns string, side string, name string")
    known = rows.select("ns", "name").distinct().withColumn("node_key", rows["name"])
    due = {}
    for run in {r[1] for r in said}:
        of = [r for r in said if r[1] == run]
        for o in (r[8] for r in of if r[7] == "output"):
            for i in (r[8] for r in of if r[7] == "input"):
                due.setdefault((o, i), set()).update(f"j/{r[3]}" for r in of)
    found = openlineage.lineage(rows, known)
    told = {(r["src_key"], r["dst_key"]): [p["source_ref"] for p in r["provenance"]] for r in found.collect()}
    return found, told, {k: sorted(v) for k, v in due.items()}


def test_few_provenances_of_pairs_are_united_without_sorting_pairs(spark):
    found, told, due = _pairs(spark, 2)
    assert told == due and "collect_set" not in plan(found)


def test_many_provenances_of_pairs_are_united_too(spark):
    for jobs in (63, 64, 70):
        _, told, due = _pairs(spark, jobs)
        assert told == due


def test_only_objects_and_lists_take_the_encoder(monkeypatch):
    calls = []
    encode = documents._encode
    monkeypatch.setattr(documents, "_encode", lambda x: calls.append(x) or encode(x))
    value = {"id": "é\n", "n": 1, "big": 10**30, "none": None, "yes": True, "x": 1.5, "l": [1]}
    rows = list(documents._visit("d", value, "r", documents._plans({"r": documents.Rule()}), (), ()))
    assert calls == [1.5, [1]]
    assert rows[0][3] == {k: encode(v) for k, v in value.items()}
