"""Operators on small graphs, observations and snapshots with results worked out by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from metaloom.operators import batching, compare, conflicts, drift, graph, history, impact, policy, reconcile

EDGE = "src_key string, kind string, dst_key string"


def edges(spark, *rows):
    return spark.createDataFrame([(a, "depends_on", b) for a, b in rows], EDGE)


def roots(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "root string")


def reached(found):
    return {r["target"]: (r["distance"], r["root"]) for r in found.targets.collect()}


def test_chain_of_dependencies(spark):
    found = impact.downstream(edges(spark, ("totals", "orders"), ("report", "totals")), roots(spark, "orders"))
    assert reached(found) == {"totals": (1, "orders"), "report": (2, "orders")}
    assert impact.broken_paths(impact.paths(found)).count() == 0


def test_diamond_has_one_path_and_all_edges(spark):
    e = edges(spark, ("left", "root"), ("right", "root"), ("sink", "left"), ("sink", "right"))
    found = impact.downstream(e, roots(spark, "root"))
    assert reached(found)["sink"] == (2, "root")
    assert found.targets.filter("target = 'sink'").count() == 1
    assert impact.affected_edges(e, found.closure).count() == 4


def test_equal_distance_takes_the_smaller_path_and_a_shorter_one_wins(spark):
    assert reached(impact.downstream(edges(spark, ("x", "a"), ("x", "b")), roots(spark, "a", "b"))) == {"x": (1, "a")}
    found = impact.downstream(edges(spark, ("mid", "a"), ("x", "mid"), ("x", "b")), roots(spark, "a", "b"))
    assert reached(found)["x"] == (1, "b")


def test_roots_are_no_targets_and_cycles_end(spark):
    assert reached(impact.downstream(edges(spark, ("a", "b"), ("b", "a"), ("c", "b")), roots(spark, "a", "b"))) == {"c": (1, "b")}


def test_impact_does_not_depend_on_the_order_of_edges(spark):
    rows = [("m", "r"), ("x", "m"), ("x", "r")]
    results = [sorted(impact.downstream(edges(spark, *p).repartition(1 + i % 3), roots(spark, "r")).targets.collect()) for i, p in enumerate(itertools.permutations(rows))]
    assert all(r == results[0] for r in results)


def least_paths(rows, starts):
    """All shortest paths' least texts, layer by layer. rows: (from, to, kind, src, dst)."""
    text = lambda r: f"[{r[2]},{r[3]},{r[4]}]"
    front, done = {k: k for k in starts}, dict.fromkeys(starts)
    while front:
        new = {}
        for r in rows:
            if r[0] in front and r[1] not in done:
                new[r[1]] = min(new.get(r[1], "~"), f"{front[r[0]]}>{text(r)}")
        done |= new
        front = new
    return {k: v for k, v in done.items() if v}


def test_paths_are_the_least_texts(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["contains", "governs", "depends_on"]), f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(160)]
    e = spark.createDataFrame([(a, kind, b) for kind, a, b in rows], EDGE)
    steps = [((b, a) if kind == "depends_on" else (a, b)) + (kind, a, b) for kind, a, b in rows]
    starts = ["n1", "n10", "n2"]
    for hub in (2, impact.HUB):  # with most sources as hubs, and with none
        found = impact.downstream(e, roots(spark, *starts), hub=hub)
        full = impact.paths(found)
        assert {r["target"]: r["path_key"] for r in full.collect()} == least_paths(steps, starts)
        assert impact.broken_paths(full).count() == 0
        assert {r["node_key"]: r["distance"] for r in impact.reach(e, roots(spark, *starts), hub=hub).collect()} == {r["target"]: r["distance"] for r in found.targets.collect()} | dict.fromkeys(starts, 0)
        walked = {tuple(x) for r in full.collect() for x in r["steps"]}
        assert {(r["kind"], r["src_key"], r["dst_key"]) for r in impact.evidence(found)[1].collect()} == walked


def test_a_long_chain(spark):
    found = impact.downstream(edges(spark, *((f"k{i + 1:03}", f"k{i:03}") for i in range(20))), roots(spark, "k000"))
    last = impact.paths(found).orderBy(F.desc("distance")).first()
    assert last["target"] == "k020" and [s["src_key"] for s in last["steps"]] == [f"k{i + 1:03}" for i in range(20)]


def test_hubs_are_dealt_to_several_partitions(spark):
    star = impact.hops(edges(spark, *((f"leaf{i}", "hub") for i in range(2000)), ("one", "other")))
    moves = impact.moves_of(star.select("from_key", "to_key"), 100)
    by = [r["count"] for r in moves.rows.filter("from_key = 'hub'").groupBy("part").count().collect()]
    assert len(by) == 20 and max(by) < 200
    assert moves.after(roots(spark, "hub", "other"), "root").count() == 2001


def test_no_roots_and_unknown_roots(spark):
    e = edges(spark, ("x", "a"))
    assert impact.downstream(e, roots(spark)).targets.count() == 0
    nodes = spark.createDataFrame([("a",), ("x",)], "node_key string")
    assert [r["root"] for r in impact.unknown_roots(nodes, roots(spark, "a", "zz")).collect()] == ["zz"]


def test_a_search_that_is_not_at_its_end_is_an_error(spark):
    e = edges(spark, ("b", "a"), ("c", "b"), ("d", "c"))
    for most in (None, 3):
        assert reached(impact.downstream(e, roots(spark, "a"), most))["d"][0] == 3
    with pytest.raises(RuntimeError, match="beyond 2 layers"):
        impact.downstream(e, roots(spark, "a"), 2)


P = "array<struct<provider_type:string,source_ref:string,source_version:string,observation_mode:string>>"


def observed(spark, *rows):
    """rows: value and provider/ref."""
    data = [("t", "ns", "table", "/description", v, [(s.split("/")[0], s.split("/")[1], None, "declared")]) for v, s in rows]
    return spark.createDataFrame(data, f"object_key string, namespace string, kind string, pointer string, value_json string, provenance {P}")


def rules(spark, *rows):
    """rows: namespace and provider."""
    return spark.createDataFrame([("table", "/description", n, p, None) for n, p in rows], "kind string, pointer string, namespace string, provider_type string, source_ref string")


A, B, C = '"a"', '"b"', '"c"'


@pytest.mark.parametrize(
    ("rows", "authority", "reason", "value"),
    [
        ([(A, "odcs/c1")], [(None, "dbt")], "SINGLE_OBSERVATION", A),
        ([(A, "odcs/c1"), (A, "dbt/m")], [], "AGREEMENT", A),
        ([(A, "odcs/c1"), (A, "odcs/c1")], [], "SINGLE_OBSERVATION", A),
        ([(A, "odcs/c1"), (B, "dbt/m")], [(None, "odcs")], "RESOLVED_BY_AUTHORITY", A),
        ([(A, "odcs/c1"), (B, "dbt/m")], [], "NO_AUTHORITY_RULE", None),
        ([(A, "odcs/c1"), (B, "dbt/m")], [(None, "openlineage")], "AUTHORITATIVE_SOURCE_NOT_OBSERVED", None),
        ([(A, "odcs/c1"), (B, "odcs/c2"), (C, "dbt/m")], [(None, "odcs")], "AUTHORITATIVE_SOURCE_CONFLICTED", None),
        ([(A, "odcs/c1"), (B, "dbt/m")], [(None, "odcs"), (None, "dbt")], "INVALID_OR_AMBIGUOUS_AUTHORITY", None),
        ([(A, "odcs/c1"), (B, "dbt/m")], [(None, "odcs"), (None, "odcs")], "RESOLVED_BY_AUTHORITY", A),
        ([(A, "odcs/c1"), (B, "dbt/m")], [(None, "odcs"), ("ns", "dbt")], "RESOLVED_BY_AUTHORITY", B),
        ([(A, "odcs/c1"), (B, "dbt/m")], [("other", "odcs")], "NO_AUTHORITY_RULE", None),
        ([("null", "odcs/c1")], [], "SINGLE_OBSERVATION", "null"),
        ([("1", "odcs/c1"), ("1.0", "dbt/m"), ("true", "dbt/m")], [], "NO_AUTHORITY_RULE", None),
    ],
)
def test_conflict_decisions(spark, rows, authority, reason, value):
    for order in (rows, rows[::-1]):
        r = conflicts.decide(observed(spark, *order), rules(spark, *authority)).first()
        assert (r["reason"], r["effective_json"], r["has_effective_value"]) == (reason, value, value is not None)


def test_values_that_a_target_can_take(spark):
    cases = [("description", '""', True, ""), ("display_name", '" "', False, None), ("display_name", "null", True, None), ("data_type", "5", False, None), ("owner", '[{"name":"n","type":"t"}]', True, "n"), ("owner", "[]", False, None), ("owner", '[{"name":"n"}]', False, None), (None, '"x"', False, None)]
    df = spark.createDataFrame([(f, v) for f, v, _, _ in cases], "field string, v string")
    got = [tuple(r) for r in df.select(conflicts.converted(F.col("field"), F.col("v")).alias("c")).select("c.ok", "c.value").collect()]
    assert got == [(ok, value) for _, _, ok, value in cases]


def snapshot(spark, objects, properties):
    o = spark.createDataFrame([(k,) for k in objects], "object_key string")
    return o, spark.createDataFrame([(k, p, h, v) for (k, p), (h, v) in properties.items()], "object_key string, pointer string, has_value boolean, value_json string")


def test_compare_tells_null_from_missing_and_is_inverse(spark):
    a = snapshot(spark, ["x", "y", "z"], {("x", "/d"): (True, "null"), ("y", "/d"): (True, "1"), ("z", "/d"): (True, "1")})
    b = snapshot(spark, ["x", "y", "w"], {("x", "/d"): (False, None), ("y", "/d"): (True, "1"), ("w", "/d"): (True, "1")})
    there = compare.object_changes(a[0], b[0], a[1], b[1])
    assert {r["object_key"]: (r["change"], r["n_properties"]) for r in there.collect()} == {"x": ("changed", 1), "y": ("unchanged", 0), "z": ("removed", 0), "w": ("added", 0)}
    back = compare.inverse(compare.object_changes(b[0], a[0], b[1], a[1]))
    assert sorted(there.collect()) == sorted(back.collect())
    assert compare.summary(compare.object_changes(a[0], a[0], a[1], a[1])).first()["status"] == "identical"


def test_root_alignment():
    with pytest.raises(ValueError, match="database"):
        compare.root_alignment(("s", "d"), ("s", "e"))
    assert compare.root_alignment(("s", "d"), ("s", "e"), databases=True) == {"source": False, "database": True}


DIFF = "change string, object_key string, pointer string, base_has boolean, base_json string, cand_has boolean, cand_json string"
RULE = "rule_id string, change string, object_key string, pointer string, exp_base_has boolean, exp_base_json string, exp_cand_has boolean, exp_cand_json string"


def test_drift_rules(spark):
    diffs = spark.createDataFrame([("changed", "t", "/d", True, "null", True, '"u"'), ("added", "n", None, False, None, False, None), ("removed", "o", None, False, None, False, None)], DIFF)
    r = [("r2", "changed", "t", "/d", None, None, True, '"u"'), ("r1", "changed", "t", "/d", None, None, True, '"u"'), ("add", "added", "n", None, None, None, None, None)]
    got = {x["object_key"]: (x["classification"], x["reason"], x["rule_ids"]) for x in drift.classify(diffs, spark.createDataFrame(r, RULE)).collect()}
    assert got == {"t": ("expected", "expectation_met", ["r1", "r2"]), "n": ("expected", "presence_rule", ["add"]), "o": ("unexpected", "unmatched_difference", [])}
    wrong = spark.createDataFrame([("r", "changed", "t", "/d", False, None, None, None)], RULE)
    assert drift.classify(diffs.filter("object_key = 't'"), wrong).first()["reason"] == "expectation_mismatch"
    none = drift.classify(diffs, spark.createDataFrame([], RULE))
    assert {x["reason"] for x in none.collect()} == {"unmatched_difference"}
    both = spark.createDataFrame([*r, ("r3", "changed", "t", "/d", None, None, True, '"v"')], RULE)
    assert [x["n_expectations"] for x in drift.ambiguous_rules(both).collect()] == [2]
    assert drift.summary(drift.classify(diffs.limit(0), spark.createDataFrame([], RULE))).first()["status"] == "no_difference"


def test_policy_prefix_is_literal(spark):
    objects = spark.createDataFrame([("table", "tbl:a_b/x", "x", " ", None), ("table", "tbl:axb/x", "x", None, "d")], "kind string, local_id string, name string, owner string, description string")
    p = spark.createDataFrame([("p", "error", "require_owner", "table", None, "tbl:a_b")], "policy_id string, severity string, rule_type string, kind string, object_id string, id_prefix string")
    assert [r["local_id"] for r in policy.evaluate(objects, p).collect()] == ["tbl:a_b/x"]
    assert not policy.is_clear(policy.evaluate(objects, p)).first()["ok"]


def test_history_append_refuses_the_same_state(spark):
    entries = spark.createDataFrame([(0, "a"), (1, "b")], "entry_index int, state_digest string")
    with pytest.raises(ValueError):
        history.append(entries, spark.createDataFrame([("b",)], "state_digest string"))
    assert history.append(entries, spark.createDataFrame([("a",)], "state_digest string")).count() == 3


@pytest.mark.parametrize(("weights", "most"), [([1] * 7, 3), ([3, 1, 3, 2, 2, 1], 3), ([5], 5), ([], 5), ([1, 5, 1, 4, 1, 5, 5, 2, 2, 1], 5)])
def test_batches_are_greedy(spark, weights, most):
    rows = spark.createDataFrame([(i, w, 0) for i, w in enumerate(weights)], "k int, w bigint, c bigint").repartition(3)
    got = {r["k"]: r["batch"] for r in batching.batches(rows, ["k"], {"w": most, "c": 10}).collect()}
    known, batch, total = {}, 0, 0
    for i, w in enumerate(weights):
        if total + w > most:
            batch, total = batch + 1, 0
        known[i], total = batch, total + w
    assert got == known


def test_batches_with_weights_that_are_zero_and_names_of_any_kind(spark):
    rows = spark.createDataFrame([(i, i % 3, 1) for i in range(40)], "k int, n bigint, rows bigint").repartition(3)
    got = {r["k"]: r["batch"] for r in batching.batches(rows, ["k"], {"n": 5, "rows": 4}).collect()}
    batch, total, count = 0, 0, 0
    for i in range(40):
        if total + i % 3 > 5 or count + 1 > 4:
            batch, total, count = batch + 1, 0, 0
        total, count = total + i % 3, count + 1
        assert got[i] == batch
    with pytest.raises(ValueError, match="no weight"):
        batching.batches(rows, ["k"], {"n": 5})


def test_evolution_of_one_property_tells_every_transition(spark):
    entries = spark.createDataFrame([(i,) for i in (0, 1, 2, 5)], "entry_index int")
    rows = spark.createDataFrame([(1, "o", "/p", True, "1"), (2, "o", "/p", True, "1"), (0, "o", "/q", True, "2")], "entry_index int, object_key string, pointer string, has_value boolean, value_json string")
    own = history.evolution(entries, rows, "o", "/p").orderBy("from_index").collect()
    assert [(r["from_index"], r["to_index"], r["change"]) for r in own] == [(0, 1, "added"), (1, 2, "unchanged"), (2, 5, "removed")]
    counted = {(r["from_index"], r["change"]): r["n_properties"] for r in history.transition_counts(entries, rows).collect()}
    assert counted == {(0, "added"): 1, (0, "removed"): 1, (1, "unchanged"): 2, (2, "removed"): 1, (2, "unchanged"): 1}


def test_a_single_command_above_the_ceiling_is_an_error(spark):
    with pytest.raises(ValueError):
        batching.batches(spark.createDataFrame([(1, 50_001)], "k int, w bigint"), ["k"], {"w": 50_000})


def test_blank_display_name_is_none(spark):
    asset = "local_id string, name string, display_name string, attributes map<string,string>"
    d = spark.createDataFrame([("a", "n", None, {"x": "1", "y": "2"}), ("b", "n", "B", {})], asset)
    r = spark.createDataFrame([("a", "n", "  ", {"y": "2", "x": "1"}), ("b", "m", "C", None)], asset)
    assert {x["local_id"]: (x["action"], x["changed_fields"]) for x in reconcile.plan_assets(d, r).collect()} == {"a": ("unchanged", []), "b": ("update", ["name", "display_name"])}


def test_merge_keeps_provenance_and_counts_payloads(spark):
    rows = [("n", "one", [("dbt", "m", None, "declared")]), ("n", "one", [("odcs", "c", None, "declared")]), ("k", "one", []), ("k", "two", [])]
    merged = {r["node_key"]: r for r in graph.merge_nodes(spark.createDataFrame(rows, f"node_key string, name string, provenance {P}")).collect()}
    assert [p["provider_type"] for p in merged["n"]["provenance"]] == ["dbt", "odcs"]
    assert (merged["n"]["n_payloads"], merged["k"]["n_payloads"]) == (1, 2)
