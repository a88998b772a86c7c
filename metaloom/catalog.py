"""The registered queries over the supplied tables, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import projections as P
from .functions import canonical
from .operators import batching, compare, conflicts, drift, graph, history, impact, policy, reconcile
from .sinks import artifacts

ROOTS = ["n:3", "n:7", "c:15", "p:6"]
PART_CEILINGS = {"size": 500, "attributes": 2000}
Query = Callable[[SparkSession, str], DataFrame]


def graph_merge_edges(spark, d):
    merged = graph.merge_edges(P.supply_edges(spark, d))
    refs = F.array_join(F.transform("provenance", lambda p: F.concat(p["source_ref"], F.lit("/"), p["source_version"])), ",")
    return merged.select("src_key", "dst_key", F.size("provenance").cast("bigint").alias("n_sources"), refs.alias("sources"))


def graph_dangling(spark, d):
    """Urgent orders have lost their nodes here, so their edges dangle."""
    g = P.graph(spark, d)
    cut = graph.Graph(g.nodes.filter("kind != 'transformation' OR name != '1-URGENT'"), g.edges)
    return graph.dangling(cut)


def graph_missing_ancestors(spark, d):
    g = P.graph(spark, d)
    return graph.missing_ancestors(g.nodes.filter("node_key != 'n:5'"))


def impact_distance(spark, d):
    return impact.reach(P.graph(spark, d).edges, P.roots(spark, ROOTS))


def impact_paths(spark, d):
    found = impact.downstream(P.graph(spark, d).edges, P.roots(spark, ROOTS))
    return impact.paths(found).select("target", "distance", "root", "path_key")


def impact_affected_edges(spark, d):
    g = P.graph(spark, d)
    return impact.affected_edges(g.edges, impact.reach(g.edges, P.roots(spark, ROOTS)))


def impact_assets(spark, d):
    g = P.graph(spark, d)
    return impact.governance_assets(g.nodes, impact.reach(g.edges, P.roots(spark, ROOTS))).select("node_key", "kind")


def impact_contracts(spark, d):
    g = P.graph(spark, d)
    return impact.associated_contracts(g.nodes, g.edges, impact.reach(g.edges, P.roots(spark, ROOTS)))


def impact_policies(spark, d):
    g = P.graph(spark, d)
    closure = impact.reach(g.edges, P.roots(spark, ROOTS))
    local = closure.filter("node_key LIKE 'c:%'").select(F.lit("table").alias("kind"), F.concat(F.lit("tbl:customer/"), F.substring_index("node_key", ":", -1)).alias("local_id"))
    return impact.affected_policies(local, P.policies(spark))


def impact_workspace(spark, d):
    g = P.graph(spark, d)
    shown = impact.workspace(g.nodes, impact.reach(g.edges, P.roots(spark, ROOTS)))
    return shown.groupBy("impact").agg(F.count(F.lit(1)).alias("n_nodes"))


def impact_policy_nodes(spark, d):
    g = P.graph(spark, d)
    return impact.policy_nodes(g.nodes, impact.reach(g.edges, P.roots(spark, ROOTS))).select("node_key", "kind")


def impact_evidence(spark, d):
    """The steps that a result shows, of all its paths."""
    _, steps = impact.evidence(impact.downstream(P.graph(spark, d).edges, P.roots(spark, ROOTS)))
    return steps.select(impact.step_key(F.struct("kind", "src_key", "dst_key")).alias("step"))


def lineage_materialize(spark, d):
    """An order's price comes from its parts' prices."""
    p = F.array(F.struct(F.col("l_returnflag").alias("provider_type"), F.lit("l").alias("source_ref")))
    rows = P.table(spark, d, "lineitem").select(F.concat(F.lit("o:"), F.col("l_orderkey"), F.lit("/price")).alias("output_key"), F.concat(F.lit("p:"), F.col("l_partkey"), F.lit("/price")).alias("input_key"), p.alias("provenance"))
    return graph.lineage_edges(rows).select("src_key", "dst_key", F.size("provenance").cast("bigint").alias("n_sources"))


def obs_normalize(spark, d):
    done = conflicts.normalize(P.observations(spark, d))
    refs = F.array_join(F.transform("provenance", lambda p: F.concat(p["provider_type"], F.lit("/"), p["source_ref"])), ",")
    return done.select("object_key", "pointer", "value_json", refs.alias("sources"))


def _decided(spark, d):
    return conflicts.decide(P.daily_observations(spark, d), P.authority(spark))


def conflict_states(spark, d):
    return _decided(spark, d).select("object_key", "pointer", "state", "reason", "n_values", "n_sources")


def conflict_resolved(spark, d):
    return _decided(spark, d).filter("has_effective_value").select("object_key", "pointer", "effective_json", F.col("rule.provider_type").alias("authority"))


def conflict_summary(spark, d):
    return _decided(spark, d).groupBy("state", "reason").agg(F.count(F.lit(1)).alias("n_properties"))


def conflict_ambiguous_rules(spark, d):
    """Every part declares its brand an authority for its type, those of odd size in one of three namespaces alone."""
    size, none = F.col("p_size"), F.lit(None).cast("string")
    rules = P.table(spark, d, "part").select(F.lit("table").alias("kind"), F.concat(F.lit("/attributes/"), "p_type").alias("pointer"), F.when(size % 2 == 1, F.concat(F.lit("ns"), size % 3)).alias("namespace"), F.col("p_brand").alias("provider_type"), none.alias("source_ref"))
    return conflicts.ambiguous_selectors(rules)


def assessed_events(spark, d):
    """The events by day with types as mapped properties: views are names, clicks descriptions, purchases data types."""
    names = F.create_map(*(F.lit(x) for pair in {"/attributes/view": "/name", "/attributes/click": "/description", "/attributes/purchase": "/attributes/data_type"}.items() for x in pair))
    rows = P.daily_observations(spark, d).withColumn("value_json", F.when(F.col("value_json") == "3", "null").when(F.col("value_json") == "4", F.lit('" "')).when(F.col("value_json") == "5", F.col("value_json")).otherwise(F.concat(F.lit('"v'), F.col("value_json"), F.lit('"'))))
    rows = rows.withColumn("pointer", F.coalesce(F.try_element_at(names, F.col("pointer")), F.col("pointer")))
    rules = P.authority(spark).withColumn("pointer", F.coalesce(F.try_element_at(names, F.col("pointer")), F.col("pointer")))
    return conflicts.assess(conflicts.decide(rows, rules))


def reconcile_safety(spark, d):
    return conflicts.summary(assessed_events(spark, d))


def _sides(spark, d):
    return P.snapshot(spark, d, "baseline"), P.snapshot(spark, d, "candidate")


def _changes(spark, d):
    (bo, bp), (co, cp) = _sides(spark, d)
    return compare.object_changes(bo, co, bp, cp)


def compare_objects(spark, d):
    return _changes(spark, d)


def compare_properties(spark, d):
    (bo, bp), (co, cp) = _sides(spark, d)
    return compare.changed_properties(bo, co, bp, cp)


def compare_summary(spark, d):
    return compare.summary(_changes(spark, d))


def compare_inverse(spark, d):
    """Objects for which comparing the other way round is not the inverse: none."""
    (bo, bp), (co, cp) = _sides(spark, d)
    back = compare.inverse(compare.object_changes(co, bo, cp, bp)).select("object_key", F.col("change").alias("back"))
    both = _changes(spark, d).join(back, "object_key", "full").filter(~F.col("change").eqNullSafe(F.col("back")))
    return both.agg(F.count(F.lit(1)).alias("n_differences"))


def _drift(spark, d):
    (bo, bp), (co, cp) = _sides(spark, d)
    rows = drift.difference_rows(compare.object_changes(bo, co, bp, cp), compare.changed_properties(bo, co, bp, cp))
    return drift.classify(rows, P.drift_rules(spark, d))


def drift_classified(spark, d):
    return _drift(spark, d).select("change", "object_key", "pointer", "classification", "reason", F.array_join("rule_ids", ",").alias("rule_ids"))


def drift_summary(spark, d):
    return drift.summary(_drift(spark, d))


def drift_ambiguous_rules(spark, d):
    more = P.drift_rules(spark, d).filter("change = 'changed' AND pointer = '/status'").withColumns({"rule_id": F.concat(F.lit("other-"), F.col("rule_id")), "exp_cand_json": F.when(F.col("object_key").endswith("9"), F.lit('"Y"')).otherwise(F.col("exp_cand_json"))})
    return drift.ambiguous_rules(P.drift_rules(spark, d).unionByName(more)).select("object_key", "pointer", "n_expectations", F.array_join("rule_ids", ",").alias("rule_ids"))


def _violations(spark, d):
    return policy.evaluate(P.catalog_objects(spark, d), P.policies(spark), P.catalog_relationships(spark, d))


def policy_violations(spark, d):
    return _violations(spark, d)


def policy_counts(spark, d):
    return policy.counts(_violations(spark, d))


def top_violations(spark, d):
    return policy.top(_violations(spark, d), 20)


def history_transitions(spark, d):
    entries, properties = P.timeline(spark, d)
    return history.transition_counts(entries, properties)


def history_evolution(spark, d):
    entries, properties = P.timeline(spark, d)
    return history.evolution(entries, properties, "u:7").drop("object_key")


def history_adjacent_duplicates(spark, d):
    """A customer's orders as a timeline whose state is the status."""
    o = P.table(spark, d, "orders").select(F.col("o_custkey").alias("timeline"), F.struct("o_orderdate", "o_orderkey").alias("entry_index"), F.col("o_orderstatus").alias("state_digest"))
    return history.adjacent_duplicates(o).select("timeline", F.col("entry_index.o_orderkey").alias("order_key"), "state_digest")


def history_known(spark, d):
    return history.ever_known(P.timeline(spark, d)[1])


def _plan(spark, d):
    desired, remote = P.desired_and_remote(spark, d)
    return reconcile.plan_assets(desired, reconcile.managed(remote, "main", ["table"]).filter("managed"))


def sync_plan_assets(spark, d):
    return _plan(spark, d).select("local_id", "action", F.array_join("changed_fields", ",").alias("changed_fields"))


def sync_plan_counts(spark, d):
    return reconcile.counts(_plan(spark, d))


def sync_unmanaged(spark, d):
    return reconcile.unmanaged_count(reconcile.managed(P.desired_and_remote(spark, d)[1], "main", ["table"]))


def sync_plan_relationships(spark, d):
    o = P.table(spark, d, "orders")
    rel = o.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id"), F.col("o_orderstatus").alias("type_ref"))
    moved = rel.filter("type_ref != 'F'").withColumn("type_ref", F.when(F.col("target_id") % 5 == 0, F.lit("Z")).otherwise(F.col("type_ref")))
    plan = reconcile.plan_relationships(rel.filter("type_ref != 'P'"), moved)
    return plan


def overlay_decisions(desired):
    """Customers whose decision is safe get a description, those of sevens a null one, which keeps what the remote has."""
    k = F.substring_index("local_id", ":", -1).cast("bigint")
    target = F.struct(F.lit(True).alias("ok"), (k % 7 != 0).alias("has_value"), F.when(k % 7 != 0, F.concat(F.lit("d"), k.cast("string"))).alias("value"))
    return desired.select("local_id", F.lit("description").alias("field"), ((k % 2 == 1) & (k % 3 != 0)).alias("safe"), F.lit(True).alias("applicable"), target.alias("target"))


def sync_overlay(spark, d):
    desired, remote = P.desired_and_remote(spark, d)
    remote = reconcile.managed(remote, "main", ["table"]).filter("managed")
    done = reconcile.overlay(desired, remote, overlay_decisions(desired), {"description": "segment"})
    return done.select("local_id", F.try_element_at("attributes", F.lit("segment")).alias("segment"), F.try_element_at("attributes", F.lit("nation")).alias("nation"))


def stale_categories(spark, d):
    """Digests of region and nation now, and as they were saved with one nation under another name."""
    r, n = P.table(spark, d, "region"), P.table(spark, d, "nation")
    digest = lambda df, name, c: artifacts.identity(df.select(c), "config").select(F.lit(name).alias("category"), "digest")
    saved = digest(r, "config", "r_name").unionByName(digest(n.withColumn("n_name", F.when(F.col("n_nationkey") == 3, F.lit("X")).otherwise(F.col("n_name"))), "mapping", "n_name"))
    return reconcile.stale_categories(saved, digest(r, "config", "r_name").unionByName(digest(n, "mapping", "n_name")))


def batch_pack_rows(spark, d):
    parts = P.table(spark, d, "part").select("p_partkey", (1 + F.col("p_size")).cast("bigint").alias("size"), (F.col("p_size") * 5 % 97).cast("bigint").alias("attributes"))
    return batching.batches(parts, ["p_partkey"], PART_CEILINGS)


def batch_pack(spark, d):
    return batch_pack_rows(spark, d).select("p_partkey", "batch")


def relation_hosts(spark, d):
    o = P.table(spark, d, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey")).alias("source_id"), F.concat(F.lit("o:"), F.col("o_orderkey")).alias("target_id"), "o_custkey", "o_orderkey")
    order = o.select(F.col("source_id").alias("local_id"), (F.col("o_custkey") * 10).alias("position")).distinct().unionByName(o.select(F.col("target_id").alias("local_id"), (F.col("o_orderkey") * 2 + 1).alias("position")))
    return reconcile.relation_hosts(o.select("source_id", "target_id"), order)


def pointer_escape(spark, d):
    docs = P.table(spark, d, "pages").select("page_id", F.concat(F.col("url"), F.lit("~x")).alias("url"))
    p = canonical.pointer(F.lit("pages"), F.col("url"))
    return docs.select("page_id", p.alias("pointer"), (F.element_at(canonical.tokens(p), 2) == F.col("url")).alias("round_trip"))


def identity_digest(spark, d):
    n = P.table(spark, d, "nation")
    key = canonical.node_key(F.lit("ns"), F.lit("table"), F.col("n_name"), canonical.node_key(F.lit("ns"), F.lit("schema"), F.col("n_regionkey").cast("string")))
    return n.select("n_nationkey", key.alias("node_key"), canonical.digest("graph", key).alias("digest"))


def physical_projection(spark, d):
    n = P.table(spark, d, "nation")
    c = P.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", canonical.local_id("column", F.col("n_regionkey"), F.col("n_name"), F.col("c_mktsegment"), F.col("c_name")).alias("local_id"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    graph_merge_edges, graph_dangling, graph_missing_ancestors, impact_distance, impact_paths, impact_affected_edges, impact_assets, impact_contracts, impact_policies, impact_policy_nodes, impact_evidence, impact_workspace,
    lineage_materialize, obs_normalize, conflict_states, conflict_resolved, conflict_summary, conflict_ambiguous_rules, reconcile_safety, compare_objects, compare_properties, compare_summary, compare_inverse,
    drift_classified, drift_summary, drift_ambiguous_rules, policy_violations, policy_counts, top_violations, history_transitions, history_evolution, history_adjacent_duplicates, history_known,
    sync_plan_assets, sync_plan_counts, sync_unmanaged, sync_plan_relationships, sync_overlay, stale_categories, batch_pack, relation_hosts, pointer_escape, identity_digest, physical_projection,
)}


def queries() -> dict[str, Query]:
    from . import catalog_checks, catalog_histories, catalog_plans, catalog_reviews, catalog_sources

    return QUERIES | catalog_plans.QUERIES | catalog_sources.QUERIES | catalog_checks.QUERIES | catalog_histories.QUERIES | catalog_reviews.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import catalog_checks, catalog_histories, catalog_plans, catalog_reviews, oracle_sources
    from .oracle import SQL

    return SQL | catalog_plans.SQL | oracle_sources.SQL | catalog_checks.sql() | catalog_histories.SQL | catalog_reviews.SQL
