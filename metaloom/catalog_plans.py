"""More registered queries: plans and what they rest on, identities, integrity and lineage of runs; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import projections as P
from .catalog import Query
from .operators import conflicts, graph, reconcile
from .oracle import _CATALOGS, _DAILY, _RULES, _SAFETY, _decided
from .plans import plan
from .sources import catalog as source_catalog
from .sources import openlineage

EXPLAINED = "u:7/2024-01-05"


def graph_merge_nodes(spark, d):
    """Every line states its part as a node; the return flag is a payload on which lines disagree."""
    p = F.struct(F.col("l_linestatus").alias("provider_type"), F.lit("l").alias("source_ref"))
    nodes = P.table(spark, d, "lineitem").select(F.concat(F.lit("p:"), "l_partkey").alias("node_key"), F.col("l_returnflag").alias("name"), F.array(p).alias("provenance"))
    return graph.merge_nodes(nodes).select("node_key", "n_payloads", F.size("provenance").cast("bigint").alias("n_sources"))


def catalog_problems(spark, d):
    """Orders that are not open as tables, and all lines as their columns: some repeat an id, some have no parent."""
    none = F.lit(None).cast("string")
    tables = P.table(spark, d, "orders").filter("o_orderstatus != 'O'").select(F.lit("database").alias("kind"), F.concat(F.lit("tbl:"), "o_orderkey").alias("local_id"), none.alias("parent_id"))
    columns = P.table(spark, d, "lineitem").select(F.lit("column").alias("kind"), F.concat(F.lit("col:"), "l_orderkey", F.lit("/"), "l_linenumber").alias("local_id"), F.concat(F.lit("tbl:"), "l_orderkey").alias("parent_id"))
    return source_catalog.problems(tables.unionByName(columns)).groupBy("local_id", "problem").agg(F.count(F.lit(1)).alias("n_rows"))


def run_lineage(spark, d):
    """Orders as runs that read parts and write to suppliers: each output of a run depends on each of its inputs."""
    line = P.table(spark, d, "lineitem")
    ends = F.array(F.struct(F.lit("input").alias("side"), F.concat(F.lit("p:"), "l_partkey").alias("name")), F.struct(F.lit("output").alias("side"), F.concat(F.lit("s:"), "l_suppkey").alias("name")))
    text = lambda x: F.lit(x)
    rows = line.select(text("run").alias("kind"), F.col("l_orderkey").cast("string").alias("run_id"), text("j").alias("job_namespace"), text("n").alias("job_name"), text("u").alias("schema_url"), F.lit(0).cast("bigint").alias("event_key"), text("ns").alias("ns"), F.explode(ends).alias("end"))
    rows = rows.select("kind", "run_id", "job_namespace", "job_name", "schema_url", "event_key", "ns", "end.side", "end.name")
    known = rows.select("ns", "name").distinct().withColumn("node_key", F.col("name"))
    return openlineage.lineage(rows, known).select("src_key", "dst_key", F.size("provenance").cast("bigint").alias("n_sources"))


def observed_pointers(spark, d):
    return conflicts.pointers(P.observations(spark, d))


def explain_object(spark, d):
    decided = conflicts.assess(conflicts.decide(P.daily_observations(spark, d), P.authority(spark)))
    return conflicts.explain(decided, EXPLAINED).select("pointer", "state", "reason", "assessment")


def review_status(spark, d):
    from .catalog import assessed_events

    return conflicts.review_status(assessed_events(spark, d))


def job_states(spark, d):
    """Events as remote jobs: the type gives the state, a value below 50 a failure."""
    e = P.table(spark, d, "events")
    state = F.when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "click", "RUNNING").when(F.col("event_type") == "purchase", "Error").otherwise("odd")
    result = F.when(F.col("event_type") == "view", F.when(F.col("value") < 50, "FAILURE").otherwise("SUCCESS"))
    return reconcile.job_states(e.select(state.alias("state"), result.alias("result"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n_jobs"))


def repeated_names(spark, d):
    parts = P.table(spark, d, "part").select(F.col("p_partkey").alias("local_id"), F.col("p_name").alias("name"), F.col("p_type").alias("domain_ref"))
    return reconcile.repeated_names(parts)


def occupied_names(spark, d):
    """Economy parts are in the remote catalog; all parts are to be created there."""
    parts = P.table(spark, d, "part").select(F.col("p_partkey").alias("local_id"), F.col("p_name").alias("name"), F.lit("parts").alias("domain_ref"), "p_type")
    return reconcile.occupied(parts, parts.filter("p_type = 'ECONOMY'")).select("local_id", "name")


def missing_types(spark, d):
    """Segments and nations as references of a mapping; segments are the types that the remote catalog has."""
    c, n = P.table(spark, d, "customer"), P.table(spark, d, "nation")
    refs = c.select(F.lit("segment").alias("category"), F.col("c_mktsegment").alias("ref")).distinct()
    nations = n.select(F.lit("nation").alias("category"), F.when(F.col("n_regionkey") == 0, F.concat(F.lit("<"), "n_name", F.lit(">"))).otherwise(F.col("n_name")).alias("ref"))
    return reconcile.missing_types(refs.unionByName(nations), refs.select("ref"))


def _reconciled(spark, d):
    from .catalog import overlay_decisions

    desired, remote = P.desired_and_remote(spark, d)
    remote = reconcile.managed(remote, "main", ["table"]).filter("managed")
    decisions = overlay_decisions(desired)
    done = reconcile.overlay(desired, remote, decisions, {"description": "segment"})
    return desired, remote, decisions, done, reconcile.plan_assets(done, remote)


def plan_assumptions(spark, d):
    desired, remote, decisions, done, actions = _reconciled(spark, d)
    return reconcile.assumptions(actions, desired, done, remote, decisions, {"description": "segment"}).select("local_id", "action", "mutation", "overlay", "safe")


def plan_commands(spark, d):
    """The commands of a plan whose new relations tie each order's customer to the customer with the next key."""
    desired, remote = P.desired_and_remote(spark, d)
    actions = reconcile.plan_assets(desired, reconcile.managed(remote, "main", ["table"]).filter("managed"))
    o = P.table(spark, d, "orders").select(F.concat(F.lit("tbl:"), "o_custkey").alias("source_id"), F.concat(F.lit("tbl:"), F.col("o_custkey") + 1).alias("target_id"), F.lit("next").alias("type_ref"))
    relations = reconcile.plan_relationships(o, o.limit(0))
    made = plan.commands(plan.Plan(actions, relations, None, None), desired)
    return made.select("local_id", "operation", "n_characteristics")


QUERIES: dict[str, Query] = {f.__name__: f for f in (graph_merge_nodes, catalog_problems, run_lineage, observed_pointers, explain_object, review_status, job_states, repeated_names, occupied_names, missing_types, plan_assumptions, plan_commands)}

_ASSESSED = f"""WITH {_SAFETY}, one AS (SELECT object_key, pointer, min(v) AS v FROM facts GROUP BY ALL), e AS (
  SELECT d.state, CASE WHEN n_values = 1 THEN one.v ELSE allowed_v END AS value, CASE pointer WHEN '/name' THEN 'display_name' WHEN '/description' THEN 'description' END AS field FROM decided d JOIN one USING (object_key, pointer))"""
_OVERLAID = f"""{_CATALOGS}, made AS (
  SELECT d.local_id, d.k, d.name, d.segment AS base, r.local_id IS NULL AS is_new, r.name AS r_name, r.segment AS old, d.k % 2 = 1 AND d.k % 3 <> 0 AS safe,
         CASE WHEN d.k % 2 = 0 OR d.k % 3 = 0 THEN d.segment WHEN d.k % 7 <> 0 THEN 'd' || d.k ELSE r.segment END AS new FROM desired d LEFT JOIN remote r USING (local_id)
), acts AS (SELECT *, CASE WHEN is_new THEN 'create' WHEN name <> r_name OR new IS DISTINCT FROM old THEN 'update' ELSE 'unchanged' END AS action, new IS DISTINCT FROM old AS mutation, new IS DISTINCT FROM base AS overlay FROM made)"""

SQL = {
    "graph_merge_nodes": "SELECT 'p:' || l_partkey AS node_key, count(DISTINCT l_returnflag) AS n_payloads, count(DISTINCT l_linestatus) AS n_sources FROM lineitem GROUP BY ALL",
    "catalog_problems": """WITH c AS (SELECT 'col:' || l_orderkey || '/' || l_linenumber AS local_id, l_orderkey FROM lineitem)
        SELECT local_id, 'repeated_id' AS problem, CAST(1 AS BIGINT) AS n_rows FROM c GROUP BY local_id HAVING count(*) > 1
        UNION ALL SELECT local_id, 'missing_parent', count(*) FROM c WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O') GROUP BY local_id""",
    "run_lineage": "SELECT DISTINCT 's:' || a.l_suppkey AS src_key, 'p:' || b.l_partkey AS dst_key, CAST(1 AS BIGINT) AS n_sources FROM lineitem a JOIN lineitem b USING (l_orderkey)",
    "observed_pointers": "SELECT 'u:' || user_id AS object_key, count(DISTINCT event_type) AS n_pointers FROM events GROUP BY ALL",
    "explain_object": f"""WITH {_decided(_DAILY, _RULES)} SELECT pointer, state, reason, 'not_reconciliation_mapped' AS assessment FROM decided WHERE object_key = '{EXPLAINED}'""",
    "review_status": f"""{_ASSESSED} SELECT CASE WHEN bool_or(field IS NOT NULL AND NOT (state NOT IN ('UNRESOLVED_CONFLICT', 'INVALID_OR_AMBIGUOUS_AUTHORITY') AND (value = 'null' OR (value LIKE '"%' AND (field = 'description' OR value <> '" "'))))) THEN 'blocked'
        WHEN bool_or(state NOT IN ('SINGLE_OBSERVATION', 'AGREEMENT')) THEN 'findings' ELSE 'clear' END AS status FROM e""",
    "job_states": """SELECT CASE event_type WHEN 'view' THEN CASE WHEN value < 50 THEN 'failed' ELSE 'succeeded' END WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'failed' ELSE 'unknown' END AS outcome, count(*) AS n_jobs FROM events GROUP BY ALL""",
    "repeated_names": "SELECT p_name AS name, p_type AS domain_ref, count(DISTINCT p_partkey) AS n_objects FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey) > 1",
    "occupied_names": "SELECT p_partkey AS local_id, p_name AS name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_type = 'ECONOMY')",
    "missing_types": "SELECT 'nation' AS category, CASE WHEN n_regionkey = 0 THEN '<' || n_name || '>' ELSE n_name END AS ref, CASE WHEN n_regionkey = 0 THEN 'placeholder' ELSE 'unknown' END AS problem FROM nation",
    "plan_assumptions": f"""WITH {_OVERLAID} SELECT local_id, action, mutation, overlay, safe FROM acts WHERE action = 'create' OR (action = 'update' AND (mutation OR overlay)) OR overlay""",
    "plan_commands": f"""WITH {_CATALOGS}, placed AS (SELECT local_id, action, row_number() OVER (ORDER BY CASE action WHEN 'create' THEN 1 ELSE 2 END, local_id) AS at FROM plan WHERE action IN ('create', 'update')),
        rels AS (SELECT DISTINCT 'tbl:' || o_custkey AS s, 'tbl:' || (o_custkey + 1) AS t FROM orders),
        hosts AS (SELECT CASE WHEN coalesce(p.at, -1) > coalesce(q.at, -1) THEN s ELSE t END AS local_id, count(*) AS n FROM rels LEFT JOIN placed p ON p.local_id = s LEFT JOIN placed q ON q.local_id = t GROUP BY ALL)
        SELECT coalesce(p.local_id, h.local_id) AS local_id, coalesce(p.action, 'relate') AS operation, CASE WHEN p.action IS NULL THEN 0 ELSE 2 END + coalesce(h.n, 0) AS n_characteristics
        FROM placed p FULL JOIN hosts h ON p.local_id = h.local_id""",
}
