"""Registered queries of checks, declarations and text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog as C
from . import projections as P
from .functions import canonical, text
from .operators import batching, compare, conflicts, drift, graph, history, impact, policy, reconcile
from .oracle import _CATALOGS, _DAILY, _LAYERS, _NODES, _OBS, _RULES, _SIDES, _TIMELINE, SQL as _SQL, _decided
from .plans import plan

Query = C.Query


def graph_ancestors(spark, d):
    return graph.ancestors(P.graph(spark, d).nodes)


def impact_broken_paths(spark, d):
    """Paths of two steps have lost their first one."""
    found = impact.paths(impact.downstream(P.graph(spark, d).edges, P.roots(spark, C.ROOTS)))
    cut = found.withColumn("steps", F.when(F.col("distance") == 2, F.slice("steps", 2, 1)).otherwise(F.col("steps")))
    return impact.broken_paths(cut).select("target")


def impact_unknown_roots(spark, d):
    """Customers as roots, of which the graph has those that are no multiples of four."""
    g, c = P.graph(spark, d), F.col("c_custkey")
    nodes = g.nodes.filter("kind != 'table' OR CAST(substring_index(node_key, ':', -1) AS BIGINT) % 4 != 0")
    return impact.unknown_roots(nodes, P.table(spark, d, "customer").select(F.concat(F.lit("c:"), c).alias("root")))


def conflict_candidates(spark, d):
    rows, rules = P.daily_observations(spark, d), P.authority(spark)
    found = conflicts.candidates(rows, conflicts.decide(rows, rules))
    return found.select("object_key", "pointer", "value_json", F.size("provenance").cast("bigint").alias("n_sources"), "chosen")


def conflict_declarations(spark, d):
    """Every part declares its brand an authority for its type."""
    p = P.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("table").alias("kind"), F.concat(F.lit("/attributes/"), "p_type").alias("pointer"), F.lit(None).cast("string").alias("namespace"), F.col("p_brand").alias("provider_type"), F.lit(None).cast("string").alias("source_ref"))
    return conflicts.declared(p).select("pointer", "provider_type", F.array_join("declared_by", ",").alias("declared_by"))


def observation_problems(spark, d):
    """Clicks have a pointer with a stray mark, purchases no pointer, and values of the forties are missing."""
    rows = P.observations(spark, d).withColumns({"pointer": F.when(F.col("pointer").endswith("click"), F.concat("pointer", F.lit("~2"))).when(F.col("pointer").endswith("purchase"), F.lit("name")).otherwise(F.col("pointer")), "value_json": F.when(F.col("value_json") != "4", F.col("value_json"))})
    return conflicts.unfit_observations(rows).groupBy("object_key", "pointer", "problem").agg(F.count(F.lit(1)).alias("n_rows"))


def compare_problems(spark, d):
    """A comparison whose statuses count one property too many, and whose priorities are told with equal sides."""
    (bo, bp), (co, cp) = P.snapshot(spark, d, "baseline"), P.snapshot(spark, d, "candidate")
    changes = compare.object_changes(bo, co, bp, cp)
    properties = compare.changed_properties(bo, co, bp, cp)
    properties = properties.withColumn("cand_json", F.when(F.col("pointer") == "/priority", F.col("base_json")).otherwise(F.col("cand_json")))
    return compare.problems(changes.withColumn("n_properties", F.col("n_properties") + F.when(F.col("object_key").endswith("7"), 1).otherwise(0)), properties)


def history_dimensions(spark, d):
    """Days as entries of three forms of context; the types of events are the dimensions."""
    entries, rows = P.timeline(spark, d)
    context = F.when(F.col("entry_index") % 3 == 0, "full").when(F.col("entry_index") % 3 == 1, "provenance").otherwise("none")
    names = F.create_map(*(F.lit(x) for pair in {"/view": "provenance", "/click": "conflict", "/purchase": "authority", "/scroll": "effective_value"}.items() for x in pair))
    facts = rows.select("entry_index", "object_key", F.try_element_at(names, F.col("pointer")).alias("dimension"), F.col("value_json").alias("payload_json")).filter("dimension IS NOT NULL")
    pairs = history.dimension_pairs(entries.withColumn("context", context), facts)
    return history.dimension_changes(pairs).filter("changed").select("from_index", "to_index", "object_key", "dimension", "base_json", "cand_json")


def history_availability(spark, d):
    """Orders as entries; their status says how much context they have."""
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("entry_index"), F.when(F.col("o_orderstatus") == "F", "full").when(F.col("o_orderstatus") == "O", "provenance").otherwise("none").alias("context"))
    return history.availability(o)


def drift_unfit_rules(spark, d):
    """Orders as rules: those that are pending name no property, those of low priority a property of an added object."""
    o = P.table(spark, d, "orders")
    value = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    change = F.when(F.col("o_orderpriority") == "5-LOW", "added").when(F.col("o_orderpriority") == "3-MEDIUM", "moved").otherwise("changed")
    pointer = F.when(F.col("o_orderstatus") != "P", "/status")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    yes = F.lit(True)
    rules = o.select(F.col("o_orderkey").alias("rule_id"), change.alias("change"), F.col("o_custkey").alias("object_key"), pointer.alias("pointer"), yes.alias("exp_base_has"), value(F.col("o_orderstatus")).alias("exp_base_json"), yes.alias("exp_cand_has"), value(F.when(urgent, F.col("o_orderstatus")).otherwise("X")).alias("exp_cand_json"))
    return drift.unfit_rules(rules)


def policy_unfit(spark, d):
    """Parts as policies, of which some name no rule, a kind that it cannot have, an unknown severity or two selectors."""
    p, size = P.table(spark, d, "part"), F.col("p_size")
    rule = F.when(F.col("p_type") == "ECONOMY", "odd").when(F.col("p_brand") < "Brand#3", "require_owner").otherwise("require_description")
    rows = p.select(F.col("p_name").alias("policy_id"), F.when(size < 5, "fatal").otherwise("error").alias("severity"), rule.alias("rule_type"), F.when(size % 2 == 0, "table").otherwise("column").alias("kind"), F.when(size > 20, "x").alias("object_id"), F.when(size > 40, "y").alias("id_prefix"))
    return policy.unfit(rows).distinct()


def batch_sums(spark, d):
    return batching.batch_totals(C.batch_pack_rows(spark, d), C.PART_CEILINGS)


def plan_blocking(spark, d):
    from .catalog_plans import _reconciled

    desired, remote, decisions, done, actions = _reconciled(spark, d)
    return reconcile.blocking(reconcile.assumptions(actions, desired, done, remote, decisions, {"description": "segment"})).select("local_id", "field")


def stale_decisions(spark, d):
    """Orders as decisions for customers that were saved; since then urgent ones have another digest and pending ones are gone."""
    o = P.table(spark, d, "orders").select(F.col("o_custkey").alias("local_id"), F.col("o_orderkey").alias("field"), F.col("o_orderstatus").alias("digest"), "o_orderpriority")
    now = o.filter("digest != 'P'").withColumn("digest", F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("digest")))
    return reconcile.stale_decisions(o.drop("o_orderpriority"), now).select("local_id", "field", "digest")


def text_functions(spark, d):
    p = P.table(spark, d, "part")
    odd = F.concat(F.lit(" <"), "p_name", F.lit("> & 'x' \"%\"\n "))
    return p.select("p_partkey", text.shortened(F.col("p_name"), 8).alias("short"), text.html_escape(odd).alias("html"), text.workflow_escape(odd).alias("workflow"), text.strip(odd).alias("stripped"), text.casefold(F.col("p_brand")).alias("folded"), text.markdown_escape(F.col("p_brand")).alias("markdown"), text.one_line(odd).alias("line"), text.is_blank(F.when(F.col("p_size") < 9, F.lit(" \t")).otherwise(F.col("p_name"))).alias("blank"))


def canonical_texts(spark, d):
    pages = P.table(spark, d, "pages")
    made = F.concat(F.lit('{ "url" : "'), "url", F.lit('", "n": [1, 2.0, true, null], "é": {"b": 1, "a": "€"} }'))
    return pages.select("page_id", canonical.canonical_json(made).alias("canonical"), canonical.escaped(F.concat("url", F.lit('€\n"'))).alias("escaped"), canonical.digest("policy", F.col("url")).alias("digest"))


def _actions(spark, d):
    desired, remote = P.desired_and_remote(spark, d)
    return reconcile.plan_assets(desired, reconcile.managed(remote, "main", ["table"]).filter("managed"))


def plan_order(spark, d):
    """The actions of a plan by their place in it; assets that are there have the remote id of their segment's table."""
    there = F.when(F.col("action") != "create", F.concat(F.lit("r"), F.substring("local_id", 5, 1)))
    actions = _actions(spark, d).select("action", F.when(F.col("local_id").endswith("3"), "table").otherwise("column").alias("kind"), "local_id", there.alias("remote_id"))
    return reconcile.in_plan_order(actions)


def execution_positions(spark, d):
    return plan.ordered(_actions(spark, d)).select("local_id", "position")


def observation_order(spark, d):
    return conflicts.in_entry_order(P.observations(spark, d)).select("object_key", "pointer", "value_json", "position")


def preflight_status(spark, d):
    """Customers as checks of their nation's report: the segment gives the status, those with a debt block."""
    status = F.when(F.col("c_acctbal") < -900, "INCOMPATIBLE").when(F.col("c_mktsegment") == "BUILDING", "NOT_VERIFIED").when(F.col("c_mktsegment") == "MACHINERY", "WARNING").otherwise("VERIFIED")
    return reconcile.preflight_status(P.table(spark, d, "customer").select(F.col("c_nationkey").alias("report"), status.alias("status"), (F.col("c_acctbal") < 0).alias("blocking")))


def history_unfit_entries(spark, d):
    """Orders as entries: the status gives the context, the priority which files they name, some have no digest."""
    o, n = P.table(spark, d, "orders"), F.substring("o_orderpriority", 1, 1).cast("int")
    context = F.when(F.col("o_orderstatus") == "F", "full").when(F.col("o_orderstatus") == "O", "provenance").when(F.col("o_orderkey") % 10 < 8, "none")
    files = F.when(n == 4, F.array().cast("array<string>")).when(n > 2, F.array(F.lit("rules.yaml")))
    digest = F.when(F.col("o_custkey") % 7 == 0, "").when(F.col("o_custkey") % 7 > 1, F.col("o_orderdate").cast("string"))
    entries = o.select(F.col("o_orderkey").alias("entry_index"), context.alias("context"), F.when(n > 1, "observations.json").alias("observations_path"), files.alias("authority_paths"), F.lit("sha256").alias("algorithm"), F.lit("1").alias("contract_version"), digest.alias("digest"))
    return history.unfit_entries(entries)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    graph_ancestors, impact_broken_paths, impact_unknown_roots, conflict_candidates, conflict_declarations, observation_problems, compare_problems, history_dimensions, history_availability,
    drift_unfit_rules, policy_unfit, batch_sums, plan_blocking, stale_decisions, text_functions, canonical_texts,
    plan_order, execution_positions, observation_order, preflight_status, history_unfit_entries,
)}

SQL = {
    "graph_ancestors": f"WITH {_NODES} SELECT k AS node_key, up AS ancestor_key FROM ups",
    "impact_broken_paths": f"WITH {_LAYERS} SELECT target FROM found WHERE distance = 2",
    "impact_unknown_roots": "SELECT 'c:' || c_custkey AS root FROM customer WHERE c_custkey % 4 = 0",
    "conflict_candidates": f"""WITH {_decided(_DAILY, _RULES)}, said AS (SELECT object_key, pointer, v, count(*) AS n_sources FROM facts GROUP BY ALL)
        SELECT object_key, pointer, s.v AS value_json, s.n_sources, n_values = 1 OR (reason = 'RESOLVED_BY_AUTHORITY' AND s.v = allowed_v) AS chosen FROM said s JOIN decided d USING (object_key, pointer)""",
    "conflict_declarations": "SELECT '/attributes/' || p_type AS pointer, p_brand AS provider_type, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS declared_by FROM part GROUP BY ALL",
    "observation_problems": f"""WITH {_OBS}, o AS (SELECT object_key, CASE WHEN pointer LIKE '%click' THEN pointer || '~2' WHEN pointer LIKE '%purchase' THEN 'name' ELSE pointer END AS pointer, v FROM obs)
        SELECT object_key, pointer, CASE WHEN pointer LIKE '%~2' OR pointer = 'name' THEN 'no_pointer' ELSE 'value_missing' END AS problem, count(*) AS n_rows FROM o WHERE pointer LIKE '%~2' OR pointer = 'name' OR v = '4' GROUP BY ALL""",
    "compare_problems": f"""WITH {_SIDES} SELECT object_key, CASE WHEN change = 'changed' AND object_key IN (SELECT object_key FROM props WHERE pointer = '/priority' AND base_has = cand_has) THEN 'equal_sides' ELSE 'wrong_count' END AS problem FROM changes
        WHERE object_key LIKE '%7' OR (change = 'changed' AND object_key IN (SELECT object_key FROM props WHERE pointer = '/priority' AND base_has = cand_has))""",
    "history_dimensions": f"""WITH {_TIMELINE}, nxt AS (SELECT i, lead(i) OVER (ORDER BY i) AS j FROM days),
        named AS (SELECT i, object_key, v, CASE pointer WHEN '/view' THEN 'provenance' WHEN '/click' THEN 'conflict' WHEN '/purchase' THEN 'authority' WHEN '/scroll' THEN 'effective_value' END AS dimension FROM seen),
        stated AS (SELECT *, i % 3 = 0 OR (i % 3 = 1 AND dimension = 'provenance') AS has FROM named WHERE dimension IS NOT NULL)
        SELECT nxt.i AS from_index, nxt.j AS to_index, object_key, dimension, a.v AS base_json, b.v AS cand_json FROM nxt JOIN stated a ON a.i = nxt.i JOIN stated b USING (object_key, dimension) WHERE b.i = nxt.j AND a.has AND b.has AND a.v <> b.v""",
    "history_availability": "SELECT o_orderkey AS entry_index, o_orderstatus IN ('F', 'O') AS has_provenance, o_orderstatus = 'F' AS has_conflict, o_orderstatus = 'F' AS has_authority, o_orderstatus = 'F' AS has_effective_value FROM orders",
    "drift_unfit_rules": """SELECT * FROM (SELECT o_orderkey AS rule_id, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'unknown_change' WHEN o_orderpriority <> '5-LOW' AND o_orderstatus = 'P' THEN 'property_missing'
        WHEN o_orderpriority = '5-LOW' AND o_orderstatus <> 'P' THEN 'property_not_allowed' WHEN o_orderpriority = '1-URGENT' THEN 'sides_equal' END AS problem FROM orders) WHERE problem IS NOT NULL""",
    "policy_unfit": """SELECT DISTINCT * FROM (SELECT p_name AS policy_id, CASE WHEN p_type = 'ECONOMY' THEN 'unknown_rule' WHEN p_brand < 'Brand#3' AND p_size % 2 = 1 THEN 'kind_not_allowed' WHEN p_size < 5 THEN 'unknown_severity' WHEN p_size > 40 THEN 'id_and_prefix' END AS problem FROM part
        UNION ALL SELECT p_name, 'repeated_id' FROM part GROUP BY p_name HAVING count(*) > 1) WHERE problem IS NOT NULL""",
    "batch_sums": f"""SELECT batch, count(*) AS n_commands, CAST(sum(1 + p_size) AS BIGINT) AS total_size, CAST(sum(p_size * 5 % 97) AS BIGINT) AS total_attributes FROM ({_SQL["batch_pack"]}) JOIN part USING (p_partkey) GROUP BY batch""",
    "plan_blocking": "SELECT local_id, 'description' AS field FROM ({assumptions}) WHERE NOT safe",
    "stale_decisions": "SELECT o_custkey AS local_id, o_orderkey AS field, o_orderstatus AS digest FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'",
    "text_functions": r"""WITH p AS (SELECT *, ' <' || p_name || '> & ''x'' "%"' || chr(10) || ' ' AS odd FROM part)
        SELECT p_partkey, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 7) || '…' ELSE p_name END AS short, replace(replace(replace(replace(replace(odd, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html,
          replace(replace(odd, '%', '%25'), chr(10), '%0A') AS workflow, trim(odd, ' ' || chr(10)) AS stripped, lower(p_brand) AS folded, replace(p_brand, '#', '\#') AS markdown, replace(odd, chr(10), '\n') AS line, p_size < 9 AS blank FROM p""",
    "canonical_texts": r"""SELECT page_id, '{"n":[1,2.0,true,null],"url":"' || url || '","\u00e9":{"a":"\u20ac","b":1}}' AS canonical, '"' || url || '\u20ac\n\""' AS escaped, sha256('gov-policy-v1' || chr(10) || url) AS digest FROM pages""",
    "plan_order": f"""WITH {_CATALOGS}, a AS (SELECT action, CASE WHEN local_id LIKE '%3' THEN 'table' ELSE 'column' END AS kind, local_id, CASE WHEN action <> 'create' THEN 'r' || substr(local_id, 5, 1) END AS remote_id FROM plan)
        SELECT *, row_number() OVER (ORDER BY action, kind, coalesce(local_id, ''), coalesce(remote_id, '')) - 1 AS position FROM a""",
    "execution_positions": f"WITH {_CATALOGS} SELECT local_id, row_number() OVER (ORDER BY CASE action WHEN 'create' THEN 1 ELSE 2 END, local_id) - 1 AS position FROM plan WHERE action IN ('create', 'update')",
    "observation_order": f"""WITH {_OBS}, said AS (SELECT object_key, ns, pointer, v, string_agg(DISTINCT '{{"observation_mode":"observed","provider_type":"' || provider || '","source_ref":"' || ref || '","source_version":null}}', ',' ORDER BY '{{"observation_mode":"observed","provider_type":"' || provider || '","source_ref":"' || ref || '","source_version":null}}') AS p FROM obs GROUP BY ALL)
        SELECT object_key, pointer, v AS value_json, row_number() OVER (ORDER BY object_key, '"' || pointer || '"', '[' || p || ']', v) - 1 AS position FROM said""",
    "preflight_status": """SELECT c_nationkey AS report, CASE WHEN max(CAST(c_acctbal < -900 AS INT)) = 1 THEN 'INCOMPATIBLE' WHEN bool_or(c_acctbal < 0 AND c_mktsegment = 'BUILDING') THEN 'NOT_VERIFIED'
        WHEN bool_or(c_acctbal < 0 AND c_mktsegment = 'MACHINERY') THEN 'WARNING' ELSE 'VERIFIED' END AS overall FROM customer GROUP BY c_nationkey""",
    "history_unfit_entries": """WITH e AS (SELECT o_orderkey AS entry_index, o_orderstatus AS s, CAST(substr(o_orderpriority, 1, 1) AS INT) AS n, o_custkey % 7 < 2 AS bare, o_orderkey % 10 < 8 AS known FROM orders)
        SELECT entry_index, problem FROM (SELECT entry_index, CASE s WHEN 'F' THEN CASE WHEN n IN (3, 5) THEN CASE WHEN bare THEN 'content_identity' END ELSE 'authority_missing' END WHEN 'O' THEN CASE WHEN n = 2 THEN CASE WHEN bare THEN 'content_identity' END ELSE 'observations_only' END
        ELSE CASE WHEN NOT known THEN 'unknown_context' WHEN n > 1 THEN 'snapshot_only' WHEN bare THEN 'content_identity' END END AS problem FROM e) WHERE problem IS NOT NULL""",
}


def sql() -> dict[str, str]:
    from .catalog_plans import SQL as plans

    return SQL | {"plan_blocking": SQL["plan_blocking"].format(assumptions=plans["plan_assumptions"])}
