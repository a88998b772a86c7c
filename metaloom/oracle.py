"""SQL for the registered queries, written from the meaning of each and not from its DataFrame code."""

from __future__ import annotations

_NODES = """nodes AS (
  SELECT 'r:' || r_regionkey AS k, 'data_source' AS kind, NULL AS up FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'dataset', 'r:' || n_regionkey FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'table', 'n:' || c_nationkey FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'contract', 'n:' || s_nationkey FROM supplier
  UNION ALL SELECT 'o:' || o_orderkey, 'transformation', NULL FROM orders
  UNION ALL SELECT 'p:' || p_partkey, 'contract', NULL FROM part
), ups AS (SELECT k, up FROM nodes WHERE up IS NOT NULL UNION ALL SELECT a.k, b.up FROM nodes a JOIN nodes b ON a.up = b.k WHERE b.up IS NOT NULL)"""

_EDGES = f"""{_NODES}, edges AS (
  SELECT up AS src, 'contains' AS kind, k AS dst FROM nodes WHERE up IS NOT NULL
  UNION SELECT 'o:' || o_orderkey, 'depends_on', 'c:' || o_custkey FROM orders
  UNION SELECT 'o:' || l_orderkey, 'depends_on', 's:' || l_suppkey FROM lineitem
  UNION SELECT 'p:' || p_partkey, 'governs', dst FROM (
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'c:' || p_partkey WHEN 1 THEN 'n:' || (p_partkey % 25) ELSE 'r:' || (p_partkey % 5) END AS dst FROM part) WHERE dst IN (SELECT k FROM nodes)
)"""

_ROOTS = "roots AS (SELECT unnest(['n:3', 'n:7', 'c:15', 'p:6']) AS k)"

#: No root reaches more than three layers here, so the search is written out layer by layer.
_LAYERS = f"""{_EDGES}, {_ROOTS}, hops AS MATERIALIZED (
  SELECT CASE WHEN kind = 'depends_on' THEN dst ELSE src END AS a, CASE WHEN kind = 'depends_on' THEN src ELSE dst END AS b,
         '[' || kind || ',' || src || ',' || dst || ']' AS step FROM edges
), l0 AS MATERIALIZED (SELECT k AS target, 0 AS distance, k AS root, k AS path FROM roots),
l1 AS MATERIALIZED (SELECT b AS target, 1 AS distance, arg_min(root, path || '>' || step) AS root, min(path || '>' || step) AS path
       FROM l0 JOIN hops ON a = target ANTI JOIN roots ON b = roots.k GROUP BY b),
l2 AS MATERIALIZED (SELECT b AS target, 2 AS distance, arg_min(l1.root, l1.path || '>' || step) AS root, min(l1.path || '>' || step) AS path
       FROM l1 JOIN hops ON a = l1.target ANTI JOIN roots ON b = roots.k ANTI JOIN l1 AS x ON b = x.target GROUP BY b),
l3 AS MATERIALIZED (SELECT b AS target, 3 AS distance, arg_min(l2.root, l2.path || '>' || step) AS root, min(l2.path || '>' || step) AS path
       FROM l2 JOIN hops ON a = l2.target ANTI JOIN roots ON b = roots.k ANTI JOIN l1 AS x ON b = x.target ANTI JOIN l2 AS y ON b = y.target GROUP BY b),
found AS MATERIALIZED (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3),
closure AS MATERIALIZED (SELECT k FROM roots UNION ALL SELECT target FROM found)"""

_OBS = """obs AS (
  SELECT 'u:' || user_id AS object_key, 'ns' || (user_id % 2) AS ns, '/attributes/' || event_type AS pointer,
         CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS v, CASE event_id % 3 WHEN 0 THEN 'odcs' WHEN 1 THEN 'dbt' ELSE 'openlineage' END AS provider, 's' || (event_id % 5) AS ref, ts
  FROM events
)"""

_RULES = """rules(pointer, ns, provider, ref) AS (
  VALUES ('/attributes/view', NULL, 'odcs', NULL), ('/attributes/view', 'ns1', 'dbt', NULL), ('/attributes/click', NULL, 'dbt', 's1'),
         ('/attributes/purchase', NULL, 'odcs', NULL), ('/attributes/purchase', NULL, 'openlineage', NULL), ('/attributes/scroll', NULL, 'openlineage', 's4')
)"""


def _decided(obs: str, rules: str) -> str:
    """Decisions over a relation obs(object_key, ns, pointer, v, provider, ref) and rules."""
    return f"""{obs}, {rules}, facts AS (SELECT DISTINCT object_key, ns, pointer, v, provider, ref FROM obs),
groups AS (SELECT object_key, ns, pointer, count(DISTINCT v) AS n_values, count(*) AS n_sources FROM facts GROUP BY ALL),
ranked AS (SELECT g.object_key, g.pointer, r.provider, r.ref, rank() OVER (PARTITION BY g.object_key, g.pointer ORDER BY CASE WHEN r.ns IS NULL THEN 1 ELSE 0 END) AS rk
           FROM groups g JOIN rules r ON r.pointer = g.pointer AND (r.ns IS NULL OR r.ns = g.ns) WHERE g.n_values > 1),
best AS (SELECT object_key, pointer, count(*) AS n_rules, min(provider) AS provider, min(ref) AS ref FROM ranked WHERE rk = 1 GROUP BY ALL),
allowed AS (SELECT f.object_key, f.pointer, count(DISTINCT f.v) AS n_allowed, min(f.v) AS v FROM facts f JOIN best b USING (object_key, pointer)
            WHERE b.n_rules = 1 AND f.provider = b.provider AND (b.ref IS NULL OR f.ref = b.ref) GROUP BY ALL),
reasons AS (SELECT g.*, b.n_rules, b.provider AS authority, a.v AS allowed_v,
              CASE WHEN n_values = 1 AND n_sources = 1 THEN 'SINGLE_OBSERVATION' WHEN n_values = 1 THEN 'AGREEMENT' WHEN n_rules IS NULL THEN 'NO_AUTHORITY_RULE'
                   WHEN n_rules > 1 THEN 'INVALID_OR_AMBIGUOUS_AUTHORITY' WHEN n_allowed IS NULL THEN 'AUTHORITATIVE_SOURCE_NOT_OBSERVED'
                   WHEN n_allowed = 1 THEN 'RESOLVED_BY_AUTHORITY' ELSE 'AUTHORITATIVE_SOURCE_CONFLICTED' END AS reason
            FROM groups g LEFT JOIN best b USING (object_key, pointer) LEFT JOIN allowed a USING (object_key, pointer)),
decided AS (SELECT *, CASE WHEN reason LIKE 'AUTHORITATIVE%' OR reason = 'NO_AUTHORITY_RULE' THEN 'UNRESOLVED_CONFLICT' ELSE reason END AS state FROM reasons)"""


_DAILY = _OBS.replace("'u:' || user_id AS", "'u:' || user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS")
_DECIDED = _decided(_DAILY, _RULES)

_MAPPED = """mapped AS (SELECT * FROM (VALUES ('/attributes/view', '/name'), ('/attributes/click', '/description'), ('/attributes/purchase', '/attributes/data_type')) t(a, b))"""
_SAFETY = _decided(
    f"""daily AS (WITH {_DAILY} SELECT * FROM obs), {_MAPPED}, obs AS (
  SELECT object_key, ns, coalesce(b, pointer) AS pointer, CASE v WHEN '3' THEN 'null' WHEN '4' THEN '" "' WHEN '5' THEN '5' ELSE '"v' || v || '"' END AS v, provider, ref
  FROM daily LEFT JOIN mapped ON a = pointer)""",
    f"""old_rules AS (WITH {_RULES} SELECT * FROM rules), rules AS (SELECT coalesce(b, pointer) AS pointer, ns, provider, ref FROM old_rules LEFT JOIN mapped ON a = pointer)""",
)

_SIDES = """base AS (SELECT 'o:' || o_orderkey AS object_key, unnest(['/status', '/priority', '/customer']) AS pointer,
    true AS has, unnest(['"' || o_orderstatus || '"', '"' || o_orderpriority || '"', CAST(o_custkey AS VARCHAR)]) AS json FROM orders WHERE o_orderpriority <> '5-LOW'),
cand AS (SELECT 'o:' || o_orderkey AS object_key, unnest(['/status', '/priority', '/customer']) AS pointer,
    unnest([true, true, o_orderkey % 13 <> 0]) AS has,
    unnest(['"' || CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END || '"', CASE WHEN o_orderkey % 11 = 0 THEN 'null' ELSE '"' || o_orderpriority || '"' END,
            CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_custkey AS VARCHAR) END]) AS json FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'),
props AS (SELECT object_key, pointer, b.has AS base_has, b.json AS base_json, c.has AS cand_has, c.json AS cand_json
          FROM base b JOIN cand c USING (object_key, pointer) WHERE b.has <> c.has OR b.json IS DISTINCT FROM c.json),
changes AS (SELECT object_key, CASE WHEN NOT bool_or(s = 1) THEN 'added' WHEN NOT bool_or(s = 2) THEN 'removed' WHEN object_key IN (SELECT object_key FROM props) THEN 'changed' ELSE 'unchanged' END AS change,
            (SELECT count(*) FROM props p WHERE p.object_key = u.object_key) AS n_properties
            FROM (SELECT object_key, 1 AS s FROM base UNION SELECT object_key, 2 FROM cand) u GROUP BY object_key)"""

_DRIFT = f"""{_SIDES}, rules AS (
  SELECT 'o:' || o_orderkey AS object_key, o_orderkey, unnest(['added', 'changed', 'changed']) AS change, unnest([NULL, '/status', '/priority']) AS pointer FROM orders WHERE o_orderstatus <> 'P'
), diffs AS (
  SELECT change, object_key, NULL AS pointer, NULL AS base_json, NULL AS cand_json, false AS cand_has FROM changes WHERE change IN ('added', 'removed')
  UNION ALL SELECT 'changed', object_key, pointer, base_json, cand_json, cand_has FROM props
), classified AS (
  SELECT d.change, d.object_key, d.pointer,
    CASE WHEN r.object_key IS NULL THEN 'unmatched_difference' WHEN d.change = 'added' THEN 'presence_rule'
         WHEN d.pointer = '/status' AND d.cand_has AND d.cand_json = '"X"' THEN 'expectation_met'
         WHEN d.pointer = '/priority' AND d.base_json = '"1-URGENT"' THEN 'expectation_met' ELSE 'expectation_mismatch' END AS reason,
    CASE WHEN r.object_key IS NULL THEN '' WHEN d.change = 'added' THEN 'add-' || r.o_orderkey WHEN d.pointer = '/status' THEN 'status-' || r.o_orderkey
         ELSE 'again-' || r.o_orderkey || ',priority-' || r.o_orderkey END AS rule_ids
  FROM diffs d LEFT JOIN rules r ON d.object_key = r.object_key AND d.change = r.change AND d.pointer IS NOT DISTINCT FROM r.pointer
), drift AS (SELECT *, CASE WHEN reason IN ('presence_rule', 'expectation_met') THEN 'expected' ELSE 'unexpected' END AS classification FROM classified)"""

_VIOLATIONS = """objects AS (
  SELECT 'tbl:customer/' || c_custkey AS local_id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '  ' ELSE c_mktsegment END AS owner, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS description FROM customer
  UNION ALL SELECT 'tbl:supplier/' || s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END, s_name FROM supplier
  UNION ALL SELECT 'tbl:part_1/' || p_partkey, p_name, p_brand, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END FROM part
), violations AS (
  SELECT 'owner-all' AS policy_id, 'error' AS severity, 'require_owner' AS rule_type, 'table' AS kind, local_id, name, 'missing_owner' AS reason FROM objects WHERE trim(coalesce(owner, '')) = ''
  UNION ALL SELECT 'owner-supplier', 'warning', 'require_owner', 'table', local_id, name, 'missing_owner' FROM objects WHERE trim(coalesce(owner, '')) = '' AND starts_with(local_id, 'tbl:supplier/')
  UNION ALL SELECT 'describe-parts', 'info', 'require_description', 'table', local_id, name, 'missing_description' FROM objects WHERE trim(coalesce(description, '')) = '' AND starts_with(local_id, 'tbl:part_1/')
  UNION ALL SELECT 'describe-one', 'error', 'require_description', 'table', local_id, name, 'missing_description' FROM objects WHERE trim(coalesce(description, '')) = '' AND local_id = 'tbl:customer/11'
  UNION ALL SELECT 'related', 'warning', 'require_relationship', 'table', local_id, name, 'missing_relationship' FROM objects WHERE starts_with(local_id, 'tbl:customer/') AND local_id NOT IN (SELECT 'tbl:customer/' || o_custkey FROM orders)
)"""

_TIMELINE = """days AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS i FROM events),
seen AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS i, 'u:' || user_id AS object_key, '/' || event_type AS pointer,
                CAST(arg_max(CAST(floor(value / 10) AS BIGINT), (ts, event_id)) AS VARCHAR) AS v FROM events GROUP BY ALL),
grid AS (SELECT i, object_key, pointer, v FROM (SELECT DISTINCT object_key, pointer FROM seen) CROSS JOIN days LEFT JOIN seen USING (i, object_key, pointer)),
moves AS (SELECT object_key, pointer, lag(i) OVER w AS from_index, i AS to_index, lag(v) OVER w AS a, v AS b FROM grid WINDOW w AS (PARTITION BY object_key, pointer ORDER BY i)),
transitions AS (SELECT *, CASE WHEN a IS NULL AND b IS NOT NULL THEN 'added' WHEN a IS NOT NULL AND b IS NULL THEN 'removed' WHEN a IS NOT DISTINCT FROM b THEN 'unchanged' ELSE 'changed' END AS change FROM moves WHERE from_index IS NOT NULL)"""

_CATALOGS = """desired AS (SELECT 'tbl:' || c_custkey AS local_id, c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS display, c_mktsegment AS segment, c_nationkey AS nation FROM customer WHERE c_mktsegment <> 'BUILDING'),
all_remote AS (SELECT CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE 'tbl:' || c_custkey END AS local_id, CASE WHEN c_custkey % 5 = 0 THEN c_name || '!' ELSE c_name END AS name,
    CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS display, CASE WHEN c_custkey % 6 = 0 THEN 'NONE' ELSE c_mktsegment END AS segment, c_nationkey AS nation, c_custkey % 19 <> 0 AND c_custkey % 17 <> 0 AS managed FROM customer WHERE c_mktsegment <> 'MACHINERY'),
remote AS (SELECT * FROM all_remote WHERE managed),
plan AS (SELECT coalesce(d.local_id, r.local_id) AS local_id,
    CASE WHEN r.local_id IS NULL THEN 'create' WHEN d.local_id IS NULL THEN 'remote_only' WHEN d.name <> r.name OR d.segment <> r.segment THEN 'update' ELSE 'unchanged' END AS action,
    CASE WHEN d.local_id IS NULL OR r.local_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN d.name <> r.name THEN 'name' END, CASE WHEN d.segment <> r.segment THEN 'managed_attributes' END) END AS changed_fields
  FROM desired d FULL JOIN remote r ON d.local_id = r.local_id)"""

SQL = {
    "graph_merge_edges": """WITH p AS (SELECT DISTINCT 'o:' || l_orderkey AS src_key, 's:' || l_suppkey AS dst_key, 'm' || (l_partkey % 3) || '/' || l_returnflag AS s FROM lineitem)
        SELECT src_key, dst_key, count(*) AS n_sources, string_agg(s, ',' ORDER BY s) AS sources FROM p GROUP BY ALL""",
    "graph_dangling": f"""WITH {_EDGES} SELECT src AS src_key, kind, dst AS dst_key, 'src' AS side FROM edges WHERE src IN (SELECT 'o:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
    "graph_missing_ancestors": f"""WITH {_NODES} SELECT k AS node_key, up AS ancestor_key FROM ups WHERE up = 'n:5'""",
    "impact_distance": f"""WITH {_LAYERS} SELECT target AS node_key, distance FROM l0 UNION ALL SELECT target, distance FROM found""",
    "impact_paths": f"""WITH {_LAYERS} SELECT target, distance, root, path AS path_key FROM found""",
    "impact_affected_edges": f"""WITH {_LAYERS} SELECT src AS src_key, kind, dst AS dst_key FROM edges SEMI JOIN closure AS a ON src = a.k SEMI JOIN closure AS b ON dst = b.k""",
    "impact_assets": f"""WITH {_LAYERS} SELECT k AS node_key, kind FROM nodes SEMI JOIN (SELECT k FROM closure UNION SELECT up FROM ups SEMI JOIN closure USING (k)) AS c USING (k) WHERE kind <> 'contract'""",
    "impact_contracts": f"""WITH {_LAYERS}, core AS (SELECT k FROM closure UNION SELECT up FROM ups SEMI JOIN closure USING (k))
        SELECT k AS node_key FROM closure WHERE k LIKE 's:%' OR k LIKE 'p:%' UNION SELECT src FROM edges SEMI JOIN core ON dst = core.k WHERE kind = 'governs'""",
    "impact_policy_nodes": f"""WITH {_LAYERS} SELECT k AS node_key, kind FROM nodes SEMI JOIN closure USING (k) WHERE kind IN ('data_source', 'dataset', 'table', 'column')""",
    "impact_evidence": f"""WITH {_LAYERS}, walked AS (SELECT unnest(string_split(path, '>')[2:]) AS step FROM found)
        SELECT DISTINCT step FROM walked""",
    "impact_policies": f"""WITH {_LAYERS}, local AS (SELECT 'tbl:customer/' || substr(k, 3) AS local_id FROM closure WHERE k LIKE 'c:%')
        SELECT 'owner-all' AS policy_id, local_id FROM local UNION ALL SELECT 'related', local_id FROM local UNION ALL SELECT 'describe-one', local_id FROM local WHERE local_id = 'tbl:customer/11'""",
    "impact_workspace": f"""WITH {_LAYERS} SELECT CASE WHEN distance IS NULL THEN 'none' WHEN distance = 0 THEN 'root' WHEN distance = 1 THEN 'direct' ELSE 'transitive' END AS impact, count(*) AS n_nodes
        FROM nodes LEFT JOIN (SELECT target, distance FROM l0 UNION ALL SELECT target, distance FROM found) ON target = k GROUP BY ALL""",
    "lineage_materialize": """SELECT 'o:' || l_orderkey || '/price' AS src_key, 'p:' || l_partkey || '/price' AS dst_key, count(DISTINCT l_returnflag) AS n_sources FROM lineitem GROUP BY ALL""",
    "obs_normalize": f"""WITH {_OBS}, f AS (SELECT DISTINCT object_key, pointer, v, provider || '/' || ref AS s FROM obs) SELECT object_key, pointer, v AS value_json, string_agg(s, ',' ORDER BY s) AS sources FROM f GROUP BY ALL""",
    "conflict_states": f"""WITH {_DECIDED} SELECT object_key, pointer, state, reason, n_values, n_sources FROM decided""",
    "conflict_resolved": f"""WITH {_DECIDED}, one AS (SELECT object_key, pointer, min(v) AS v FROM facts GROUP BY ALL)
        SELECT object_key, pointer, CASE WHEN n_values = 1 THEN one.v ELSE allowed_v END AS effective_json, CASE WHEN n_values > 1 THEN authority END AS authority
        FROM decided JOIN one USING (object_key, pointer) WHERE state IN ('SINGLE_OBSERVATION', 'AGREEMENT', 'RESOLVED_BY_AUTHORITY')""",
    "conflict_summary": f"""WITH {_DECIDED} SELECT state, reason, count(*) AS n_properties FROM decided GROUP BY ALL""",
    "conflict_ambiguous_rules": """SELECT 'table' AS kind, '/attributes/' || p_type AS pointer, CASE WHEN p_size % 2 = 1 THEN 'ns' || p_size % 3 END AS namespace, count(DISTINCT p_brand) AS n_authorities FROM part GROUP BY ALL HAVING count(DISTINCT p_brand) > 1""",
    "reconcile_safety": f"""WITH {_SAFETY}, one AS (SELECT object_key, pointer, min(v) AS v FROM facts GROUP BY ALL), e AS (
          SELECT d.*, CASE WHEN n_values = 1 THEN one.v ELSE allowed_v END AS value, CASE pointer WHEN '/name' THEN 'display_name' WHEN '/description' THEN 'description' END AS field FROM decided d JOIN one USING (object_key, pointer))
        SELECT state, CASE WHEN field IS NULL THEN 'not_reconciliation_mapped' WHEN state = 'UNRESOLVED_CONFLICT' THEN 'unresolved_conflict' WHEN state LIKE 'INVALID%' THEN 'invalid_or_ambiguous_authority'
          WHEN value = 'null' OR (value LIKE '"%' AND (field = 'description' OR value <> '" "')) THEN 'safe' ELSE 'unsupported_effective_value' END AS assessment, count(*) AS n_properties FROM e GROUP BY ALL""",
    "compare_objects": f"""WITH {_SIDES} SELECT * FROM changes""",
    "compare_properties": f"""WITH {_SIDES} SELECT * FROM props""",
    "compare_summary": f"""WITH {_SIDES} SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'changed') AS changed,
        count(*) FILTER (WHERE change = 'unchanged') AS unchanged, CAST(sum(n_properties) AS BIGINT) AS property_changes, 'different' AS status FROM changes""",
    "compare_inverse": "SELECT CAST(0 AS BIGINT) AS n_differences",
    "drift_classified": f"""WITH {_DRIFT} SELECT change, object_key, pointer, classification, reason, rule_ids FROM drift""",
    "drift_summary": f"""WITH {_DRIFT} SELECT count(*) FILTER (WHERE classification = 'expected') AS expected, count(*) FILTER (WHERE classification = 'unexpected') AS unexpected, count(DISTINCT object_key) AS affected_objects,
        count(pointer) AS property_drift, 'unexpected_drift' AS status FROM drift""",
    "drift_ambiguous_rules": """SELECT 'o:' || o_orderkey AS object_key, '/status' AS pointer, CAST(2 AS BIGINT) AS n_expectations, 'other-status-' || o_orderkey || ',status-' || o_orderkey AS rule_ids FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 10 = 9""",
    "policy_violations": f"""WITH {_VIOLATIONS} SELECT * FROM violations""",
    "policy_counts": f"""WITH {_VIOLATIONS} SELECT severity, count(*) AS n_violations FROM violations GROUP BY severity""",
    "top_violations": f"""WITH {_VIOLATIONS} SELECT *, (SELECT count(*) FROM violations) AS n_all FROM violations ORDER BY CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, policy_id, kind, local_id, rule_type, reason LIMIT 20""",
    "history_transitions": f"""WITH {_TIMELINE} SELECT from_index, to_index, change, count(*) AS n_properties FROM transitions GROUP BY ALL""",
    "history_evolution": f"""WITH {_TIMELINE} SELECT pointer, from_index, to_index, a IS NOT NULL AS base_has, a AS base_json, b IS NOT NULL AS cand_has, b AS cand_json, change FROM transitions WHERE object_key = 'u:7' AND change <> 'unchanged'""",
    "history_adjacent_duplicates": """SELECT o_custkey AS timeline, o_orderkey AS order_key, o_orderstatus AS state_digest FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b = o_orderstatus""",
    "history_known": f"""WITH {_TIMELINE} SELECT object_key, count(DISTINCT i) AS n_entries FROM seen GROUP BY object_key""",
    "sync_plan_assets": f"""WITH {_CATALOGS} SELECT * FROM plan""",
    "sync_plan_counts": f"""WITH {_CATALOGS} SELECT action, count(*) AS n_actions FROM plan GROUP BY action""",
    "sync_unmanaged": f"""WITH {_CATALOGS} SELECT count(*) FILTER (WHERE managed) AS managed, count(*) FILTER (WHERE NOT managed) AS ignored FROM all_remote""",
    "sync_plan_relationships": """WITH d AS (SELECT o_custkey AS s, o_orderkey AS t, o_orderstatus AS y FROM orders WHERE o_orderstatus <> 'P'),
        r AS (SELECT o_custkey AS s, o_orderkey AS t, CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS y FROM orders WHERE o_orderstatus <> 'F')
        SELECT coalesce(d.s, r.s) AS source_id, coalesce(d.t, r.t) AS target_id, coalesce(d.y, r.y) AS type_ref, CASE WHEN r.s IS NULL THEN 'create' WHEN d.s IS NULL THEN 'remote_only' ELSE 'unchanged' END AS action FROM d FULL JOIN r ON d.s = r.s AND d.t = r.t AND d.y = r.y""",
    "sync_overlay": f"""WITH {_CATALOGS} SELECT d.local_id, CASE WHEN d.k % 2 = 0 OR d.k % 3 = 0 THEN d.segment WHEN d.k % 7 <> 0 THEN 'd' || d.k ELSE r.segment END AS segment, CAST(d.nation AS VARCHAR) AS nation FROM desired d LEFT JOIN remote r USING (local_id)""",
    "stale_categories": """SELECT 'mapping' AS category""",
    "batch_pack": """WITH RECURSIVE p AS (SELECT p_partkey, 1 + p_size AS size, p_size * 5 % 97 AS attributes, row_number() OVER (ORDER BY p_partkey) AS i FROM part),
        walk AS (SELECT i, p_partkey, CAST(size AS BIGINT) AS size, CAST(attributes AS BIGINT) AS attributes, CAST(0 AS BIGINT) AS batch FROM p WHERE i = 1
          UNION ALL SELECT p.i, p.p_partkey, CASE WHEN w.size + p.size > 500 OR w.attributes + p.attributes > 2000 THEN p.size ELSE w.size + p.size END,
            CASE WHEN w.size + p.size > 500 OR w.attributes + p.attributes > 2000 THEN p.attributes ELSE w.attributes + p.attributes END,
            w.batch + CASE WHEN w.size + p.size > 500 OR w.attributes + p.attributes > 2000 THEN 1 ELSE 0 END FROM walk w JOIN p ON p.i = w.i + 1)
        SELECT p_partkey, batch FROM walk""",
    "relation_hosts": """SELECT 'c:' || o_custkey AS source_id, 'o:' || o_orderkey AS target_id, CASE WHEN o_custkey * 10 > o_orderkey * 2 + 1 THEN 'c:' || o_custkey ELSE 'o:' || o_orderkey END AS host FROM orders""",
    "pointer_escape": """SELECT page_id, '/pages/' || replace(replace(url || '~x', '~', '~0'), '/', '~1') AS pointer, true AS round_trip FROM pages""",
    "identity_digest": """WITH k AS (SELECT n_nationkey, '["ns","table","' || n_name || '",["ns","schema","' || n_regionkey || '",null]]' AS node_key FROM nation) SELECT n_nationkey, node_key, sha256('gov-graph-v1' || chr(10) || node_key) AS digest FROM k""",
    "physical_projection": """SELECT c_custkey, 'col:' || n_regionkey || '/' || n_name || '/' || c_mktsegment || '/' || c_name AS local_id FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}
