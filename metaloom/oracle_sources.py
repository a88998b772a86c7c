"""SQL for the queries over documents and system tables."""

from __future__ import annotations

_CATALOG = """tabs AS (SELECT c_custkey AS k, c_name AS name, n_name AS sch, 'src/shop/' || n_name || '/' || c_name AS path, r_name AS owner, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS said, n_regionkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = c_custkey % 5 WHERE c_custkey % 10 <> 9),
cols AS (SELECT o_orderkey AS o, t.k, 'o' || o_orderkey AS name, t.path || '/o' || o_orderkey AS path, t.path AS up, o_orderpriority AS kind, o_orderstatus <> 'F' AS nullable, CASE WHEN o_orderstatus = 'P' THEN 'pending' END AS said
  FROM orders JOIN tabs t ON o_custkey = t.k WHERE o_orderpriority <> '5-LOW'),
every AS (SELECT o_orderkey AS o, o_custkey AS k, 'src/shop/' || n_name || '/' || c_name AS up, 'src/shop/' || n_name || '/' || c_name || '/o' || o_orderkey AS path
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority <> '5-LOW'),
pks AS (SELECT up, string_agg('col:' || path, ',' ORDER BY o) AS columns FROM every WHERE o % 4 = 0 GROUP BY up),
firsts AS (SELECT k, up, min(o) AS o, arg_min(path, o) AS path FROM every GROUP BY k, up),
fks AS (SELECT a.up, 'col:' || a.path AS columns, 'col:' || b.path AS to_columns, b.up AS target FROM firsts a JOIN firsts b ON b.k = a.k + 1 WHERE a.k % 3 = 0 AND a.k % 10 <> 9 AND b.k % 10 <> 9),
objects AS (
  SELECT 'database' AS kind, 'db:src/shop' AS local_id, 'ds:src' AS parent_id, 'shop' AS name, (SELECT r_name FROM region WHERE r_regionkey = 0) AS owner, 'the shop' AS description
  UNION ALL SELECT 'schema', 'sch:src/shop/' || n_name, 'db:src/shop', n_name, r_name, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'table', 'tbl:' || path, 'sch:src/shop/' || sch, name, owner, said FROM tabs
  UNION ALL SELECT 'column', 'col:' || path, 'tbl:' || up, name, NULL, said FROM cols
  UNION ALL SELECT 'primary_key', 'pk:' || up || '/pk', 'tbl:' || up, 'pk', NULL, NULL FROM pks
  UNION ALL SELECT 'foreign_key', 'fk:' || up || '/fk', 'tbl:' || up, 'fk', NULL, NULL FROM fks)"""

_INDEX = f"""{_CATALOG}, idx AS (
  SELECT 'db:src/shop' AS local_id, 'data_source' AS kind, '["ns","data_source","shop",null]' AS node_key
  UNION ALL SELECT 'sch:src/shop/' || n_name, 'dataset', '["ns","dataset","' || n_name || '",["ns","data_source","shop",null]]' FROM nation
  UNION ALL SELECT 'tbl:' || path, 'table', '["ns","table","' || name || '",["ns","dataset","' || sch || '",["ns","data_source","shop",null]]]' FROM tabs
  UNION ALL SELECT 'col:' || c.path, 'column', '["ns","column","' || c.name || '",["ns","table","' || t.name || '",["ns","dataset","' || sch || '",["ns","data_source","shop",null]]]]' FROM cols c JOIN tabs t USING (k))"""

_DBT = """db AS (SELECT '["ns","data_source","db",null]' AS k), models AS (
  SELECT c_custkey, c_nationkey, 'c' || c_custkey AS name, c_mktsegment AS seg, c_name AS description, c_mktsegment = 'FURNITURE' AS eph, c_mktsegment = 'FURNITURE' OR c_acctbal >= 0 AS fit,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN '["ns","transformation","[\\"p\\",[\\"p\\",\\"c' || c_custkey || '\\"]]",null]' ELSE '["ns","table","c' || c_custkey || '",["ns","dataset","' || c_mktsegment || '",' || k || ']]' END AS node_key,
    '{"dbt_name":"c' || c_custkey || '","dbt_resource_type":"model","fqn":["p","c' || c_custkey || '"],"materialized":"' || CASE WHEN c_mktsegment = 'FURNITURE' THEN 'ephemeral' ELSE 'table' END || '","package_name":"p"}' AS attributes
  FROM customer CROSS JOIN db),
kept AS (SELECT * FROM models WHERE fit),
sources AS (SELECT DISTINCT c_nationkey, 'n' || c_nationkey AS name, '["ns","table","n' || c_nationkey || '",["ns","dataset","raw",["ns","data_source","db",null]]]' AS node_key,
    '{"dbt_name":"n' || c_nationkey || '","dbt_resource_type":"source","fqn":["p","raw","n' || c_nationkey || '"],"package_name":"p","source_name":"raw"}' AS attributes FROM customer),
ids AS (SELECT '["ns","column","id",' || node_key || ']' AS node_key, node_key AS up FROM kept),
places AS (SELECT DISTINCT seg AS name FROM kept WHERE NOT eph UNION SELECT 'raw')"""

_ODCS = r"""parts AS (SELECT p_partkey AS k, p_name AS name, p_size, '["ns","contract","p' || p_partkey || '",null]' AS contract, '["ns","dataset","d' || p_partkey || '",null]' AS dataset,
  '{"tenant":"' || lower(p_brand) || '","version":"1.0"}' AS attributes FROM part WHERE p_type <> 'ECONOMY'),
cols AS (
  SELECT '["ns","column","key",' || dataset || ']' AS node_key, dataset AS up, 'key' AS name, '{"data_type":"integer","logical_type":"integer","primary_key":true}' AS attributes FROM parts
  UNION ALL SELECT '["ns","column","b",' || dataset || ']', dataset, 'brand', '{}' FROM parts
  UNION ALL SELECT '["ns","column","maker",["ns","column","b",' || dataset || ']]', '["ns","column","b",' || dataset || ']', 'maker', '{"tags":["a","z"]}' FROM parts
  UNION ALL SELECT '["ns","column","lists",' || dataset || ']', dataset, 'lists', '{}' FROM parts
  UNION ALL SELECT '["ns","column","s' || p_size || '",["ns","column","lists",' || dataset || ']]', '["ns","column","lists",' || dataset || ']', 's' || p_size, '{"data_type":"integer","logical_type":"integer"}' FROM parts),
nodes AS (
  SELECT contract AS node_key, 'contract' AS kind, name, attributes AS attributes_json FROM parts
  UNION ALL SELECT dataset, 'dataset', 'd' || k, '{}' FROM parts
  UNION ALL SELECT node_key, 'column', name, attributes FROM cols)"""

_RUNS = r"""runs AS (SELECT c_custkey AS k, 'n' || c_nationkey AS nation, '["ns","table","n' || c_nationkey || '",["ns","dataset","s",["ns","data_source","db",null]]]' AS source,
  'c' || c_custkey AS name, '["ns","dataset","[\"w\",\"c' || c_custkey || '\"]",null]' AS target, lower(c_mktsegment) AS layer FROM customer),
froms AS (SELECT DISTINCT nation, source FROM runs),
segments AS (SELECT DISTINCT layer, '["ns","dataset","[\"w\",\"' || upper(layer) || '\"]",null]' AS segment, '[{"name":"' || layer || '","type":"lead"},{"name":"' || layer || '","type":"team"}]' AS owners FROM runs),
nodes AS (
  SELECT '["ns","data_source","db",null]' AS node_key, 'data_source' AS kind, 'db' AS name, '{}' AS attributes_json
  UNION ALL SELECT '["ns","dataset","s",["ns","data_source","db",null]]', 'dataset', 's', '{}'
  UNION ALL SELECT source, 'table', nation, '{}' FROM froms
  UNION ALL SELECT '["ns","column","total",' || source || ']', 'column', 'total', '{}' FROM froms
  UNION ALL SELECT target, 'dataset', name, '{"dataset_type":"' || CASE layer WHEN 'machinery' THEN 'TABLE' ELSE 'VIEW' END || '","storage_layer":"' || layer || '"}' FROM runs
  UNION ALL SELECT segment, 'dataset', upper(layer), '{"ownership":' || owners || '}' FROM segments
  UNION ALL SELECT '["ns","column","balance",' || target || ']', 'column', 'balance', '{"data_type":"decimal"}' FROM runs
  UNION ALL SELECT '["ns","column","cents",["ns","column","balance",' || target || ']]', 'column', 'cents', '{}' FROM runs)"""

_SNAP = r"""c AS (SELECT c_custkey AS k, c_nationkey AS n, c_name AS name, c_custkey // 100 AS part, '"n/' || c_nationkey || '~"' AS sch FROM customer WHERE c_nationkey <> 5 AND c_custkey IN (SELECT o_custkey FROM orders)),
docs AS (SELECT DISTINCT n, part, sch FROM c),
tabs AS (SELECT *, '{"kind":"table","path":[' || sch || ',"' || name || '"]}' AS key, '[' || sch || ',"' || name || '"' AS up FROM c),
cols AS (SELECT o_orderkey AS o, t.k, '{"kind":"column","path":' || up || ',"o/' || o_orderkey || '"]}' AS key, t.key AS parent, o_orderpriority AS p, o_orderstatus AS s FROM orders JOIN tabs t ON o_custkey = t.k),
pks AS (SELECT k, string_agg(key, ',' ORDER BY o) AS refs FROM cols WHERE o % 4 = 0 GROUP BY k),
ends AS (SELECT k, arg_min(key, o) AS a, arg_max(key, o) AS b FROM cols GROUP BY k),
objects AS (
  SELECT 'data_source' AS kind, 'ds' AS raw_id, '{"kind":"data_source","path":[]}' AS object_key, CAST(NULL AS VARCHAR) AS parent_key, 'src' AS name FROM docs
  UNION ALL SELECT 'database', 'db', '{"kind":"database","path":[]}', '{"kind":"data_source","path":[]}', 'shop' FROM docs
  UNION ALL SELECT 'schema', 's' || n, '{"kind":"schema","path":[' || sch || ']}', '{"kind":"database","path":[]}', 'n/' || n || '~' FROM docs
  UNION ALL SELECT 'table', 't' || k, key, '{"kind":"schema","path":[' || sch || ']}', name FROM tabs
  UNION ALL SELECT 'column', 'k' || o, key, parent, 'o/' || o FROM cols
  UNION ALL SELECT 'primary_key', CASE WHEN k % 8 = 0 THEN 't' ELSE 'p' END || k, '{"kind":"primary_key","path":' || up || ',"pk"]}', key, 'pk' FROM tabs JOIN pks USING (k)
  UNION ALL SELECT 'foreign_key', 'f' || k, '{"kind":"foreign_key","path":' || up || ',"fk"]}', key, 'fk' FROM tabs WHERE k % 3 = 0
  UNION ALL SELECT 'relationship', 'r' || k, '{"kind":"relationship","path":' || up || ',"to/self"]}', key, 'to/self' FROM tabs WHERE k % 3 = 0)"""

SQL = {
    "snapshot_objects": f"WITH {_SNAP} SELECT kind, raw_id, object_key, parent_key FROM objects",
    "snapshot_properties": f"""WITH {_SNAP} SELECT object_key, '/name' AS pointer, '"' || name || '"' AS value_json FROM objects
        UNION ALL SELECT object_key, '/description', 'null' FROM objects WHERE kind NOT LIKE '%key' UNION ALL SELECT object_key, '/ownership', 'null' FROM objects WHERE kind IN ('data_source', 'database', 'schema', 'table')
        UNION ALL SELECT object_key, '/system_type', '"postgresql"' FROM objects WHERE kind = 'data_source'
        UNION ALL SELECT key, '/data_type', '"' || p || '"' FROM cols UNION ALL SELECT key, '/ordinal_position', CAST(o AS VARCHAR) FROM cols UNION ALL SELECT key, '/nullable', CASE WHEN o % 50 = 0 THEN 'null' ELSE CAST(s <> 'F' AS VARCHAR) END FROM cols
        UNION ALL SELECT key, '/technical_attributes/a~1b', '"' || p || '"' FROM cols WHERE s = 'P'
        UNION ALL SELECT '{{"kind":"primary_key","path":' || up || ',"pk"]}}', '/column_ids', '[' || refs || ']' FROM tabs JOIN pks USING (k)
        UNION ALL SELECT '{{"kind":"foreign_key","path":' || up || ',"fk"]}}', unnest(['/column_ids', '/referenced_table_id', '/referenced_column_ids']), unnest(['[' || a || ']', key, '[' || CASE WHEN k % 6 = 0 THEN 'null' ELSE b END || ']']) FROM tabs JOIN ends USING (k) WHERE k % 3 = 0
        UNION ALL SELECT '{{"kind":"relationship","path":' || up || ',"to/self"]}}', unnest(['/to_table_id', '/foreign_key_id']), unnest([key, CASE WHEN k % 6 = 3 THEN 'null' ELSE '{{"kind":"foreign_key","path":' || up || ',"fk"]}}' END]) FROM tabs WHERE k % 3 = 0""",
    "snapshot_problems": rf"""WITH {_SNAP}, found AS (
        SELECT '' AS place, 'a JSON object repeats a key' AS problem FROM (SELECT DISTINCT c_custkey // 100 FROM customer WHERE c_nationkey = 5 AND c_custkey IN (SELECT o_custkey FROM orders))
        UNION ALL SELECT '/scan/scanner_contract_version', 'unsupported contract version' FROM docs WHERE n = 3 UNION ALL SELECT '/source/database', 'envelope and model differ' FROM docs WHERE n = 4
        UNION ALL SELECT '/governance/data_sources/*/databases/*/schemas/*/tables/*/columns/*/nullable', 'value of another type' FROM cols WHERE o % 50 = 0
        UNION ALL SELECT '/governance/data_sources/*/databases/*/schemas/*/tables/*/columns/*/ordinal_position', 'value of another type' FROM cols WHERE o < 1
        UNION ALL SELECT '/governance/data_sources/*/databases/*/schemas/*/tables/*/schema_id', 'does not name the object around it' FROM tabs WHERE k % 10 = 9
        UNION ALL SELECT 't' || k, 'repeated id' FROM pks WHERE k % 8 = 0
        UNION ALL SELECT '/governance/data_sources/*/databases/*/schemas/*/tables/*/foreign_keys/*/referenced_column_ids/*', 'reference does not resolve' FROM tabs WHERE k % 6 = 0
        UNION ALL SELECT '/governance/relationships/*/foreign_key_id', 'reference does not resolve' FROM tabs WHERE k % 6 = 3)
        SELECT place, problem, count(*) AS n_problems FROM found GROUP BY place, problem""",
    "inventory_tables": f"""WITH {_CATALOG}, c AS (SELECT up, string_agg('{{"data_type":"' || kind || '","description":' || coalesce('"' || said || '"', 'null') || ',"id":"col:' || path || '","name":"' || name || '","nullable":' || CAST(nullable AS VARCHAR) || ',"ordinal_position":' || (o + 1) || '}}', ',' ORDER BY o) AS all_columns FROM cols GROUP BY up)
        SELECT 'tbl:' || path AS local_id, '{{"columns":[' || coalesce(all_columns, '') || '],"description":' || coalesce('"' || said || '"', 'null') || ',"foreign_keys":[' || coalesce('{{"column_ids":["' || f.columns || '"],"id":"fk:' || path || '/fk","name":"fk","referenced_column_ids":["' || to_columns || '"],"referenced_table_id":"tbl:' || target || '"}}', '')
          || '],"id":"tbl:' || path || '","name":"' || name || '","owner":"' || owner || '","primary_key":' || coalesce('{{"column_ids":["' || replace(p.columns, ',', '","') || '"],"id":"pk:' || path || '/pk","name":"pk"}}', 'null') || ',"schema_id":"sch:src/shop/' || sch || '"}}' AS json
        FROM tabs t LEFT JOIN c ON c.up = t.path LEFT JOIN fks f ON f.up = t.path LEFT JOIN pks p ON p.up = t.path""",
    "catalog_objects": f"WITH {_CATALOG} SELECT * FROM objects",
    "catalog_kinds": f"WITH {_CATALOG} SELECT kind, count(*) AS n_objects FROM objects GROUP BY kind",
    "catalog_keys": f"WITH {_CATALOG} SELECT 'pk:' || up || '/pk' AS local_id, columns, '' AS to_columns FROM pks UNION ALL SELECT 'fk:' || up || '/fk', columns, to_columns FROM fks",
    "catalog_properties": f"""WITH {_CATALOG} SELECT local_id AS object_key, '/description' AS pointer, coalesce('"' || description || '"', 'null') AS value_json FROM objects WHERE kind NOT LIKE '%key'
        UNION ALL SELECT local_id, '/ownership', coalesce('"' || owner || '"', 'null') FROM objects WHERE kind IN ('database', 'schema', 'table')
        UNION ALL SELECT 'col:' || path, '/data_type', '"' || kind || '"' FROM cols UNION ALL SELECT 'col:' || path, '/nullable', CAST(nullable AS VARCHAR) FROM cols UNION ALL SELECT 'col:' || path, '/ordinal_position', CAST(o + 1 AS VARCHAR) FROM cols
        UNION ALL SELECT 'pk:' || up || '/pk', '/columns', '["' || replace(columns, ',', '","') || '"]' FROM pks UNION ALL SELECT 'fk:' || up || '/fk', '/columns', '["' || columns || '"]' FROM fks UNION ALL SELECT 'fk:' || up || '/fk', '/to_columns', '["' || to_columns || '"]' FROM fks""",
    "catalog_unfit_properties": """WITH o AS (SELECT 'col:' || o_orderkey AS object_key, o_orderstatus AS s, o_orderpriority AS p FROM orders),
        lost AS (SELECT object_key, unnest([CASE WHEN s = 'P' THEN '/ownership' ELSE '/description' END, '/data_type', '/nullable']) AS pointer, 'unknown_object' AS problem FROM o WHERE p = '1-URGENT')
        SELECT * FROM lost UNION ALL SELECT object_key, '/ownership', 'property_of_another_kind' FROM o WHERE s = 'P' AND p <> '1-URGENT'
        UNION ALL SELECT object_key, '/data_type', 'value_of_another_type' FROM o WHERE p = '5-LOW' UNION ALL SELECT object_key, '/nullable', 'value_of_another_type' FROM o WHERE s = 'F' AND p <> '1-URGENT'""",
    "catalog_assets": f"""WITH {_CATALOG} SELECT b.local_id, replace(split_part(b.local_id, ':', 2), '/', '.') AS name, b.name AS display_name, b.description AS described, b.owner AS owned, c.kind AS typed
        FROM objects b LEFT JOIN cols c ON b.local_id = 'col:' || c.path WHERE b.kind IN ('database', 'schema', 'table', 'column')""",
    "catalog_relations": f"""WITH {_CATALOG} SELECT parent_id AS source_id, local_id AS target_id, 'contains' AS type_ref FROM objects WHERE kind IN ('schema', 'table', 'column') UNION ALL SELECT 'tbl:' || up, 'tbl:' || target, 'references' FROM fks""",
    "catalog_index": f"WITH {_INDEX} SELECT * FROM idx",
    "catalog_index_conflicts": f"WITH {_INDEX} SELECT local_id, node_key AS indexed FROM idx WHERE local_id LIKE '%/NATION_1/%' OR local_id LIKE '%/NATION_1'",
    "dbt_nodes": f"""WITH {_DBT} SELECT node_key, CASE WHEN eph THEN 'transformation' ELSE 'table' END AS kind, name, description, attributes AS attributes_json, 1 AS n_sources FROM kept
        UNION ALL SELECT node_key, 'table', name, NULL, attributes, 1 FROM sources UNION ALL SELECT node_key, 'column', 'id', NULL, '{{"data_type":"int","tags":["a","b"]}}', 1 FROM ids
        UNION ALL SELECT '["ns","dataset","' || name || '",' || k || ']', 'dataset', name, NULL, '{{}}', 0 FROM places CROSS JOIN db UNION ALL SELECT k, 'data_source', 'db', NULL, '{{}}', 0 FROM db""",
    "dbt_edges": f"""WITH {_DBT} SELECT k AS src_key, 'contains' AS kind, '["ns","dataset","' || name || '",' || k || ']' AS dst_key, 0 AS n_sources FROM places CROSS JOIN db
        UNION ALL SELECT '["ns","dataset","' || seg || '",' || k || ']', 'contains', node_key, 0 FROM kept CROSS JOIN db WHERE NOT eph UNION ALL SELECT '["ns","dataset","raw",' || k || ']', 'contains', node_key, 0 FROM sources CROSS JOIN db
        UNION ALL SELECT up, 'contains', node_key, 0 FROM ids UNION ALL SELECT m.node_key, 'depends_on', s.node_key, 1 FROM kept m JOIN sources s USING (c_nationkey)""",
    "dbt_problems": f"""WITH {_DBT} SELECT '/model.p.' || name || '/database' AS path, 'database is required where there is no default' AS message FROM models WHERE NOT fit
        UNION ALL SELECT '/parent_map/model.p.' || name, 'unknown parent model.p.gone' FROM kept WHERE seg = 'MACHINERY'""",
    "dbt_observations": f"""WITH {_DBT}, stated AS (SELECT node_key, name, description, attributes FROM kept UNION ALL SELECT node_key, name, NULL, attributes FROM sources)
        SELECT node_key AS object_key, '/name' AS pointer, '"' || name || '"' AS value_json FROM stated UNION ALL SELECT node_key, '/description', '"' || description || '"' FROM stated WHERE description IS NOT NULL
        UNION ALL SELECT node_key, '/attributes/' || unnest(json_keys(attributes)), CAST(unnest(list_transform(json_keys(attributes), lambda x: json_extract(attributes, '$.' || x))) AS VARCHAR) FROM stated
        UNION ALL SELECT node_key, unnest(['/name', '/attributes/data_type', '/attributes/tags']), unnest(['"id"', '"int"', '["a","b"]']) FROM ids""",
    "odcs_nodes": f"WITH {_ODCS} SELECT * FROM nodes",
    "odcs_edges": f"WITH {_ODCS} SELECT contract AS src_key, 'governs' AS kind, dataset AS dst_key FROM parts UNION ALL SELECT up, 'contains', node_key FROM cols",
    "odcs_problems": "SELECT '/version' AS path, 'contract version is required' AS message, count(*) AS n_problems FROM part WHERE p_type = 'ECONOMY' HAVING count(*) > 0",
    "odcs_observations": f"""WITH {_ODCS} SELECT node_key AS object_key, '/name' AS pointer, '"' || name || '"' AS value_json FROM nodes
        UNION ALL SELECT node_key, '/attributes/' || unnest(json_keys(attributes_json)), CAST(unnest(list_transform(json_keys(attributes_json), lambda x: json_extract(attributes_json, '$.' || x))) AS VARCHAR) FROM nodes""",
    "lineage_nodes": f"WITH {_RUNS} SELECT * FROM nodes",
    "lineage_edges": f"""WITH {_RUNS} SELECT '["ns","data_source","db",null]' AS src_key, 'contains' AS kind, '["ns","dataset","s",["ns","data_source","db",null]]' AS dst_key, 0 AS n_sources
        UNION ALL SELECT '["ns","dataset","s",["ns","data_source","db",null]]', 'contains', source, 0 FROM froms UNION ALL SELECT source, 'contains', '["ns","column","total",' || source || ']', 0 FROM froms
        UNION ALL SELECT target, 'contains', '["ns","column","balance",' || target || ']', 0 FROM runs UNION ALL SELECT '["ns","column","balance",' || target || ']', 'contains', '["ns","column","cents",["ns","column","balance",' || target || ']]', 0 FROM runs
        UNION ALL SELECT target, 'depends_on', source, 1 FROM runs UNION ALL SELECT target, 'depends_on', segment, 1 FROM runs JOIN segments USING (layer) UNION ALL SELECT '["ns","column","balance",' || target || ']', 'depends_on', '["ns","column","total",' || source || ']', 1 FROM runs""",
    "lineage_problems": """SELECT '00000000-0000-0000-0000-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS path, 'eventTime must be a time with a zone' AS message FROM customer WHERE c_mktsegment = 'FURNITURE'
        UNION ALL SELECT '00000000-0000-0000-0000-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') || '/outputs/0/facets/datasetType', 'deletions are not supported' FROM customer WHERE c_mktsegment = 'HOUSEHOLD'
        UNION ALL SELECT '/w/c' || c_custkey || '/datasetType', 'events disagree on a facet' FROM customer WHERE c_mktsegment = 'MACHINERY'""",
    "lineage_observations": f"""WITH {_RUNS} SELECT node_key AS object_key, '/name' AS pointer, '"' || name || '"' AS value_json FROM nodes WHERE kind NOT IN ('data_source') AND node_key NOT LIKE '["ns","dataset","s",%'
        UNION ALL SELECT node_key, '/attributes/' || unnest(json_keys(attributes_json)), CAST(unnest(list_transform(json_keys(attributes_json), lambda x: json_extract(attributes_json, '$.' || x))) AS VARCHAR) FROM nodes""",
    "compare_orphans": """WITH c AS (SELECT o_orderkey, o_custkey, CASE o_orderpriority WHEN '5-LOW' THEN 'added' WHEN '4-NOT SPECIFIED' THEN 'removed' ELSE 'kept' END AS change FROM orders)
        SELECT 'o:' || a.o_orderkey AS object_key, 'o:' || a.o_custkey AS ancestor_key FROM c a JOIN c b ON b.o_orderkey = a.o_custkey WHERE b.change <> 'kept' AND a.change <> b.change""",
    "compare_out_of_order": """WITH o AS (SELECT o_orderkey AS at, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS r, 'o:' || o_orderkey AS k FROM orders)
        SELECT a.at FROM o a JOIN o b ON b.at = a.at - 1 WHERE (a.r, a.k) < (b.r, b.k)""",
}
