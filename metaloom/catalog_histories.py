"""Registered queries over stored histories and identities that follow changes, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import projections as P
from .catalog import Query
from .operators import history
from .oracle import _OBS, _RULES, _TIMELINE, _decided
from .shared import shared_dir, stored
from .sinks import artifacts, histories


def _stored(spark, d) -> str:
    """Days of events as a stored history: three of five days have full context, one has observations alone, one none.
    The rule for scrolling is no longer there on odd days."""
    folder = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    i = F.col("entry_index")
    properties = stored(P.timeline(spark, d)[1], "timeline")  # read for the days, the check of entries and the rows
    entries = stored(properties.select("entry_index").distinct().select("entry_index", F.when(i % 5 == 4, "none").when(i % 5 == 3, "provenance").otherwise("full").alias("context")), "entries")
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    within = lambda df, *contexts: df.join(F.broadcast(entries.filter(F.col("context").isin(*contexts)).select("entry_index")), "entry_index", "left_semi")
    observations = within(P.observations(spark, d).withColumn("entry_index", day), "full", "provenance")
    full = entries.filter("context = 'full'").select("entry_index")
    rules = full.crossJoin(F.broadcast(P.authority(spark))).filter((i % 2 == 0) | (F.col("pointer") != "/attributes/scroll"))
    histories.append(folder, entries, {"snapshot": properties, "observations": observations, "rules": rules})
    return folder


def history_stored_dimensions(spark, d):
    """What changed of each property between each day and the next, read from the stored history."""
    h = histories.read(spark, _stored(spark, d))
    facts = history.dimension_facts(h.observations, history.decisions(h.observations, h.rules))
    pairs = history.dimension_pairs(h.entries, facts, ("object_key", "pointer"))
    return history.dimension_changes(pairs).filter("changed").select("from_index", "to_index", "object_key", "pointer", "dimension", "base_json", "cand_json")


def history_stored_problems(spark, d):
    """A history of which every seventh day's snapshot has a value too many: what is stored is not what the index says."""
    folder = _stored(spark, d)
    rows = stored(spark.read.schema(histories.SCHEMAS["snapshot"]).parquet(f"{folder}/snapshot").filter("entry_index % 7 = 0"), "damaged")
    one = rows.groupBy("entry_index").agg(F.min("object_key").alias("object_key")).select("object_key", F.lit("/planted").alias("pointer"), F.lit("1").alias("value_json"), "entry_index")
    one.withColumn("entry", F.col("entry_index")).write.mode("append").partitionBy("entry").parquet(f"{folder}/snapshot")
    return histories.problems(spark, folder)


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Customers by nation before and after a change: those that seven divides have another balance, those that eleven
    divides are gone."""
    k = F.col("c_custkey")
    before = P.table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name", F.floor("c_acctbal").cast("bigint").alias("balance"))
    after = before.filter(k % 11 != 0).withColumn("balance", F.when(k % 7 == 0, F.col("balance") + 1).otherwise(F.col("balance")))
    return before, after


def identity_update(spark, d):
    """The identity of each nation's customers after a change, from the one before and the rows that came and went."""
    before, after = _sides(spark, d)
    k = F.col("c_custkey")
    sums = lambda df: artifacts.row_sums(df, "snapshot", "c_nationkey")
    moved = artifacts.changed_sums(sums(before), sums(after.filter(k % 7 == 0)), sums(before.filter((k % 7 == 0) | (k % 11 == 0))), "c_nationkey")
    return moved.select("c_nationkey", "n_rows", artifacts.sums_digest("snapshot", ["c_custkey", "c_name", "balance"]).alias("digest"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (history_stored_dimensions, history_stored_problems, identity_update)}

_ENTRY = """eobs AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS i, * FROM (WITH {obs} SELECT * FROM obs)),
obs AS (SELECT i || '|' || object_key AS object_key, ns, i || '|' || pointer AS pointer, v, provider, ref FROM eobs WHERE i % 5 <> 4)""".replace("{obs}", _OBS)
_ENTRY_RULES = f"""plain_rules AS (WITH {_RULES} SELECT * FROM rules), rules AS (SELECT i || '|' || pointer AS pointer, ns, provider, ref FROM plain_rules CROSS JOIN (SELECT DISTINCT i FROM eobs WHERE i % 5 < 3) WHERE i % 2 = 0 OR pointer <> '/attributes/scroll')"""

SQL = {
    "history_stored_dimensions": f"""WITH {_decided(_ENTRY, _ENTRY_RULES)}, days AS (SELECT DISTINCT i FROM eobs), nxt AS (SELECT i, lead(i) OVER (ORDER BY i) AS j FROM days),
        d AS (SELECT CAST(split_part(object_key, '|', 1) AS BIGINT) AS i, split_part(object_key, '|', 2) AS o, split_part(pointer, '|', 2) AS p, * FROM decided),
        said AS (SELECT i, o, p, v, string_agg('{{"observation_mode":"observed","provider_type":"' || provider || '","source_ref":"' || ref || '","source_version":null}}', ',' ORDER BY provider, ref) AS s
          FROM (SELECT DISTINCT i, object_key AS o, pointer AS p, v, provider, ref FROM eobs WHERE i % 5 <> 4) GROUP BY ALL),
        facts4 AS (
          SELECT i, o, p, 'provenance' AS dimension, '{{"value_groups":[' || string_agg('{{"provenance":[' || s || '],"value":' || v || '}}', ',' ORDER BY '{{"provenance":[' || s || '],"value":' || v || '}}') || ']}}' AS j FROM said GROUP BY i, o, p
          UNION ALL SELECT i, o, p, 'conflict', '{{"has_result":true,"reason":"' || reason || '","state":"' || state || '"}}' FROM d
          UNION ALL SELECT i, o, p, 'authority', CASE WHEN reason IN ('SINGLE_OBSERVATION', 'AGREEMENT') THEN '{{"authority_applicable":false,"has_result":true}}' ELSE '{{"authority_applicable":true,"has_result":true,"outcome":"' || reason || '","winning_rule":' || CASE WHEN n_rules = 1 THEN '{{"provider_type":"' || authority || '","source_ref":' || coalesce('"' || authority_ref || '"', 'null') || '}}' ELSE 'null' END || '}}' END FROM d
          UNION ALL SELECT i, o, p, 'effective_value', CASE WHEN n_values = 1 OR reason = 'RESOLVED_BY_AUTHORITY' THEN '{{"has_effective_value":true,"has_result":true,"value":' || CASE WHEN n_values = 1 THEN (SELECT min(f.v) FROM facts f WHERE f.object_key = d.object_key AND f.pointer = d.pointer) ELSE allowed_v END || '}}' ELSE '{{"has_effective_value":false,"has_result":true}}' END FROM d),
        kept AS (SELECT * FROM facts4 WHERE i % 5 < 3 OR (i % 5 = 3 AND dimension = 'provenance'))
        SELECT nxt.i AS from_index, nxt.j AS to_index, a.o AS object_key, a.p AS pointer, a.dimension, a.j AS base_json, b.j AS cand_json FROM nxt JOIN kept a ON a.i = nxt.i JOIN kept b ON b.i = nxt.j AND a.o = b.o AND a.p = b.p AND a.dimension = b.dimension WHERE a.j <> b.j""".replace("b.provider AS authority,", "b.provider AS authority, b.ref AS authority_ref,"),
    "history_stored_problems": f"WITH {_TIMELINE} SELECT CAST(i AS BIGINT) AS entry_index, 'snapshot' AS \"table\", 'content differs from its identity' AS problem FROM days WHERE i % 7 = 0",
    "identity_update": r"""WITH t AS (SELECT c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END + CAST(floor(c_acctbal) AS BIGINT) AS balance, c_custkey, c_name FROM customer WHERE c_custkey % 11 <> 0),
        h AS (SELECT c_nationkey, sha256('gov-snapshot-v1' || chr(10) || '=' || balance || chr(31) || '=' || c_custkey || chr(31) || '=' || c_name) AS h FROM t),
        w AS (SELECT c_nationkey, count(*) AS n, """
    + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR) AS s{i}" for i in range(8))
    + r""" FROM h GROUP BY c_nationkey)
        SELECT c_nationkey, n AS n_rows, sha256('gov-snapshot-v1' || chr(10) || concat_ws('|', 'balance,c_custkey,c_name', n, s0, s1, s2, s3, s4, s5, s6, s7)) AS digest FROM w""",
}
