"""Governance graphs: merging, integrity and lineage.

nodes: node_key, namespace, kind, logical_id, parent_key, ancestor_keys, name, description, attributes_json, provenance
edges: src_key, kind, dst_key, attributes_json, provenance

provenance is an array of structs (provider_type, source_ref, source_version, observation_mode).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stored

EDGE = ["src_key", "kind", "dst_key"]


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def stated(rows: DataFrame, c: str = "provenance") -> DataFrame:
    """rows with one of their provenances each (column of that name), or none: what provenance_union() takes."""
    return rows.withColumn(c, F.explode_outer(c))


def provenance_union(c: str = "provenance") -> Column:
    """The sorted union of provenances, as an aggregate of rows that stated() has made."""
    return F.array_sort(F.collect_set(c)).alias(c)


#: Different provenances up to which their union is taken in the bits of a number.
BITS = 63


def few_told(rows: DataFrame, most: int = BITS, c: str = "provenance") -> DataFrame | None:
    """The different provenances of rows (one each, column of that name) in order, as one row (told), if they are few."""
    different = stored(rows.select(c).distinct(), "told")
    return different.agg(F.array_sort(F.collect_list(c)).alias("told")) if different.limit(most + 1).count() <= most else None


def bit_of(c: str = "provenance") -> Column:
    """The bit for a provenance among those told."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.array_position("told", F.col(c)) - 1).cast("int"))


def of_bits(c: str) -> Column:
    """The provenances among those told whose bits are set."""
    return F.filter("told", lambda _, i: F.col(c).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0)


def _merged(rows: DataFrame, key: list[str], payload: list[str], provenance: str | None) -> DataFrame:
    """A row for each key with its payload, if it has one alone, and the number of its payloads.

    First equal payloads are merged, so the second aggregation has few rows for each key.
    """
    rows = stated(rows, provenance) if provenance else rows
    same = rows.groupBy(*key, *payload).agg(*([provenance_union(provenance)] if provenance else [F.lit(1).alias("__one")]))
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(provenance)))).alias(provenance)] if provenance else []
    return same.groupBy(*key).agg(F.count(F.lit(1)).alias("n_payloads"), *(F.first(c).alias(c) for c in payload), *united)


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node_key with united provenance; n_payloads > 1 marks a conflict of payloads."""
    payload = [c for c in nodes.columns if c not in ("node_key", "provenance")]
    return _merged(nodes, ["node_key"], payload, "provenance" if "provenance" in nodes.columns else None)


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per (src_key, kind, dst_key) with united provenance; n_payloads > 1 marks a conflict."""
    payload = [c for c in edges.columns if c not in (*EDGE, "provenance")]
    return _merged(edges, EDGE, payload, "provenance" if "provenance" in edges.columns else None)


def dangling(graph: Graph) -> DataFrame:
    """Edges of which an end is no node: the edge and which end (src, dst)."""
    known = graph.nodes.select(F.col("node_key").alias("known")).distinct()
    at = lambda side: graph.edges.select(*EDGE).join(known, F.col(f"{side}_key") == F.col("known"), "left_anti").select(*EDGE, F.lit(side).alias("side"))
    return at("src").unionByName(at("dst"))


def missing_ancestors(nodes: DataFrame) -> DataFrame:
    """Ancestors of nodes that are no nodes: node_key, ancestor_key."""
    known = nodes.select(F.col("node_key").alias("known")).distinct()
    up = nodes.select("node_key", F.explode("ancestor_keys").alias("ancestor_key"))
    return up.join(known, F.col("ancestor_key") == F.col("known"), "left_anti")


def union(*graphs: Graph) -> Graph:
    """All nodes and edges of several graphs, merged."""
    nodes, edges = graphs[0]
    for g in graphs[1:]:
        nodes, edges = nodes.unionByName(g.nodes, allowMissingColumns=True), edges.unionByName(g.edges, allowMissingColumns=True)
    return Graph(merge_nodes(nodes), merge_edges(edges))


def problems(graph: Graph) -> DataFrame:
    """What makes a merged graph unfit: code and key of each fault. A graph is fit if there are none."""
    some = [
        graph.nodes.filter("n_payloads > 1").select(F.lit("conflicting_node").alias("code"), F.col("node_key").alias("key")),
        graph.edges.filter("n_payloads > 1").select(F.lit("conflicting_edge").alias("code"), F.concat_ws(" ", *EDGE).alias("key")),
        dangling(graph).select(F.lit("missing_end").alias("code"), F.concat_ws(" ", *EDGE).alias("key")),
    ]
    if "ancestor_keys" in graph.nodes.columns:
        some.append(missing_ancestors(graph.nodes).select(F.lit("missing_ancestor").alias("code"), F.col("node_key").alias("key")))
    if "kind" in graph.nodes.columns and "parent_key" in graph.nodes.columns:
        some.append(graph.nodes.filter("kind = 'column' AND parent_key IS NULL").select(F.lit("column_without_parent").alias("code"), F.col("node_key").alias("key")))
    out = some[0]
    for x in some[1:]:
        out = out.unionByName(x)
    return out


def lineage_edges(assertions: DataFrame) -> DataFrame:
    """Column lineage (output_key, input_key, provenance) as edges: the output depends on the input, once for each pair."""
    return stated(assertions).groupBy(F.col("output_key").alias("src_key"), F.col("input_key").alias("dst_key")).agg(provenance_union()).select("src_key", F.lit("depends_on").alias("kind"), "dst_key", "provenance")


def lineage_columns(assertions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of lineage that are no nodes yet: columns to add."""
    ends = assertions.select(F.explode(F.array("output_key", "input_key")).alias("node_key")).distinct()
    return ends.join(nodes.select("node_key"), "node_key", "left_anti")


def ancestors(nodes: DataFrame) -> DataFrame:
    """node_key, ancestor_key for all ancestors of all nodes."""
    return nodes.select("node_key", F.explode("ancestor_keys").alias("ancestor_key"))
