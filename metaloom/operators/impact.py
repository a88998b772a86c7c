"""Downstream impact of changed nodes.

Change runs along contains and governs, and against depends_on. reach() is a layered search for the least distance of
every node and carries keys alone; downstream() also finds one canonical path to each: of all shortest paths the one
that comes first by its root, then by its steps from the root on. Roots are never targets.

A target keeps its parent on that path, the step from there, and its rank among the targets of its layer; ranks order
paths as their texts do, so no layer carries paths. paths() writes them out, by doubling, when they are asked for. Each
layer is written to the shared folder. The hops stay partitioned by their source; those of a source with very many are
dealt to several partitions, to each of which the source is sent.
"""

from __future__ import annotations

from functools import reduce
from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import small, stored
from .batching import running_sums

#: Kinds that a catalog policy can apply to.
POLICY_KINDS = ("data_source", "dataset", "table", "column")


def hops(edges: DataFrame) -> DataFrame:
    """The steps that a change can take: from_key, to_key, kind."""
    on = edges.filter(F.col("kind").isin("depends_on", "contains", "governs"))
    back = F.col("kind") == "depends_on"
    return on.select(F.when(back, F.col("dst_key")).otherwise(F.col("src_key")).alias("from_key"), F.when(back, F.col("src_key")).otherwise(F.col("dst_key")).alias("to_key"), "kind")


def step_key(step: Column) -> Column:
    """A hop as text for ordering paths; every text of one layer has as many hops."""
    return F.concat(F.lit("["), F.concat_ws(",", step["kind"], step["src_key"], step["dst_key"]), F.lit("]"))


#: Hops of a source from which on they are dealt to several partitions, about so many to each.
HUB = 50_000
#: Layers after which the nodes that were seen are written as one table again.
LAYERS = 8


class Moves(NamedTuple):
    """Hops in memory, by their source and a part of it; hubs: the parts of sources that have several."""

    rows: DataFrame
    hubs: DataFrame

    def after(self, front: DataFrame, node: str) -> DataFrame:
        """The rows of a layer (whose nodes are in that column) with each hop from there."""
        parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        sent = front.join(F.broadcast(self.hubs), front[node] == self.hubs["hub"], "left").withColumn("sent", parts).drop("hub", "parts")
        return sent.join(self.rows, (sent[node] == self.rows["from_key"]) & (sent["sent"] == self.rows["part"])).drop("sent", "part", "from_key")


def moves_of(rows: DataFrame, hub: int = HUB) -> Moves:
    """rows: from_key, to_key and more. There is one hub for each so many hops at most, so hubs are few."""
    many = stored(rows.groupBy("from_key").count().filter(F.col("count") > hub).select(F.col("from_key").alias("hub"), F.ceil(F.col("count") / hub).cast("int").alias("parts")), "hubs")
    part = F.coalesce(F.pmod(F.xxhash64("to_key"), F.col("parts")).cast("int"), F.lit(0)).alias("part")
    dealt = rows.join(F.broadcast(many), F.col("from_key") == F.col("hub"), "left").select(*rows.columns, part)
    return Moves(dealt.repartition("from_key", "part").persist(), many)


class Seen:
    """The nodes of all layers so far, as few tables as there are layers between two rewritings."""

    def __init__(self, first: DataFrame):
        self.tables = [first]

    def add(self, layer: DataFrame) -> None:
        self.tables.append(layer)
        if len(self.tables) > LAYERS:
            self.tables = [stored(self.all(), "seen")]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tables)


class Impact(NamedTuple):
    """targets: target, distance, root, parent, step, rank. roots: root. closure: node_key."""

    targets: DataFrame
    roots: DataFrame
    closure: DataFrame


def downstream(edges: DataFrame, roots: DataFrame, most_layers: int | None = None, hub: int = HUB) -> Impact:
    """All nodes that changes of the roots (a column root) reach, and from where. The search goes on until a layer is
    empty; if there are more than most_layers, that is an error."""
    roots = stored(roots.select("root").distinct(), "roots")
    moves = moves_of(hops(edges), hub)  # repeated ones do no harm: the best hop to a node is taken
    back = F.col("kind") == "depends_on"
    step = F.struct("kind", F.when(back, F.col("to_key")).otherwise(F.col("target")).alias("src_key"), F.when(back, F.col("target")).otherwise(F.col("to_key")).alias("dst_key"))
    # Keys are compared as they stand in the text of a path, with the mark that follows them there.
    first = running_sums(roots.withColumn("order", F.concat("root", F.lit(">"))), ["order"], [])
    front = first.select(F.col("root").alias("target"), "root", F.col("position").alias("rank"))
    none = front.limit(0).select("target", F.lit(0).alias("distance"), "root", F.col("root").alias("parent"), F.lit(None).cast("struct<kind:string,src_key:string,dst_key:string>").alias("step"), "rank")
    layers: list[DataFrame] = []
    seen = Seen(roots.select(F.col("root").alias("seen")))
    for distance in count(1):
        reached = moves.after(front.select("target", "root", "rank"), "target").join(seen.all(), F.col("to_key") == F.col("seen"), "left_anti")
        best = F.min_by(F.struct(F.col("target").alias("parent"), "root", step.alias("step"), F.col("rank").alias("above")), F.struct("rank", step_key(step).alias("key")))
        found = reached.groupBy(F.col("to_key").alias("own")).agg(best.alias("b")).select(F.col("own").alias("target"), "b.*")
        ranked = running_sums(found.withColumn("order", F.concat(step_key(F.col("step")), F.lit(">"))), ["above", "order"], [])
        layer = stored(ranked.select("target", F.lit(distance).alias("distance"), "root", "parent", "step", F.col("position").alias("rank")), "layer")
        if layer.isEmpty():
            break
        if most_layers is not None and distance > most_layers:
            raise RuntimeError(f"there are targets beyond {most_layers} layers")
        layers.append(layer)
        front = layer
        seen.add(layer.select(F.col("target").alias("seen")))
    moves.rows.unpersist()
    targets = reduce(DataFrame.unionByName, layers) if layers else none
    closure = roots.select(F.col("root").alias("node_key")).unionByName(targets.select(F.col("target").alias("node_key")))
    return Impact(targets, roots, closure)


def paths(impact: Impact) -> DataFrame:
    """Targets with their whole paths: target, distance, root, path_key, steps. Each round joins every piece of a path to
    the piece before it, so a path of n steps takes log n rounds."""
    pieces = impact.targets.select("target", "distance", "root", F.col("parent").alias("from"), F.array("step").alias("steps"))
    while pieces.filter("size(steps) < distance").take(1):
        before = pieces.select(F.col("target").alias("from"), F.col("from").alias("further"), F.col("steps").alias("first"))
        joined = pieces.join(before, "from", "left")
        pieces = stored(joined.select("target", "distance", "root", F.coalesce("further", "from").alias("from"), F.when(F.col("first").isNull(), F.col("steps")).otherwise(F.concat("first", "steps")).alias("steps")), "paths")
    key = F.concat_ws(">", F.array("root"), F.transform("steps", step_key))
    return pieces.select("target", "distance", "root", key.alias("path_key"), "steps")


def reach(edges: DataFrame, roots: DataFrame, most_layers: int | None = None, hub: int = HUB) -> DataFrame:
    """node_key and distance of every node that changes of the roots reach; the roots have 0. As downstream(), without
    parents, so that no layer carries more than its keys."""
    front = stored(roots.select(F.col("root").alias("node_key"), F.lit(0).alias("distance")).distinct(), "reached")
    moves = moves_of(hops(edges).select("from_key", "to_key"), hub)
    layers, seen = [front], Seen(front.select(F.col("node_key").alias("seen")))
    for distance in count(1):
        next_ = moves.after(front.select("node_key"), "node_key").select(F.col("to_key").alias("own")).distinct()
        layer = stored(next_.join(seen.all(), F.col("own") == F.col("seen"), "left_anti").select(F.col("own").alias("node_key"), F.lit(distance).alias("distance")), "reached")
        if layer.isEmpty():
            break
        if most_layers is not None and distance > most_layers:
            raise RuntimeError(f"there are targets beyond {most_layers} layers")
        layers.append(layer)
        front = layer
        seen.add(layer.select(F.col("node_key").alias("seen")))
    moves.rows.unpersist()
    return reduce(DataFrame.unionByName, layers)


def unknown_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots that are no nodes; there must be none."""
    return roots.join(nodes.select(F.col("node_key").alias("root")), "root", "left_anti")


def affected_edges(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """The effective edges with both ends in the closure (roots too), canonical path or not."""
    on = edges.filter(F.col("kind").isin("depends_on", "contains", "governs")).select("src_key", "kind", "dst_key")
    inside = closure.select("node_key")
    return on.join(inside.withColumnRenamed("node_key", "src_key"), "src_key", "left_semi").join(inside.withColumnRenamed("node_key", "dst_key"), "dst_key", "left_semi").select("src_key", "kind", "dst_key").distinct()


def governance_assets(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Nodes of the closure and their ancestors in the graph, but contracts."""
    core = nodes.join(closure.select("node_key"), "node_key", "left_semi")
    up = core.select(F.explode(F.concat(F.array("node_key"), "ancestor_keys")).alias("node_key")).distinct()
    return nodes.filter("kind != 'contract'").join(up, "node_key", "left_semi")


def associated_contracts(nodes: DataFrame, edges: DataFrame, closure: DataFrame) -> DataFrame:
    """Contracts of the closure, and those that govern a node of it or any of its ancestors: node_key."""
    core = nodes.join(closure.select("node_key"), "node_key", "left_semi")
    up = core.select(F.explode(F.concat(F.array("node_key"), "ancestor_keys")).alias("dst_key")).distinct()
    governing = edges.filter("kind = 'governs'").join(up, "dst_key", "left_semi").select(F.col("src_key").alias("node_key"))
    return core.filter("kind = 'contract'").select("node_key").unionByName(governing).distinct()


def affected_policies(local: DataFrame, policies: DataFrame) -> DataFrame:
    """Policies whose selector matches a catalog object (kind, local_id) of the impact: policy_id, local_id."""
    policies = small(policies)
    match = (local["kind"] == policies["kind"]) & (policies["object_id"].isNull() | (policies["object_id"] == local["local_id"])) & (policies["id_prefix"].isNull() | F.col("local_id").startswith(policies["id_prefix"]))
    return local.join(policies, match).select("policy_id", "local_id").distinct()


def broken_paths(targets: DataFrame) -> DataFrame:
    """Rows of paths() that do not run from root to target without a gap; there must be none."""
    begin = lambda s: F.when(s["kind"] == "depends_on", s["dst_key"]).otherwise(s["src_key"])
    end = lambda s: F.when(s["kind"] == "depends_on", s["src_key"]).otherwise(s["dst_key"])
    begins, ends = F.transform("steps", begin), F.transform("steps", end)
    return targets.filter(~((F.size("steps") == F.col("distance")) & (begins == F.concat(F.array("root"), F.slice(ends, 1, F.size("steps") - 1))) & (F.element_at(ends, -1) == F.col("target"))))


def workspace(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Every node with its class of impact (root, direct, transitive, none) and its distance, from reach()."""
    d = reached.select("node_key", F.col("distance").alias("d"))
    kind = F.when(F.col("d").isNull(), "none").when(F.col("d") == 0, "root").when(F.col("d") == 1, "direct").otherwise("transitive")
    return nodes.join(d, "node_key", "left").select("node_key", kind.alias("impact"), F.col("d").alias("distance"))


def policy_nodes(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Nodes of the closure of kinds that a catalog policy can apply to."""
    return nodes.filter(F.col("kind").isin(*POLICY_KINDS)).join(closure.select("node_key"), "node_key", "left_semi")


def evidence(impact: Impact) -> tuple[DataFrame, DataFrame]:
    """The graph that a result of downstream() shows by itself: nodes (node_key) and edges (src_key, kind, dst_key) of
    its roots and paths, without the graph that was searched. A path is its parent's and one step, so the targets' own
    steps are all of them."""
    steps = impact.targets.select("step.src_key", "step.kind", "step.dst_key").distinct()
    nodes = impact.closure.unionByName(steps.select(F.explode(F.array("src_key", "dst_key")).alias("node_key"))).distinct()
    return nodes, steps
