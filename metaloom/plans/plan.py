"""Plans to bring a remote catalog to the desired state, as tables that can be saved, checked and carried out.

actions: local_id, action, changed_fields. Commands carry creates and updates in an order in which every parent comes
before its children; a new relation travels with the end that comes later.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import batching, reconcile
from ..shared import stored
from ..sinks import artifacts

#: Digests by which a saved plan is stale, in the order in which they are told.
CATEGORIES = ("config", "snapshot", "policy", "mapping", "target_context", "planner_contract", "scanner_contract", "remote_state", "reconciliation")


class PlanError(ValueError):
    """A plan that must not be made or carried out."""


class Plan(NamedTuple):
    actions: DataFrame
    relations: DataFrame
    assumptions: DataFrame
    digests: DataFrame


def digests_of(spark: SparkSession, tables: dict[str, DataFrame], texts: dict[str, str] | None = None) -> DataFrame:
    """category, digest for tables (by content) and for short texts such as versions."""
    rows = [(k, canonical_text(v)) for k, v in (texts or {}).items()]
    rows += [(k, artifacts.identity(df, "remote_state").first()["digest"]) for k, df in tables.items()]
    if unknown := sorted({k for k, _ in rows} - set(CATEGORIES)):
        raise PlanError(f"unknown categories: {', '.join(unknown)}")
    return spark.createDataFrame(rows, "category string, digest string")


def canonical_text(text: str) -> str:
    import hashlib

    return hashlib.sha256((canonical.PREFIXES["config"] + text).encode()).hexdigest()


def build(desired: DataFrame, remote: DataFrame, desired_relations: DataFrame, remote_relations: DataFrame, digests: DataFrame, *, decisions: DataFrame | None = None, type_refs: dict[str, str] | None = None) -> Plan:
    """A plan; decisions (if any) are laid over the desired assets first, and unsafe ones on which it rests forbid it."""
    spark = desired.sparkSession
    if decisions is None:
        reconciled, resting = desired, spark.createDataFrame([], "local_id string, field string, mutation boolean, overlay boolean, digest string")
        actions = stored(reconcile.plan_assets(reconciled, remote), "actions")
    else:
        reconciled = stored(reconcile.overlay(desired, remote, decisions, type_refs or {}), "reconciled")
        actions = stored(reconcile.plan_assets(reconciled, remote), "actions")
        resting = stored(reconcile.assumptions(actions, desired, reconciled, remote, decisions, type_refs or {}), "assumptions")
        if bad := reconcile.blocking(resting).select("local_id", "field").take(5):
            raise PlanError("unsafe decisions: " + "; ".join(f"{r['local_id']} {r['field']}" for r in bad))
    if twice := reconcile.repeated_names(reconciled.join(actions.filter("action = 'create'"), "local_id", "left_semi").withColumn("domain_ref", F.lit("")) if "domain_ref" not in reconciled.columns else reconciled).take(1):
        raise PlanError(f"two objects would have the name {twice[0]['name']}")
    return Plan(actions, reconcile.plan_relationships(desired_relations, remote_relations), resting, digests)


def counts(plan: Plan) -> DataFrame:
    """object_kind, action, n_actions."""
    one = lambda df, kind: reconcile.counts(df).select(F.lit(kind).alias("object_kind"), "action", "n_actions")
    return one(plan.actions, "asset").unionByName(one(plan.relations, "relationship"))


def save(plan: Plan, folder: str) -> None:
    kept = [c for c in ("local_id", "field", "mutation", "overlay", "digest") if c in plan.assumptions.columns]
    artifacts.write(folder, "plan_v2", {"actions": plan.actions, "relations": plan.relations, "assumptions": plan.assumptions.select(*kept), "digests": plan.digests})


def load(spark: SparkSession, folder: str) -> Plan:
    t = artifacts.read(spark, folder, "plan_v2").tables
    return Plan(t["actions"], t["relations"], t["assumptions"], t["digests"])


def stale(plan: Plan, current: DataFrame, decisions: DataFrame | None = None) -> list[str]:
    """The categories by which a plan no longer holds; empty if it does."""
    found = {r["category"] for r in reconcile.stale_categories(plan.digests, current).collect()}
    if decisions is not None and not reconcile.stale_decisions(plan.assumptions, decisions).isEmpty():
        found.add("reconciliation")
    return [c for c in CATEGORIES if c in found]


# --- commands --------------------------------------------------------------------------------------------------


def ordered(actions: DataFrame) -> DataFrame:
    """Creates and updates with position (from 0): creates from the top level down, then updates."""
    ranked = reconcile.execution_order(actions).select("local_id", "action", "rank", F.lit(0).cast("bigint").alias("none"))
    return batching.running_sums(ranked, ["rank", "local_id"], ["none"]).select("local_id", "action", "rank", "position")


def commands(plan: Plan, assets: DataFrame) -> DataFrame:
    """One row for each command: local_id, operation, position, attributes, relations, n_resources, n_characteristics.

    assets: local_id and attributes of the reconciled state. An object that only carries a relation has a command too.
    """
    new = plan.relations.filter("action = 'create'").select("source_id", "target_id", "type_ref")
    at = stored(ordered(plan.actions), "order")
    hosted = reconcile.relation_hosts(new, at).groupBy(F.col("host").alias("local_id")).agg(F.array_sort(F.collect_list(F.struct("type_ref", "source_id", "target_id"))).alias("relations"))
    both = at.join(hosted, "local_id", "full").join(assets.select("local_id", "attributes"), "local_id", "left")
    none = F.array().cast("array<struct<type_ref:string,source_id:string,target_id:string>>")
    rows = both.withColumns({"operation": F.coalesce("action", F.lit("relate")), "relations": F.coalesce("relations", none), "attributes": F.when(F.col("action").isNotNull(), F.col("attributes"))})
    sizes = {"n_resources": F.lit(1).cast("bigint"), "n_characteristics": (F.coalesce(F.size("attributes"), F.lit(0)) + F.size("relations")).cast("bigint")}
    return rows.select("local_id", "operation", "rank", "position", "attributes", "relations").withColumns(sizes)


def batches(compiled: DataFrame, *, max_resources: int = batching.MAX_RESOURCES, max_characteristics: int = batching.MAX_CHARACTERISTICS) -> DataFrame:
    """Commands with batch (from 0), in order, under both ceilings. Objects that only carry relations come last."""
    placed = compiled.withColumn("rank", F.coalesce("rank", F.lit(1 << 20))).drop("position")
    return batching.batches(placed, ["rank", "local_id"], {"n_resources": max_resources, "n_characteristics": max_characteristics})


def batch_identities(batched: DataFrame) -> DataFrame:
    """batch, n_commands, digest: a batch has the same digest in whatever order its rows are read."""
    text = artifacts.row_text(batched.select("local_id", "operation", "attributes", "relations"))
    rows = batched.select("batch", "position", canonical.digest("plan", text).alias("one"))
    listed = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n_commands"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "one"))), lambda x: x["one"]), "\n").alias("text"))
    return listed.select("batch", "n_commands", canonical.digest("plan", F.col("text")).alias("digest"))
