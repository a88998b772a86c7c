"""Reconciliation of a desired with a remote catalog: plans, overlays of decided values, and staleness.

assets: local_id, name, display_name, attributes (map of text). relationships: source_id, target_id, type_ref.
decisions: local_id, field, pointer, safe, applicable, target (ok, has_value, value), digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .batching import running_sums


def sorted_map(c: Column) -> Column:
    """A map as a sorted array of entries, which can be compared. Null is empty."""
    return F.coalesce(F.array_sort(F.map_entries(c)), F.array().cast("array<struct<key:string,value:string>>"))


def managed(remote: DataFrame, domain: str, types: list[str]) -> DataFrame:
    """Remote objects with managed: in the domain, of a managed type and with a local id that is not blank."""
    return remote.withColumn("managed", F.coalesce((F.col("domain_ref") == domain) & F.col("type_ref").isin(*types) & ~is_blank(F.col("local_id")), F.lit(False)))


def unmanaged_count(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.count_if("managed").alias("managed"), F.count_if(~F.col("managed")).alias("ignored"))


def changed_fields(a: str, b: str) -> Column:
    """The fields in which an asset differs from its remote: name, display_name (blank is none), managed_attributes."""
    shown = lambda side: F.when(is_blank(F.col(f"{side}.display_name")), F.lit(None)).otherwise(F.col(f"{side}.display_name"))
    tests = {"name": F.col(f"{a}.name").eqNullSafe(F.col(f"{b}.name")), "display_name": shown(a).eqNullSafe(shown(b)), "managed_attributes": sorted_map(F.col(f"{a}.attributes")) == sorted_map(F.col(f"{b}.attributes"))}
    return F.filter(F.array(*(F.when(~same, F.lit(name)) for name, same in tests.items())), lambda x: x.isNotNull())


def plan_assets(desired: DataFrame, remote: DataFrame) -> DataFrame:
    """local_id, action (create, update, unchanged, remote_only), changed_fields."""
    d, r = desired.alias("d"), remote.alias("r")
    both = d.join(r, F.col("d.local_id") == F.col("r.local_id"), "full")
    fields = F.when(F.col("d.local_id").isNotNull() & F.col("r.local_id").isNotNull(), changed_fields("d", "r")).otherwise(F.array().cast("array<string>"))
    out = both.select(F.coalesce("d.local_id", "r.local_id").alias("local_id"), F.col("d.local_id").isNull().alias("no_desired"), F.col("r.local_id").isNull().alias("no_remote"), fields.alias("changed_fields"))
    action = F.when(F.col("no_remote"), "create").when(F.col("no_desired"), "remote_only").when(F.size("changed_fields") > 0, "update").otherwise("unchanged")
    return out.select("local_id", action.alias("action"), "changed_fields")


def plan_relationships(desired: DataFrame, remote: DataFrame) -> DataFrame:
    """source_id, target_id, type_ref, action (create, unchanged, remote_only)."""
    key = ["source_id", "target_id", "type_ref"]
    d = desired.select(*key, F.lit(True).alias("in_desired")).distinct()
    r = remote.select(*key, F.lit(True).alias("in_remote")).distinct()
    action = F.when(F.col("in_remote").isNull(), "create").when(F.col("in_desired").isNull(), "remote_only").otherwise("unchanged")
    return d.join(r, key, "full").select(*key, action.alias("action"))


def counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("n_actions"))


# The order of levels by the prefix of a local id.
LEVELS = ("ds:", "db:", "sch:", "tbl:", "col:")


def execution_order(assets: DataFrame) -> DataFrame:
    """Actions to carry out with rank: creates from the top level down, then updates; by rank and local_id they are in order."""
    level = F.lit(len(LEVELS))
    for i, prefix in reversed(list(enumerate(LEVELS))):
        level = F.when(F.col("local_id").startswith(prefix), F.lit(i)).otherwise(level)
    rank = F.when(F.col("action") == "create", level).otherwise(F.lit(len(LEVELS) + 1))
    return assets.filter("action IN ('create', 'update')").withColumn("rank", rank)


def in_plan_order(actions: DataFrame) -> DataFrame:
    """Actions (action, kind, local_id, remote_id) with position, from 0 on, as a plan lists them: by all four, a
    missing id before any other."""
    keys = {"order_local": F.coalesce("local_id", F.lit("")), "order_remote": F.coalesce("remote_id", F.lit(""))}
    return running_sums(actions.withColumns(keys), ["action", "kind", *keys], []).drop(*keys)


def relation_hosts(relations: DataFrame, order: DataFrame) -> DataFrame:
    """Each new relation with the end that comes later in the order (local_id, position), which carries it."""
    p = order.select("local_id", "position")
    s = p.select(F.col("local_id").alias("source_id"), F.col("position").alias("s_at"))
    t = p.select(F.col("local_id").alias("target_id"), F.col("position").alias("t_at"))
    at = relations.join(s, "source_id", "left").join(t, "target_id", "left")
    return at.withColumn("host", F.when(F.coalesce("s_at", F.lit(-1)) > F.coalesce("t_at", F.lit(-1)), F.col("source_id")).otherwise(F.col("target_id"))).drop("s_at", "t_at")


def repeated_names(assets: DataFrame) -> DataFrame:
    """Names that two objects of a domain would share; there must be none."""
    return assets.groupBy("name", "domain_ref").agg(F.count_distinct("local_id").alias("n_objects")).filter("n_objects > 1")


def occupied(creates: DataFrame, remote: DataFrame) -> DataFrame:
    """Objects to create whose name is taken in their domain; there must be none."""
    return creates.join(remote.select("name", "domain_ref").distinct(), ["name", "domain_ref"], "left_semi")


def overlay(desired: DataFrame, remote: DataFrame, decisions: DataFrame, type_refs: dict[str, str]) -> DataFrame:
    """Desired assets with the values that decisions give them.

    Only safe, applicable decisions with a value that can be shown count. A null is left out of a new asset, and lets
    an existing one keep its remote value. type_refs: the attribute that description, data_type and owner feed.
    """
    fit = decisions.filter("safe AND applicable").select("local_id", F.struct("field", F.col("target.has_value").alias("has"), F.col("target.value").alias("value")).alias("set"))
    sets = fit.groupBy("local_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("set.field"), F.col("set")))).alias("sets"))
    r = remote.select("local_id", F.lit(True).alias("known"), F.col("display_name").alias("r_display"), F.col("attributes").alias("r_attributes"))
    both = desired.join(sets, "local_id", "left").join(r, "local_id", "left")
    name = F.try_element_at("sets", F.lit("display_name"))
    display = F.when(name.isNull(), F.col("display_name")).when(name["has"], name["value"]).when(F.col("known"), F.col("r_display"))
    refs = F.create_map(*(F.lit(x) for pair in type_refs.items() for x in pair))
    # Attributes that decisions touch go first; their values, or the remote ones for null, come back.
    touched = F.filter(F.map_keys("sets"), lambda k: F.map_contains_key(refs, k))
    gone = F.transform(touched, lambda k: F.element_at(refs, k))
    rest = F.map_filter("attributes", lambda k, v: ~F.array_contains(gone, k))
    pair = lambda k: F.struct(F.element_at(refs, k).alias("key"), F.when(F.element_at("sets", k)["has"], F.element_at("sets", k)["value"]).otherwise(F.try_element_at("r_attributes", F.element_at(refs, k))).alias("value"))
    added = F.map_from_entries(F.filter(F.transform(touched, pair), lambda e: e["value"].isNotNull()))
    attributes = F.when(F.col("sets").isNull(), F.col("attributes")).otherwise(F.map_concat(rest, added))
    return both.select(*(attributes.alias(c) if c == "attributes" else display.alias(c) if c == "display_name" else F.col(c) for c in desired.columns))


def field_values(assets: DataFrame, type_refs: dict[str, str]) -> DataFrame:
    """local_id, field, value for the fields that decisions can feed."""
    fields = F.array(F.struct(F.lit("display_name").alias("field"), F.col("display_name").alias("value")), *(F.struct(F.lit(k).alias("field"), F.try_element_at("attributes", F.lit(v)).alias("value")) for k, v in type_refs.items()))
    return assets.select("local_id", F.explode(fields).alias("f")).select("local_id", "f.field", "f.value")


def assumptions(actions: DataFrame, baseline: DataFrame, reconciled: DataFrame, remote: DataFrame, decisions: DataFrame, type_refs: dict[str, str]) -> DataFrame:
    """The decisions on which a plan rests: local_id, field, mutation, overlay and the decision.

    A create rests on all of its object's mapped decisions, an update on those whose field changes (mutation: the new
    value differs from the remote one; overlay: it differs from the baseline), an unchanged object on overlays alone.
    """
    side = lambda df, name: field_values(df, type_refs).withColumnRenamed("value", name)
    v = side(reconciled, "new").join(side(baseline, "base"), ["local_id", "field"], "left").join(side(remote, "old"), ["local_id", "field"], "left")
    v = v.withColumns({"mutation": ~F.col("new").eqNullSafe(F.col("old")), "overlay": ~F.col("new").eqNullSafe(F.col("base"))}).join(actions.select("local_id", "action"), "local_id")
    on = F.when(F.col("action") == "create", True).when(F.col("action") == "update", F.col("mutation") | F.col("overlay")).when(F.col("action") == "unchanged", F.col("overlay")).otherwise(False)
    return v.filter(on).join(decisions, ["local_id", "field"]).drop("new", "base", "old")


def blocking(resting: DataFrame) -> DataFrame:
    """Decisions of assumptions() that forbid the plan: applicable, but not safe."""
    return resting.filter("applicable AND NOT safe")


def stale_decisions(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Saved decisions (local_id, field, digest) that are gone or have another digest now."""
    now = current.select("local_id", "field", F.col("digest").alias("now"))
    return saved.join(now, ["local_id", "field"], "left").filter(~F.col("digest").eqNullSafe(F.col("now"))).drop("now")


def stale_categories(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Categories (category, digest) of a saved plan whose digest is another now."""
    now = current.select("category", F.col("digest").alias("now"))
    return saved.join(now, "category", "left").filter(~F.col("digest").eqNullSafe(F.col("now"))).select("category")


def index_conflicts(known: DataFrame, index: DataFrame) -> DataFrame:
    """Objects whose local id the physical index gives to another node. Both: local_id, node_key."""
    i = index.select("local_id", F.col("node_key").alias("indexed"))
    return known.join(i, "local_id").filter("node_key != indexed")


def missing_types(mapping: DataFrame, remote_types: DataFrame) -> DataFrame:
    """References of a mapping (category, ref) that the remote catalog lacks, or that are placeholders."""
    hollow = mapping.filter(F.col("ref").rlike("<[^>]+>")).select("category", "ref", F.lit("placeholder").alias("problem"))
    lost = mapping.filter(~F.col("ref").rlike("<[^>]+>")).join(remote_types.select("ref").distinct(), "ref", "left_anti").select("category", "ref", F.lit("unknown").alias("problem"))
    return hollow.unionByName(lost)


# How a remote job's state and result read.
JOB_STATES = {("WAITING", None): "waiting", ("RUNNING", None): "running", ("COMPLETED", "SUCCESS"): "succeeded", ("COMPLETED", "COMPLETED_WITH_ERROR"): "failed", ("COMPLETED", "FAILURE"): "failed", ("COMPLETED", "ABORTED"): "canceled", ("ERROR", None): "failed", ("CANCELED", None): "canceled"}


def job_states(jobs: DataFrame) -> DataFrame:
    """Jobs (state, result) with their outcome; what the table does not have is unknown."""
    out = F.lit("unknown")
    for (state, result), outcome in JOB_STATES.items():
        out = F.when((F.upper("state") == state) & (F.lit(True) if result is None else F.upper("result").eqNullSafe(F.lit(result))), outcome).otherwise(out)
    return jobs.withColumn("outcome", out)


# Statuses of a check before a run, the worst first.
CHECK_STATUSES = ("INCOMPATIBLE", "OPERATIONAL_FAILURE", "NOT_VERIFIED", "WARNING", "VERIFIED")


def preflight_status(checks: DataFrame) -> DataFrame:
    """The worst status of each report's blocking checks, VERIFIED if it has none. checks: report, status, blocking.

    A status that is none of the known ones is an error.
    """
    rank = F.array_position(F.array(*map(F.lit, CHECK_STATUSES)), F.col("status"))
    known = F.when(rank > 0, rank).otherwise(F.raise_error(F.concat(F.lit("unknown status of a check: "), F.coalesce("status", F.lit("null")))))
    worst = F.min(F.when(F.col("blocking"), known))
    return checks.groupBy("report").agg(F.element_at(F.array(*map(F.lit, CHECK_STATUSES)), F.coalesce(worst, F.lit(len(CHECK_STATUSES))).cast("int")).alias("overall"))


#: Which identities must be the same in which two steps of a run.
AGREEING = {"config": ("config", "plan"), "policy": ("policy", "plan"), "snapshot": ("policy", "plan")}


def disagreements(stated: DataFrame) -> DataFrame:
    """Identities on which the steps of a run do not agree: run, name and what each step states.

    stated: run, step, name, digest. An identity that one of the two steps does not state is no agreement; steps that
    state one twice, with different digests, do not agree either.
    """
    due = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(a).alias("first"), F.lit(b).alias("second")) for name, (a, b) in AGREEING.items()))
    runs = stated.select("run").distinct().select("run", F.explode(due).alias("x")).select("run", "x.*")
    said = stated.groupBy("run", "name").agg(*(part for step in ("config", "policy", "plan") for part in (F.max(F.when(F.col("step") == step, F.col("digest"))).alias(step), F.min(F.when(F.col("step") == step, F.col("digest"))).alias(f"{step}_too"))))
    rows = runs.join(said, ["run", "name"], "left")
    of = lambda end, more="": reduce(lambda a, b: F.coalesce(a, b), (F.when(F.col(end) == step, F.col(f"{step}{more}")) for step in ("config", "policy", "plan")))
    agree = (of("first") == of("second")) & (of("first") == of("first", "_too")) & (of("second") == of("second", "_too"))
    return rows.filter(~F.coalesce(agree, F.lit(False))).select("run", "name", of("first").alias("first_digest"), of("second").alias("second_digest"))
