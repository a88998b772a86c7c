"""Property observations, and conflicts between them decided by authority rules.

observations: object_key, namespace, kind, pointer, value_json, provenance
rules: kind, pointer, namespace (null: any), provider_type, source_ref (null: any)

A rule with a namespace is more specific than one without. Values are equal if their canonical JSON text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import is_pointer, json_string
from ..functions.text import is_blank
from ..shared import small
from .batching import running_sums
from .graph import provenance_union, stated

OBJECT = ["object_key", "namespace", "kind"]
RULE = ["kind", "pointer", "namespace", "provider_type", "source_ref"]


def normalize(observations: DataFrame) -> DataFrame:
    """One row for each value of a property of an object, with the union of its provenance."""
    return stated(observations).groupBy(*OBJECT, "pointer", "value_json").agg(provenance_union())


def merge(*sets: DataFrame) -> DataFrame:
    """Several sets of observations as one normalized set."""
    every = sets[0]
    for s in sets[1:]:
        every = every.unionByName(s)
    return normalize(every)


def in_entry_order(observations: DataFrame) -> DataFrame:
    """Normalized observations with position, from 0 on, as an artifact lists them: by the canonical JSON texts of
    their object, pointer, provenance and value."""
    names = ("observation_mode", "provider_type", "source_ref", "source_version")
    said = F.to_json(F.transform("provenance", lambda p: F.struct(*(p[x].alias(x) for x in names))), {"ignoreNullFields": "false"})
    rows = normalize(observations).withColumns({"order_pointer": json_string(F.col("pointer")), "order_provenance": said})
    return running_sums(rows, ["object_key", "order_pointer", "order_provenance", "value_json"], []).drop("order_pointer", "order_provenance")


def pointers(observations: DataFrame) -> DataFrame:
    """How many properties of each object are observed: object_key, n_pointers."""
    return observations.groupBy("object_key").agg(F.count_distinct("pointer").alias("n_pointers"))


def rule_set(rules: DataFrame) -> DataFrame:
    """Rules, each once."""
    return rules.select(*RULE).distinct()


def declared(rules: DataFrame) -> DataFrame:
    """Rules (with a column id), each once with the sorted ids of all that declare it."""
    return rules.groupBy(*RULE).agg(F.array_sort(F.collect_set("id")).alias("declared_by"))


def unfit_observations(observations: DataFrame) -> DataFrame:
    """Observations that cannot be taken: object_key, pointer and why."""
    none = lambda c: is_blank(F.col(c))
    why = (
        F.when(none("object_key") | none("namespace") | none("kind"), "identity_missing")
        .when(~is_pointer(F.col("pointer")), "no_pointer")
        .when(F.col("value_json").isNull(), "value_missing")
        .when(F.coalesce(F.size("provenance"), F.lit(0)) < 1, "provenance_missing")
        .when(F.exists("provenance", lambda p: is_blank(p["provider_type"]) | is_blank(p["source_ref"])), "source_missing")
    )
    return observations.select("object_key", "pointer", why.alias("problem")).filter("problem IS NOT NULL")


def ambiguous_selectors(rules: DataFrame) -> DataFrame:
    """Selectors with more than one authority: a rule set must have none when it is loaded."""
    return rule_set(rules).groupBy("kind", "pointer", "namespace").agg(F.count(F.lit(1)).alias("n_authorities")).filter("n_authorities > 1")


def _winning(rules: DataFrame, properties: DataFrame) -> DataFrame:
    """For each property with a rule: the number of different authorities of the best rank, and one of them."""
    r = small(rule_set(rules)).select(F.col("kind").alias("r_kind"), F.col("pointer").alias("r_pointer"), F.col("namespace").alias("r_namespace"), "provider_type", "source_ref")
    on = (properties["kind"] == r["r_kind"]) & (properties["pointer"] == r["r_pointer"]) & (r["r_namespace"].isNull() | (r["r_namespace"] == properties["namespace"]))
    named = F.col("r_namespace").isNotNull()
    rule = F.struct("r_namespace", "provider_type", "source_ref")
    # Two ranks only: counts by rank in one aggregation, no window over a property's rules.
    found = properties.join(r, on).groupBy("kind", "pointer", properties["namespace"]).agg(F.count_if(named).alias("n_named"), F.count_if(~named).alias("n_any"), F.min(F.when(named, rule)).alias("named_rule"), F.min(F.when(~named, rule)).alias("any_rule"))
    first = F.col("n_named") > 0
    return found.select(F.col("kind"), F.col("pointer"), F.col("namespace"), F.when(first, F.col("n_named")).otherwise(F.col("n_any")).alias("n_rules"), F.when(first, F.col("named_rule")).otherwise(F.col("any_rule")).alias("rule"))


def decide(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """The state of every observed property: n_values, n_sources, state, reason, has_effective_value, effective_json and
    rule (the winning one, where there is one alone). Values are counted, never collected; normalize() has them."""
    rows = normalize(observations)
    won = small(_winning(rules, observations.select("kind", "pointer", "namespace").distinct()))
    won = won.select(F.col("kind").alias("w_kind"), F.col("pointer").alias("w_pointer"), F.col("namespace").alias("w_namespace"), "n_rules", "rule")
    on = (rows["kind"] == won["w_kind"]) & (rows["pointer"] == won["w_pointer"]) & rows["namespace"].eqNullSafe(won["w_namespace"])
    by_rule = lambda p: (p["provider_type"] == F.col("rule.provider_type")) & (F.col("rule.source_ref").isNull() | (p["source_ref"] == F.col("rule.source_ref")))
    authorized = (F.col("n_rules") == 1) & F.exists("provenance", by_rule)
    joined = rows.join(won, on, "left").groupBy(*OBJECT, "pointer").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.sum(F.size("provenance")).alias("n_sources"),
        F.min("value_json").alias("one"),
        F.count_if(authorized).alias("n_authorized"),
        F.min(F.when(authorized, F.col("value_json"))).alias("authorized"),
        F.first("n_rules").alias("n_rules"),
        F.first("rule").alias("rule"),
    )
    n = F.col("n_authorized")
    reason = (
        F.when(F.col("n_values") == 1, F.when(F.col("n_sources") == 1, "SINGLE_OBSERVATION").otherwise("AGREEMENT"))
        .when(F.col("n_rules").isNull(), "NO_AUTHORITY_RULE")
        .when(F.col("n_rules") > 1, "INVALID_OR_AMBIGUOUS_AUTHORITY")
        .when(n == 0, "AUTHORITATIVE_SOURCE_NOT_OBSERVED")
        .when(n == 1, "RESOLVED_BY_AUTHORITY")
        .otherwise("AUTHORITATIVE_SOURCE_CONFLICTED")
    )
    open_ = F.col("reason").isin("NO_AUTHORITY_RULE", "AUTHORITATIVE_SOURCE_NOT_OBSERVED", "AUTHORITATIVE_SOURCE_CONFLICTED")
    effective = F.when(F.col("n_values") == 1, F.col("one")).when(F.col("reason") == "RESOLVED_BY_AUTHORITY", F.col("authorized"))
    return joined.withColumn("reason", reason).select(
        *OBJECT,
        "pointer",
        "n_values",
        "n_sources",
        F.when(open_, "UNRESOLVED_CONFLICT").otherwise(F.col("reason")).alias("state"),
        "reason",
        F.col("reason").isin("SINGLE_OBSERVATION", "AGREEMENT", "RESOLVED_BY_AUTHORITY").alias("has_effective_value"),
        effective.alias("effective_json"),
        F.when((F.col("n_rules") == 1) & (F.col("n_values") > 1), F.col("rule")).alias("rule"),
    )


# --- what a decision allows ------------------------------------------------------------------------------------

# The properties that reach a target, the target's fields, and the kinds that have them (none: all).
TARGET_FIELDS = {"/name": ("display_name", None), "/description": ("description", None), "/attributes/data_type": ("data_type", ("column",)), "/attributes/ownership": ("owner", ("data_source", "dataset", "table"))}


def target_field(pointer: Column, kind: Column) -> Column:
    """The field that a property of such an object feeds; null if there is none."""
    out = F.lit(None).cast("string")
    for path, (field, kinds) in TARGET_FIELDS.items():
        out = F.when((pointer == path) & (F.lit(True) if kinds is None else kind.isin(*kinds)), F.lit(field)).otherwise(out)
    return out


def converted(field: Column, value_json: Column) -> Column:
    """A struct (ok, has_value, value): a canonical JSON value as a field's text. A null value is representable."""
    # A JSON list of one object with name and type, both text; other keys may stand beside them.
    owner = F.from_json(value_json, "array<struct<name:string,type:string>>")
    one = F.get(owner, F.lit(0))
    is_text = value_json.startswith('"')
    text = F.get(F.from_json(F.concat(F.lit("["), value_json, F.lit("]")), "array<string>"), F.lit(0))
    listed = value_json.startswith("[{") & (F.size(owner) == 1) & value_json.rlike(r'"name":"') & value_json.rlike(r'"type":"')
    blank = F.trim(F.regexp_replace(text, r"\s", " ")) == ""
    null = value_json == "null"
    ok = F.when(field.isNull(), False).when(null, True).when(field == "description", is_text).when(field == "owner", listed & (F.trim(one["name"]) != "")).otherwise(is_text & ~blank)
    value = F.when(null, F.lit(None).cast("string")).when(field == "owner", one["name"]).otherwise(text)
    good = F.coalesce(ok, F.lit(False))
    return F.struct(good.alias("ok"), (good & ~null).alias("has_value"), F.when(good, value).alias("value"))


def assess(decisions: DataFrame) -> DataFrame:
    """decide() with applicable, safe, assessment (its reason), field and target (the converted value)."""
    d = decisions.withColumn("field", target_field(F.col("pointer"), F.col("kind")))
    d = d.withColumn("target", F.when(F.col("has_effective_value"), converted(F.col("field"), F.col("effective_json"))))
    why = (
        F.when(F.col("field").isNull(), "not_reconciliation_mapped")
        .when(F.col("state") == "UNRESOLVED_CONFLICT", "unresolved_conflict")
        .when(F.col("state") == "INVALID_OR_AMBIGUOUS_AUTHORITY", "invalid_or_ambiguous_authority")
        .when(F.coalesce(F.col("target.ok"), F.lit(False)), "safe")
        .otherwise("unsupported_effective_value")
    )
    return d.withColumns({"applicable": F.col("field").isNotNull(), "safe": why == "safe", "assessment": why})


def summary(assessed: DataFrame) -> DataFrame:
    """How many properties there are of each state and assessment."""
    return assessed.groupBy("state", "assessment").agg(F.count(F.lit(1)).alias("n_properties"))


def review_status(assessed: DataFrame) -> DataFrame:
    """One row: blocked if an applicable property is unsafe, findings if any property is in conflict, else clear."""
    bad = F.max(F.col("applicable") & ~F.col("safe"))
    some = F.max(~F.col("state").isin("SINGLE_OBSERVATION", "AGREEMENT"))
    return assessed.agg(F.when(bad, "blocked").when(some, "findings").otherwise("clear").alias("status"))


def explain(assessed: DataFrame, object_key: str, pointer: str | None = None) -> DataFrame:
    """Why an object's properties have their values."""
    found = assessed.filter(F.col("object_key") == object_key)
    return found if pointer is None else found.filter(F.col("pointer") == pointer)


def candidates(observations: DataFrame, decisions: DataFrame) -> DataFrame:
    """The values between which decisions chose: object_key, pointer, value_json, provenance and chosen."""
    one = decisions.select("object_key", "pointer", "effective_json", "has_effective_value")
    rows = normalize(observations).join(one, ["object_key", "pointer"])
    return rows.select("object_key", "pointer", "value_json", "provenance", (F.col("has_effective_value") & (F.col("value_json") == F.col("effective_json"))).alias("chosen"))
