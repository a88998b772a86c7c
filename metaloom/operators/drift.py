"""Expected and unexpected drift: differences of two snapshots held against the rules of a drift policy.

changes: change, object_key, pointer (null for added and removed), base_has, base_json, cand_has, cand_json
rules: rule_id, change, object_key, pointer, exp_base_has, exp_base_json, exp_cand_has, exp_cand_json; a side whose
exp_*_has is null is not restricted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SELECTOR = ["change", "object_key", "pointer"]
EXPECTATION = ["exp_base_has", "exp_base_json", "exp_cand_has", "exp_cand_json"]


def difference_rows(changes: DataFrame, properties: DataFrame) -> DataFrame:
    """The rows to classify: added and removed objects, and each changed property of a changed object."""
    none = F.lit(None).cast("string")
    objects = changes.filter("change IN ('added', 'removed')").select("change", "object_key", none.alias("pointer"), F.lit(False).alias("base_has"), none.alias("base_json"), F.lit(False).alias("cand_has"), none.alias("cand_json"))
    changed = properties.select(F.lit("changed").alias("change"), "object_key", "pointer", "base_has", "base_json", "cand_has", "cand_json")
    return objects.unionByName(changed)


def ambiguous_rules(rules: DataFrame) -> DataFrame:
    """Selectors whose rules expect different things; a policy must have none."""
    return rules.groupBy(*SELECTOR).agg(F.count_distinct(F.struct(*EXPECTATION)).alias("n_expectations"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids")).filter("n_expectations > 1")


def unfit_rules(rules: DataFrame) -> DataFrame:
    """Rules that say nothing or too much: rule_id and why."""
    changed = F.col("change") == "changed"
    why = (
        F.when(~F.col("change").isin("added", "removed", "changed"), "unknown_change")
        .when(changed & F.col("pointer").isNull(), "property_missing")
        .when(~changed & F.col("pointer").isNotNull(), "property_not_allowed")
        .when(changed & F.col("exp_base_has").isNotNull() & F.col("exp_base_has").eqNullSafe(F.col("exp_cand_has")) & F.col("exp_base_json").eqNullSafe(F.col("exp_cand_json")), "sides_equal")
    )
    return rules.select("rule_id", why.alias("problem")).filter("problem IS NOT NULL")


def classify(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """Each difference with classification, reason and the ids of the rules for it."""
    r = rules.groupBy(*SELECTOR, *EXPECTATION).agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))
    r = r.select(*(F.col(c).alias(f"r_{c}") for c in SELECTOR), *EXPECTATION, "rule_ids")
    on = (changes["change"] == r["r_change"]) & (changes["object_key"] == r["r_object_key"]) & changes["pointer"].eqNullSafe(r["r_pointer"])
    joined = changes.join(r, on, "left")

    def met(side: str):
        has, json = F.col(f"exp_{side}_has"), F.col(f"exp_{side}_json")
        return has.isNull() | ((has == F.col(f"{side}_has")) & (~has | json.eqNullSafe(F.col(f"{side}_json"))))

    free = F.col("exp_base_has").isNull() & F.col("exp_cand_has").isNull()
    matched = F.col("rule_ids").isNotNull()
    good = matched & met("base") & met("cand")
    reason = F.when(~matched, "unmatched_difference").when(free, "presence_rule").when(good, "expectation_met").otherwise("expectation_mismatch")
    return joined.select(*(changes[c] for c in changes.columns), F.when(good, "expected").otherwise("unexpected").alias("classification"), reason.alias("reason"), F.coalesce("rule_ids", F.array().cast("array<string>")).alias("rule_ids"))


def summary(classified: DataFrame) -> DataFrame:
    """One row: counts and the status of all differences."""
    bad = F.col("classification") == "unexpected"
    s = classified.agg(F.count_if(~bad).alias("expected"), F.count_if(bad).alias("unexpected"), F.count_distinct("object_key").alias("affected_objects"), F.count_if(F.col("pointer").isNotNull()).alias("property_drift"))
    return s.withColumn("status", F.when(F.col("unexpected") > 0, "unexpected_drift").when(F.col("expected") > 0, "expected_difference").otherwise("no_difference"))


def in_report_order(classified: DataFrame) -> DataFrame:
    """Unexpected differences first, then by object, change, property and reason."""
    rank = F.array_position(F.array(F.lit("added"), F.lit("removed"), F.lit("changed")), F.col("change"))
    return classified.orderBy(F.col("classification") != "unexpected", "object_key", rank, F.col("pointer").asc_nulls_first(), "reason")
