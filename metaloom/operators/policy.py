"""Policies over catalog objects: owners, descriptions and relationships that must be there.

objects: kind, local_id, name, owner, description. policies: policy_id, severity, rule_type, kind, object_id, id_prefix.
relationships: from_id, to_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..shared import small

SEVERITIES = ("error", "warning", "info")


def selected(objects: DataFrame, policies: DataFrame) -> DataFrame:
    """Objects with each policy that selects them. A prefix is literal: _ and % are ordinary characters. Policies are
    few and broadcast if so, as all objects share some kinds."""
    p = small(policies.withColumnRenamed("kind", "policy_kind"))
    match = (objects["kind"] == p["policy_kind"]) & (p["object_id"].isNull() | (p["object_id"] == objects["local_id"])) & (p["id_prefix"].isNull() | objects["local_id"].startswith(p["id_prefix"]))
    return objects.join(p, match).drop("policy_kind")


def evaluate(objects: DataFrame, policies: DataFrame, relationships: DataFrame | None = None) -> DataFrame:
    """Violations: policy_id, severity, rule_type, kind, local_id, name, reason."""
    chosen = selected(objects, policies)
    if relationships is not None:
        ends = relationships.select(F.explode(F.array("from_id", "to_id")).alias("end")).distinct()
        chosen = chosen.join(ends, chosen["local_id"] == ends["end"], "left")
    else:
        chosen = chosen.withColumn("end", F.lit(None).cast("string"))
    reason = (
        F.when((F.col("rule_type") == "require_owner") & is_blank(F.col("owner")), "missing_owner")
        .when((F.col("rule_type") == "require_description") & is_blank(F.col("description")), "missing_description")
        .when((F.col("rule_type") == "require_relationship") & F.col("end").isNull(), "missing_relationship")
    )
    return chosen.withColumn("reason", reason).filter("reason IS NOT NULL").select("policy_id", "severity", "rule_type", "kind", "local_id", "name", "reason")


def severity_rank():
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), F.col("severity"))


def top(violations: DataFrame, most: int = 20) -> DataFrame:
    """The first violations in report order, and beside each the number of all."""
    total = violations.agg(F.count(F.lit(1)).alias("n_all"))
    first = violations.orderBy(severity_rank(), "policy_id", "kind", "local_id", "rule_type", "reason").limit(most)
    return first.join(F.broadcast(total))


def counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("severity").agg(F.count(F.lit(1)).alias("n_violations"))


def is_clear(violations: DataFrame) -> DataFrame:
    """One row: ok if no violation is an error."""
    return violations.agg((F.count_if(F.col("severity") == "error") == 0).alias("ok"))


def unfit(policies: DataFrame) -> DataFrame:
    """Policies that cannot be applied: policy_id and why."""
    allowed = F.create_map(*(F.lit(x) for pair in {"require_owner": "data_source,table", "require_description": "data_source,database,schema,table,column", "require_relationship": "table"}.items() for x in pair))
    repeated = policies.groupBy("policy_id").count().filter("count > 1").select("policy_id", F.lit("repeated_id").alias("problem"))
    kinds = F.split(F.try_element_at(allowed, F.col("rule_type")), ",")
    why = F.when(kinds.isNull(), "unknown_rule").when(~F.array_contains(kinds, F.col("kind")), "kind_not_allowed").when(~F.col("severity").isin(*SEVERITIES), "unknown_severity").when(F.col("object_id").isNotNull() & F.col("id_prefix").isNotNull(), "id_and_prefix")
    return policies.select("policy_id", why.alias("problem")).filter("problem IS NOT NULL").unionByName(repeated)
