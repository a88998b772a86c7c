"""Comparison of two catalog snapshots, object by object and property by property.

objects: object_key, kind, parent_key. properties: object_key, pointer, has_value, value_json.

A property that is missing, one that is null and one with a value are three things; two sides are equal only if both
presence and canonical value are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import escaped

#: Order of changes in reports.
CHANGE_RANK = ("added", "removed", "changed")


def same(a_has: Column, a: Column, b_has: Column, b: Column) -> Column:
    return a_has.eqNullSafe(b_has) & a.eqNullSafe(b)


def property_changes(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Properties that differ, of objects on either side: object_key, pointer and presence and value of each side."""
    b = baseline.select("object_key", "pointer", F.col("has_value").alias("base_has"), F.col("value_json").alias("base_json"))
    c = candidate.select("object_key", "pointer", F.col("has_value").alias("cand_has"), F.col("value_json").alias("cand_json"))
    joined = b.join(c, ["object_key", "pointer"], "full").withColumns({"base_has": F.coalesce("base_has", F.lit(False)), "cand_has": F.coalesce("cand_has", F.lit(False))})
    return joined.filter(~same(F.col("base_has"), F.col("base_json"), F.col("cand_has"), F.col("cand_json")))


def object_changes(base_objects: DataFrame, cand_objects: DataFrame, base_properties: DataFrame, cand_properties: DataFrame) -> DataFrame:
    """Every object of either side with its change (added, removed, changed, unchanged) and number of changed properties."""
    b = base_objects.select("object_key", F.lit(True).alias("in_base"))
    c = cand_objects.select("object_key", F.lit(True).alias("in_cand"))
    changed = property_changes(base_properties, cand_properties).groupBy("object_key").agg(F.count(F.lit(1)).alias("n"))
    both = b.join(c, "object_key", "full").join(changed, "object_key", "left")
    change = F.when(F.col("in_base").isNull(), "added").when(F.col("in_cand").isNull(), "removed").when(F.col("n") > 0, "changed").otherwise("unchanged")
    return both.select("object_key", change.alias("change"), F.when(change == "changed", F.col("n")).otherwise(F.lit(0)).alias("n_properties"))


def changed_properties(base_objects: DataFrame, cand_objects: DataFrame, base_properties: DataFrame, cand_properties: DataFrame) -> DataFrame:
    """property_changes() of the objects that both sides have."""
    found = property_changes(base_properties, cand_properties)
    return found.join(base_objects.select("object_key"), "object_key", "left_semi").join(cand_objects.select("object_key"), "object_key", "left_semi")


def summary(changes: DataFrame) -> DataFrame:
    """One row: counts of objects by change, of changed properties, and the status."""
    n = lambda change: F.count_if(F.col("change") == change).alias(change)
    s = changes.agg(n("added"), n("removed"), n("changed"), n("unchanged"), F.coalesce(F.sum("n_properties"), F.lit(0)).alias("property_changes"))
    return s.withColumn("status", F.when(F.col("added") + F.col("removed") + F.col("changed") == 0, "identical").otherwise("different"))


def inverse(changes: DataFrame) -> DataFrame:
    """object_changes() as they are when the sides are swapped."""
    swapped = F.when(F.col("change") == "added", "removed").when(F.col("change") == "removed", "added").otherwise(F.col("change"))
    return changes.withColumn("change", swapped)


def in_report_order(changes: DataFrame) -> DataFrame:
    """The changes (not what is unchanged), sorted as reports list them."""
    rank = F.array_position(F.array(*(F.lit(c) for c in CHANGE_RANK)), F.col("change"))
    return changes.filter("change != 'unchanged'").orderBy(rank, "object_key")


def root_alignment(baseline: tuple[str, str], candidate: tuple[str, str], *, sources: bool = False, databases: bool = False) -> dict[str, bool]:
    """Which roots (source, database) are to be aligned. Names that differ need to be acknowledged."""
    differ = {"source": baseline[0] != candidate[0], "database": baseline[1] != candidate[1]}
    missing = [k for k, ok in (("source", sources), ("database", databases)) if differ[k] and not ok]
    if missing:
        raise ValueError(f"the snapshots' {' and '.join(missing)} names differ and are not acknowledged")
    return differ


def unlike(baseline: dict, candidate: dict) -> list[str]:
    """Why two snapshots cannot be compared: they differ in system type or scanner."""
    return [k for k in ("system_type", "scanner", "scanner_contract_version") if baseline.get(k) != candidate.get(k)]


def out_of_order(changes: DataFrame, order: str) -> DataFrame:
    """Rows of a stored comparison (with their position in a column of that name) that come before their predecessor.

    Each row meets its predecessor by position, so no task sees all rows.
    """
    rank = F.array_position(F.array(*(F.lit(c) for c in CHANGE_RANK)), F.col("change"))
    rows = changes.select(F.col(order).alias("at"), F.struct(rank.alias("rank"), "object_key").alias("key"))
    before = rows.select((F.col("at") + 1).alias("at"), F.col("key").alias("before"))
    return rows.join(before, "at").filter(F.col("key") < F.col("before")).select(F.col("at").alias(order))


def orphans(changes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Added or removed ancestors whose descendants do not share their change: object_key, ancestor_key.

    ancestors: object_key, ancestor_key.
    """
    moved = changes.filter("change IN ('added', 'removed')").select(F.col("object_key").alias("ancestor_key"), F.col("change").alias("up"))
    return ancestors.join(moved, "ancestor_key").join(changes.select("object_key", "change"), "object_key").filter("change != up").select("object_key", "ancestor_key")


def problems(changes: DataFrame, properties: DataFrame) -> DataFrame:
    """What is wrong with a stored comparison: object_key and problem. Its counts must be those of its property rows,
    which only changed objects have, and of which the sides differ."""
    n = properties.groupBy("object_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(same(F.col("base_has"), F.col("base_json"), F.col("cand_has"), F.col("cand_json"))).alias("n_same"))
    both = changes.join(n, "object_key", "full").withColumns({"n": F.coalesce("n", F.lit(0)), "n_same": F.coalesce("n_same", F.lit(0))})
    why = (
        F.when(F.col("change").isNull(), "property_of_unknown_object")
        .when(~F.col("change").isin(*CHANGE_RANK, "unchanged"), "unknown_change")
        .when((F.col("change") != "changed") & (F.col("n") > 0), "property_of_unchanged_object")
        .when(F.col("n_same") > 0, "equal_sides")
        .when((F.col("change") == "changed") & (F.col("n") == 0), "changed_without_property")
        .when(F.col("n_properties") != F.col("n"), "wrong_count")
    )
    return both.select("object_key", why.alias("problem")).filter("problem IS NOT NULL")


#: The roots whose names a comparison states, and the member that states each.
ROOTS = {"data_source": "source", "database": "database"}


def metadata_problems(comparisons: DataFrame, renamed: DataFrame, contract: str = "1") -> DataFrame:
    """What is wrong with what stored comparisons say of their two sides: comparison, path, problem.

    comparisons: comparison, baseline and candidate (structs of system_type, scanner, scanner_contract_version, source,
    database), aligned_source and aligned_database (structs of baseline and candidate; null where nothing is aligned).
    renamed: comparison, kind and the sides (base_has, base_json, cand_has, cand_json) of changes of a root's name.
    Names that differ must be aligned, and told as a change of the root's name; names that are equal must be neither.
    """
    b, c = F.col("baseline"), F.col("candidate")
    found = [(F.lit(f"/candidate/{name}"), F.lit("must be that of the baseline"), ~b[name].eqNullSafe(c[name])) for name in ("system_type", "scanner")]
    for side in (b, c):
        path = F.lit("/baseline/scanner_contract_version" if side is b else "/candidate/scanner_contract_version")
        found.append((path, F.lit("unsupported version"), ~side["scanner_contract_version"].eqNullSafe(F.lit(contract))))
    # A root has one name; a second change of it is as wrong as one that says something else.
    told = renamed.filter(F.col("kind").isin(*ROOTS)).groupBy("comparison", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("base_has", "base_json", "cand_has", "cand_json")).alias("x"))
    by_kind = told.groupBy("comparison").agg(*(F.first(F.when(F.col("kind") == kind, F.struct("n", "x")), ignorenulls=True).alias(kind) for kind in ROOTS))
    rows = comparisons.join(by_kind, "comparison", "left")
    for kind, name in ROOTS.items():
        aligned, change, equal = F.col(f"aligned_{name}"), F.col(kind), b[name].eqNullSafe(c[name])
        good = b[name].eqNullSafe(aligned["baseline"]) & c[name].eqNullSafe(aligned["candidate"])
        at = F.lit(f"/root_alignment/{name}")
        found.append((at, F.lit("must be null where names are equal"), equal & aligned.isNotNull()))
        found.append((at, F.lit("is not what the sides say"), ~equal & (aligned.isNull() | ~good)))
        side = lambda has, json, value: F.coalesce(change["x"][has], F.lit(False)) & change["x"][json].eqNullSafe(escaped(value))
        same_names = (change["n"] == 1) & side("base_has", "base_json", b[name]) & side("cand_has", "cand_json", c[name])
        at = F.lit("/object_changes")
        found.append((at, F.lit(f"a change of the {kind}'s name where names are equal"), equal & change.isNotNull()))
        found.append((at, F.lit(f"no change of the {kind}'s name"), ~equal & change.isNull()))
        found.append((at, F.lit(f"the change of the {kind}'s name is not what the sides say"), ~equal & change.isNotNull() & ~same_names))
    every = F.array(*(F.when(when, F.struct(path.alias("path"), problem.alias("problem"))) for path, problem, when in found))
    return rows.select("comparison", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("x")).select("comparison", "x.*")
