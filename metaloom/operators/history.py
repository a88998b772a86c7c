"""Evolution of objects and properties over a timeline of snapshots.

Position in the timeline is entry_index, not time; pairs are neighbouring entries. Presence is three-valued: a
property can be missing, null or have a value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import canonical
from ..shared import stored
from . import conflicts
from .batching import running_sums
from .graph import stated

#: What each form of context makes available of the dimensions of an entry.
AVAILABLE = {"none": (), "provenance": ("provenance",), "full": ("provenance", "conflict", "authority", "effective_value")}


def steps(entries: DataFrame) -> DataFrame:
    """The entries of one timeline (few, as each is a snapshot) with the entry before and after: entry_index, before_index, after_index."""
    at = entries.agg(F.array_sort(F.collect_set("entry_index")).alias("at")).select("at", F.posexplode("at").alias("i", "entry_index"))
    beside = lambda k: F.when(F.col("i") + k >= 0, F.get("at", F.col("i") + k))
    return at.select("entry_index", beside(-1).alias("before_index"), beside(1).alias("after_index"))


def transitions(entries: DataFrame, properties: DataFrame) -> DataFrame:
    """Each property between each entry and the next, where either has it: from_index, to_index, both sides, the change.

    entries: entry_index. properties: entry_index, object_key, pointer, has_value, value_json. Only rows that are there
    are looked at, each beside the property's row before and after it; what neither entry has is no row.
    """
    w = Window.partitionBy("object_key", "pointer").orderBy("entry_index")
    rows = properties.filter("has_value").select("object_key", "pointer", "entry_index", "value_json").join(steps(entries), "entry_index")
    rows = rows.withColumns({"last": F.lag(F.struct("entry_index", "value_json")).over(w), "following": F.lead("entry_index").over(w)})
    held = F.coalesce(F.col("last.entry_index") == F.col("before_index"), F.lit(False))
    was = F.when(held, F.col("last.value_json"))
    change = F.when(~held, "added").when(was.eqNullSafe(F.col("value_json")), "unchanged").otherwise("changed")
    pair = lambda a, b, a_has, a_json, b_has, b_json, what: F.struct(F.col(a).alias("from_index"), F.col(b).alias("to_index"), a_has.alias("base_has"), a_json.alias("base_json"), b_has.alias("cand_has"), b_json.alias("cand_json"), what.alias("change"))
    none, yes, no = F.lit(None).cast("string"), F.lit(True), F.lit(False)
    into = F.when(F.col("before_index").isNotNull(), pair("before_index", "entry_index", held, was, yes, F.col("value_json"), change))
    gone = F.col("after_index").isNotNull() & ~F.col("following").eqNullSafe(F.col("after_index"))
    out = F.when(gone, pair("entry_index", "after_index", yes, F.col("value_json"), no, none, F.lit("removed")))
    return rows.select("object_key", "pointer", F.explode(F.filter(F.array(into, out), lambda x: x.isNotNull())).alias("x")).select("object_key", "pointer", "x.*")


def transition_counts(entries: DataFrame, properties: DataFrame) -> DataFrame:
    """How many properties make each change between each entry and the next. A property that any entry has and neither
    of the two is counted as unchanged."""
    moved = transitions(entries, properties).groupBy("from_index", "to_index", "change").agg(F.count(F.lit(1)).alias("n"))
    every = properties.filter("has_value").select("object_key", "pointer").distinct().agg(F.count(F.lit(1)).alias("n"))
    pairs = steps(entries).filter("after_index IS NOT NULL").select(F.col("entry_index").alias("from_index"), F.col("after_index").alias("to_index"), F.lit("unchanged").alias("change"))
    rest = moved.select("from_index", "to_index", F.lit("unchanged").alias("change"), -F.col("n"))
    counted = moved.unionByName(rest.toDF("from_index", "to_index", "change", "n")).unionByName(pairs.join(F.broadcast(every)))
    return counted.groupBy("from_index", "to_index", "change").agg(F.sum("n").alias("n_properties")).filter("n_properties > 0")


def evolution(entries: DataFrame, properties: DataFrame, object_key: str, pointer: str | None = None) -> DataFrame:
    """The changes of one object; for one property every transition, changed or not, between all entries."""
    own = properties.filter(F.col("object_key") == object_key)
    if pointer is None:
        return transitions(entries, own).filter("change != 'unchanged'")
    known = transitions(entries, own.filter(F.col("pointer") == pointer)).drop("object_key", "pointer")
    pairs = steps(entries).filter("after_index IS NOT NULL").select(F.col("entry_index").alias("from_index"), F.col("after_index").alias("to_index"))
    filled = {"base_has": F.coalesce("base_has", F.lit(False)), "cand_has": F.coalesce("cand_has", F.lit(False)), "change": F.coalesce("change", F.lit("unchanged"))}
    return pairs.join(known, ["from_index", "to_index"], "left").withColumns({"object_key": F.lit(object_key), "pointer": F.lit(pointer), **filled}).select("object_key", "pointer", *known.columns)


def adjacent_duplicates(entries: DataFrame) -> DataFrame:
    """Entries whose state digest is that of the entry before; they may not be appended. entries: timeline, entry_index, state_digest.

    Each entry meets the one before it by its place in the order of all entries, so a long timeline is no single task.
    """
    placed = running_sums(entries.select("timeline", "entry_index", "state_digest"), ["timeline", "entry_index"], [])
    before = placed.select((F.col("position") + 1).alias("position"), F.col("timeline").alias("b_timeline"), F.col("state_digest").alias("before"))
    return placed.join(before, "position").filter("timeline = b_timeline AND state_digest = before").select("timeline", "entry_index", "state_digest")


def availability(entries: DataFrame) -> DataFrame:
    """Which dimensions each entry has, by its context form."""
    has = lambda dim: F.col("context").isin(*(k for k, v in AVAILABLE.items() if dim in v)).alias(f"has_{dim}")
    return entries.select("entry_index", *(has(d) for d in AVAILABLE["full"]))


def unfit_entries(entries: DataFrame) -> DataFrame:
    """Entries that cannot be in a history: entry_index and why. entries: entry_index, context, observations_path,
    authority_paths (array), algorithm, contract_version, digest.

    Without context an entry names a snapshot alone, with provenance observations too, with full context authority files
    as well. A content identity states its algorithm, the version of its hashing contract and the digest.
    """
    observed, ruled, files = F.col("observations_path").isNotNull(), F.col("authority_paths").isNotNull(), F.coalesce(F.size("authority_paths"), F.lit(0)) > 0
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    why = (
        F.when(~F.coalesce(F.col("context").isin(*AVAILABLE), F.lit(False)), "unknown_context")
        .when((F.col("context") == "none") & (observed | ruled), "snapshot_only")
        .when((F.col("context") == "provenance") & (~observed | ruled), "observations_only")
        .when((F.col("context") == "full") & ~(observed & files), "authority_missing")
        .when(empty("algorithm") | empty("contract_version") | empty("digest"), "content_identity")
    )
    return entries.select("entry_index", why.alias("problem")).filter("problem IS NOT NULL")


def dimension_pairs(entries: DataFrame, facts: DataFrame, by: tuple[str, ...] = ("object_key",)) -> DataFrame:
    """What dimension_changes() takes, for each entry and the next. entries: entry_index, context. facts: entry_index, the
    columns by, dimension, payload_json (canonical). A row for each of those and dimension that either entry states."""
    has = availability(entries).select("entry_index", F.explode(F.array(*(F.struct(F.lit(x).alias("dimension"), F.col(f"has_{x}").alias("available")) for x in AVAILABLE["full"]))).alias("x")).select("entry_index", "x.*")
    at = steps(entries).filter("after_index IS NOT NULL").select(F.col("entry_index").alias("from_index"), F.col("after_index").alias("to_index"))
    key = ["from_index", "to_index", *by, "dimension"]
    base = facts.join(at, facts["entry_index"] == at["from_index"]).select(*key, F.col("payload_json").alias("base_json"))
    cand = facts.join(at, facts["entry_index"] == at["to_index"]).select(*key, F.col("payload_json").alias("cand_json"))
    side = lambda index, name: has.select(F.col("entry_index").alias(index), "dimension", F.col("available").alias(name))
    both = base.join(cand, key, "full").join(side("from_index", "base_available"), ["from_index", "dimension"]).join(side("to_index", "cand_available"), ["to_index", "dimension"])
    return both.select(*key, "base_available", "cand_available", "base_json", "cand_json")


def decisions(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """The decisions of each entry's observations by the rules of that entry, all entries in one pass: both tables have
    entry_index, which is made a part of objects and kinds for as long. They are written, as several dimensions read them."""
    apart = lambda df, *names: df.withColumns({c: F.concat(F.col("entry_index").cast("string"), F.lit("|"), c) for c in names}).drop("entry_index")
    found = conflicts.decide(apart(observations, "object_key", "kind"), apart(rules, "kind"))
    whole = lambda c: F.regexp_replace(c, "^[^|]*[|]", "")
    index = F.substring_index("object_key", "|", 1).cast(observations.schema["entry_index"].dataType)
    return stored(found.withColumn("entry_index", index).withColumns({"object_key": whole("object_key"), "kind": whole("kind")}), "decisions")


#: Reasons of decisions for which authority was asked.
ASKED = ("NO_AUTHORITY_RULE", "INVALID_OR_AMBIGUOUS_AUTHORITY", "AUTHORITATIVE_SOURCE_NOT_OBSERVED", "AUTHORITATIVE_SOURCE_CONFLICTED", "RESOLVED_BY_AUTHORITY")


def dimension_facts(observations: DataFrame, decided: DataFrame) -> DataFrame:
    """What dimension_pairs() takes, by object_key and pointer, from observations and decisions() of entries: who states
    which values, the state of conflict, what authority said, and the effective value, each as canonical JSON.

    A property's values and sources are listed in one row: as many as there are sources that observe it.
    """
    text = lambda c: F.coalesce(canonical.escaped(c), F.lit("null"))
    each = lambda p: F.concat(F.lit('{"observation_mode":'), text(p["observation_mode"]), F.lit(',"provider_type":'), text(p["provider_type"]), F.lit(',"source_ref":'), text(p["source_ref"]), F.lit(',"source_version":'), text(p["source_version"]), F.lit("}"))
    key = ["entry_index", "object_key", "pointer"]
    said = stated(observations).filter("provenance IS NOT NULL").select(*key, "value_json", each(F.col("provenance")).alias("p"))
    groups = said.groupBy(*key, "value_json").agg(F.array_sort(F.collect_set("p")).alias("p"))
    listed = F.array_sort(F.collect_list(F.concat(F.lit('{"provenance":['), F.array_join("p", ","), F.lit('],"value":'), "value_json", F.lit("}"))))
    provenance = groups.groupBy(*key).agg(F.concat(F.lit('{"value_groups":['), F.array_join(listed, ","), F.lit("]}")).alias("payload_json")).withColumn("dimension", F.lit("provenance"))
    conflict = F.concat(F.lit('{"has_result":true,"reason":'), text(F.col("reason")), F.lit(',"state":'), text(F.col("state")), F.lit("}"))
    r = F.col("rule")
    rule = F.when(r.isNull(), F.lit("null")).otherwise(F.concat(F.lit('{"provider_type":'), text(r["provider_type"]), F.lit(',"source_ref":'), text(r["source_ref"]), F.lit("}")))
    authority = F.when(F.col("reason").isin(*ASKED), F.concat(F.lit('{"authority_applicable":true,"has_result":true,"outcome":'), text(F.col("reason")), F.lit(',"winning_rule":'), rule, F.lit("}"))).otherwise(F.lit('{"authority_applicable":false,"has_result":true}'))
    effective = F.when(F.col("has_effective_value"), F.concat(F.lit('{"has_effective_value":true,"has_result":true,"value":'), "effective_json", F.lit("}"))).otherwise(F.lit('{"has_effective_value":false,"has_result":true}'))
    three = F.array(*(F.struct(F.lit(name).alias("dimension"), value.alias("payload_json")) for name, value in (("conflict", conflict), ("authority", authority), ("effective_value", effective))))
    return provenance.unionByName(decided.select(*key, F.explode(three).alias("x")).select(*key, "x.*"))


def dimension_changes(pairs: DataFrame) -> DataFrame:
    """pairs: dimension, base_available, cand_available, base_json, cand_json. A change is told only if both sides are
    there and differ."""
    differ = F.col("base_available") & F.col("cand_available") & F.col("base_json").isNotNull() & F.col("cand_json").isNotNull() & (F.col("base_json") != F.col("cand_json"))
    return pairs.withColumn("changed", differ)


def ever_known(properties: DataFrame) -> DataFrame:
    """Objects that any entry knows, and how many entries do."""
    return properties.groupBy("object_key").agg(F.count_distinct("entry_index").alias("n_entries"))


def append(entries: DataFrame, new: DataFrame) -> DataFrame:
    """The timeline with one more entry (same columns, without entry_index); one equal to the last is refused."""
    last = entries.agg(F.max_by("state_digest", "entry_index").alias("digest"), F.coalesce(F.max("entry_index"), F.lit(-1)).alias("at")).first()
    rows = new.select("state_digest").take(2)
    if len(rows) != 1:
        raise ValueError("append takes one entry")
    if rows[0]["state_digest"] == last["digest"]:
        raise ValueError("the new entry has the state of the last one")
    return entries.unionByName(new.withColumn("entry_index", F.lit(last["at"] + 1)), allowMissingColumns=True)
