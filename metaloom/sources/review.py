"""Review results: what a review of conflicts and drift found, read as rows, with every fault of a document as a row.

A review has two lanes. The lane of conflicts lists a result for each property, an assessment for each result (by
position) and sums; the lane of drift has sums alone. A lane that did not run is empty. Documents are parsed once; what a
document says about itself (status, sums, identities) is held against what its rows say.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import FAULT, Rule, flatten, get, last_token, text
from ..shared import stored
from .base import MappingError, whole_texts

# Names and versions of the documents that are read, and of content identities.
SCHEMA, VERSION = "governance-ci-review-result", "1"
REPORT_SCHEMA, REPORT_VERSION = "governance-property-conflicts", "1"
ALGORITHM, HASHING = "sha256", "1"

#: States of a property and the name of the sum of each.
STATES = {"SINGLE_OBSERVATION": "single_observation", "AGREEMENT": "agreement", "RESOLVED_BY_AUTHORITY": "resolved_by_authority", "UNRESOLVED_CONFLICT": "unresolved_conflict", "INVALID_OR_AMBIGUOUS_AUTHORITY": "invalid_or_ambiguous_authority"}
SAFETY = ("reconciliation_safe", "reconciliation_blocked", "reconciliation_not_applicable")
DRIFT_SUMS = ("affected_objects", "expected_differences", "property_drift", "unexpected_drift")
CONFLICT_IDENTITIES = ("observations_content_identity", "authority_content_identity", "conflict_report_content_identity")
DRIFT_IDENTITIES = ("baseline_snapshot_identity", "candidate_snapshot_identity", "comparison_content_identity", "drift_result_content_identity")

RULES = {
    "review": Rule(rows={"conflicts": "conflicts", "drift": "drift"}, open=("content_identity",), digest=("ci_review", "content_identity")),
    "conflicts": Rule(rows={"conflict_report": "report", "reconciliation_assessments/*": "assessment"}, open=("summary", "conflict_report_content_identity")),
    "report": Rule(rows={"results/*": "result"}, digest=("property_conflicts", None)),
    "result": Rule(tell=("object", "property", "state")),
    "assessment": Rule(tell=("object", "property", "applicable", "safe", "reason")),
    "drift": Rule(open=("summary",)),
}
HEADS = ("review", "conflicts", "report", "drift")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return whole_texts(spark, path, ".json")


def _is(json: Column, value: str) -> Column:
    return F.coalesce(text(json) == value, F.lit(False))


def _null(json: Column) -> Column:
    """Whether a member is missing or null."""
    return F.coalesce(json, F.lit("null")) == "null"


def _object(json: Column) -> Column:
    return F.coalesce(json.startswith("{"), F.lit(False))


def _count(json: Column) -> Column:
    """The whole number that a text is and that no sum may lie below; null for everything else."""
    return F.when(json.rlike("^[0-9]{1,18}$"), json.cast("bigint"))


def _no_identity(m: Column, name: str, digest: Column) -> Column:
    """Whether the opened member of that name is not the content identity with this digest."""
    stated = lambda part, value: F.coalesce(text(get(m, f"{name}/{part}")) == value, F.lit(False))
    return ~(stated("algorithm", F.lit(ALGORITHM)) & stated("hashing_contract_version", F.lit(HASHING)) & stated("digest", digest))


class Reviews:
    """Review documents (column text) as rows; parts are made when first asked for. Equal documents are one."""

    def __init__(self, documents: DataFrame):
        self.documents = documents

    @cached_property
    def rows(self) -> DataFrame:
        return stored(flatten(self.documents, "text", RULES, "review", distinct=True, faults=True), "reviews", "rule")

    @cached_property
    def properties(self) -> DataFrame:
        """doc, position, object, property, state, applicable, safe, reason, and the members of both sides: a result and
        the assessment at its position."""
        side = lambda rule, name: self.rows.filter(F.col("rule") == rule).select("doc", last_token().cast("bigint").alias("position"), F.col("m").alias(name))
        both = side("result", "r").join(side("assessment", "a"), ["doc", "position"], "full")
        r, a = F.col("r"), F.col("a")
        true = lambda name: F.coalesce(get(a, name) == "true", F.lit(False)).alias(name)
        return both.select("doc", "position", get(r, "object").alias("object"), text(get(r, "property")).alias("property"), text(get(r, "state")).alias("state"), true("applicable"), true("safe"), text(get(a, "reason")).alias("reason"), "r", "a")

    @cached_property
    def reviews(self) -> DataFrame:
        """A row for each document: doc, status, conflict_status, drift_status; the members of its parts (review,
        conflicts, report, drift); counted, a map of the sums that its rows give; n_results, n_assessments."""
        rows = self.rows.filter(F.col("rule").isin(*HEADS))
        part = lambda name: F.first(F.when(F.col("rule") == name, F.col("m")), ignorenulls=True).alias(name)
        heads = rows.groupBy("doc").agg(*(part(name) for name in HEADS))
        p = self.properties
        many = {name: F.count_if(F.col("state") == state) for state, name in STATES.items()}
        there, safe = F.col("a").isNotNull(), F.col("safe")
        many |= dict(zip(SAFETY, (F.count_if(there & F.col("applicable") & safe), F.count_if(there & F.col("applicable") & ~safe), F.count_if(there & ~F.col("applicable"))), strict=True))
        many["properties_analyzed"] = F.count("r")
        sums = p.groupBy("doc").agg(F.count("r").alias("n_results"), F.count("a").alias("n_assessments"), F.create_map(*(x for k, v in many.items() for x in (F.lit(k), v))).alias("counted"))
        none = F.create_map(*(x for k in many for x in (F.lit(k), F.lit(0).cast("bigint"))))
        zero = F.lit(0).cast("bigint")
        out = heads.join(sums, "doc", "left").withColumns({"n_results": F.coalesce("n_results", zero), "n_assessments": F.coalesce("n_assessments", zero), "counted": F.coalesce("counted", none)})
        status = lambda name: text(get(F.col(name), "status"))
        return stored(out.withColumns({"status": status("review"), "conflict_status": status("conflicts"), "drift_status": status("drift")}), "review-heads")

    def problems(self) -> DataFrame:
        """What is wrong: doc, path (a pointer into the document), problem. A document without one can be trusted."""
        v, c, p, d = (F.col(name) for name in HEADS)
        found: list[tuple[Column | str, str | Column, Column]] = []

        def say(path: str, problem: str, when: Column) -> None:
            found.append((F.lit(path), F.lit(problem), F.coalesce(when, F.lit(False))))

        say("/review_schema", "unsupported schema", ~_is(get(v, "review_schema"), SCHEMA))
        say("/review_version", "unsupported version", ~_is(get(v, "review_version"), VERSION))
        say("/content_identity", "is no identity", ~_object(get(v, "content_identity")))
        say("/content_identity", "content differs from its identity", _object(get(v, "content_identity")) & _no_identity(v, "content_identity", get(v, "/digest")))
        blocked = (F.coalesce(F.col("conflict_status"), F.lit("")) == "blocked") | (F.coalesce(F.col("drift_status"), F.lit("")) == "unexpected_drift")
        say("/status", "is not that of the lanes", F.coalesce(F.col("status") != F.when(blocked, "blocked").otherwise("passed"), F.lit(True)))
        say("/writes_performed", "must be 0", F.coalesce(get(v, "writes_performed") != "0", F.lit(True)))
        self._conflicts(say, c, p)
        self._drift(say, d)
        every = F.array(*(F.when(when, F.struct(path.alias("path"), problem.alias("problem"))) for path, problem, when in found))
        told = self.reviews.select("doc", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("x")).select("doc", "x.*")
        unread = self.rows.filter(F.col("rule") == FAULT).select("doc", F.lit("/").alias("path"), text(get(F.col("m"), "")).alias("problem"))
        return reduce(DataFrame.unionByName, (told, self._unlike(), unread))

    def _conflicts(self, say, c: Column, p: Column) -> None:
        """The lane of conflicts as a whole."""
        idle = F.coalesce(F.col("conflict_status") == "not_run", F.lit(False))
        sums = (*STATES.values(), *SAFETY, "properties_analyzed")
        say("/conflicts", "is no object", ~_object(get(F.col("review"), "conflicts")))
        say("/conflicts", "a lane that did not run must be empty", idle & (~_null(get(c, "conflict_report")) | (F.col("n_assessments") > 0)))
        for name in CONFLICT_IDENTITIES:
            say(f"/conflicts/{name}", "a lane that did not run has no identities", idle & ~_null(get(c, name)))
            say(f"/conflicts/{name}", "is no identity", ~idle & ~_object(get(c, name)))
        some = reduce(lambda a, b: a | b, (F.coalesce(_count(get(c, f"summary/{name}")) != 0, F.lit(False)) for name in sums))
        say("/conflicts/summary", "a lane that did not run has sums of 0", idle & some)
        say("/conflicts/conflict_report", "is no object", ~idle & ~_object(get(c, "conflict_report")))
        ran = ~idle & _object(get(c, "conflict_report"))
        say("/conflicts/conflict_report/conflict_schema", "unsupported schema", ran & ~_is(get(p, "conflict_schema"), REPORT_SCHEMA))
        say("/conflicts/conflict_report/conflict_version", "unsupported version", ran & ~_is(get(p, "conflict_version"), REPORT_VERSION))
        say("/conflicts/conflict_report/results", "is no list", ran & F.coalesce(get(p, "results") != "[]", F.lit(True)))
        say("/conflicts/reconciliation_assessments", "is no list", ran & F.coalesce(get(c, "reconciliation_assessments") != "[]", F.lit(True)))
        say("/conflicts/reconciliation_assessments", "there must be one for each result", ran & (F.col("n_results") != F.col("n_assessments")))
        say("/conflicts/conflict_report_content_identity", "content differs from its identity", ran & _object(get(c, "conflict_report_content_identity")) & _no_identity(c, "conflict_report_content_identity", get(p, "/digest")))
        say("/conflicts/summary", "is no object", ran & ~_object(get(c, "summary")))
        for name in sums:
            wrong = F.coalesce(_count(get(c, f"summary/{name}")) != get(F.col("counted"), name), F.lit(True))
            say(f"/conflicts/summary/{name}", "is not the sum of the results", ran & _object(get(c, "summary")) & wrong)
        many = lambda name: get(F.col("counted"), name)
        due = F.when(many("reconciliation_blocked") > 0, "blocked").when(many("unresolved_conflict") + many("invalid_or_ambiguous_authority") > 0, "findings").otherwise("clear")
        say("/conflicts/status", "is not that of the results", ran & F.coalesce(F.col("conflict_status") != due, F.lit(True)))

    def _drift(self, say, d: Column) -> None:
        """The lane of drift."""
        status, policy = F.col("drift_status"), get(d, "drift_policy_identity")
        idle = F.coalesce(status == "not_run", F.lit(False))
        say("/drift", "is no object", ~_object(get(F.col("review"), "drift")))
        say("/drift/summary", "a lane that did not run has no sums", idle & ~_null(get(d, "summary")))
        for name in (*DRIFT_IDENTITIES, "drift_policy_identity"):
            say(f"/drift/{name}", "a lane that did not run has no identities", idle & ~_null(get(d, name)))
        for name in DRIFT_IDENTITIES:
            say(f"/drift/{name}", "is no identity", ~idle & ~_object(get(d, name)))
        known = status.isin("no_difference", "expected_difference", "unexpected_drift")
        say("/drift/status", "unknown status", ~idle & ~F.coalesce(known, F.lit(False)))
        say("/drift/drift_policy_identity", "differences need a policy", status.isin("expected_difference", "unexpected_drift") & ~_object(policy))
        say("/drift/drift_policy_identity", "is no identity", (status == "no_difference") & ~_null(policy) & ~_object(policy))
        n = {name: _count(get(d, f"summary/{name}")) for name in DRIFT_SUMS}
        whole = reduce(lambda a, b: a & b, (x.isNotNull() for x in n.values()))
        say("/drift/summary", "sums must be whole numbers from 0", ~idle & ~whole)
        some = reduce(lambda a, b: a | b, (x != 0 for x in n.values()))
        say("/drift/summary", "no difference has sums of 0", (status == "no_difference") & whole & some)
        say("/drift/summary", "an expected difference has some expected and none unexpected", (status == "expected_difference") & whole & ((n["expected_differences"] == 0) | (n["unexpected_drift"] != 0)))
        say("/drift/summary/unexpected_drift", "unexpected drift has some", (status == "unexpected_drift") & whole & (n["unexpected_drift"] == 0))

    def _unlike(self) -> DataFrame:
        """Results and assessments that do not belong together, or cannot be read."""
        r, a = F.col("r"), F.col("a")
        both = r.isNotNull() & a.isNotNull()
        at = lambda place, name="": F.concat(F.lit(f"/conflicts/{place}/"), F.col("position").cast("string"), F.lit(name))
        differs = lambda name: both & ~get(r, name).eqNullSafe(get(a, name))
        flag = lambda name: a.isNotNull() & ~F.coalesce(get(a, name).isin("true", "false"), F.lit(False))
        own = "reconciliation_assessments"
        found = [
            (at(own, "/object"), "is not that of its result", differs("object")),
            (at(own, "/property"), "is not that of its result", differs("property")),
            (at(own, "/applicable"), "must be true or false", flag("applicable")),
            (at(own, "/safe"), "must be true or false", flag("safe")),
            (at("conflict_report/results", "/state"), "unknown state", r.isNotNull() & ~F.coalesce(F.col("state").isin(*STATES), F.lit(False))),
        ]
        every = F.array(*(F.when(when, F.struct(path.alias("path"), F.lit(problem).alias("problem"))) for path, problem, when in found))
        return self.properties.select("doc", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("x")).select("doc", "x.*")


def load(spark: SparkSession, path: str) -> Reviews:
    """The reviews of a folder; one that has a problem is an error that names the first of them."""
    out = Reviews(read_reviews(spark, path))
    if found := out.problems().orderBy("doc", "path", "problem").take(5):
        raise MappingError("; ".join(f"{r['path']}: {r['problem']}" for r in found))
    return out
