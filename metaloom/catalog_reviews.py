"""Registered queries over review results, what comparisons say of their sides, and identities of a run's steps, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import projections as P
from .catalog import Query
from .functions.canonical import digest
from .operators import compare, reconcile
from .sources import review

STATES = list(review.STATES)


def _made(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _identity(hex_digest: Column) -> Column:
    return _made('{"algorithm":"sha256","digest":"', hex_digest, '","hashing_contract_version":"1"}')


def reviews(spark, d) -> DataFrame:
    """A review for each customer that has orders, which are its properties. Planted faults: a sum (13), a status (17), an
    identity (19), assessments of another property (23), an identity in a lane that did not run (14), drift where there
    is none (29) and drift without a policy (31), each in the customers that the number divides."""
    o, k, key = P.table(spark, d, "orders"), F.col("o_custkey"), F.col("o_orderkey")
    n = (key % 5).cast("int")
    state = F.array(*map(F.lit, STATES))[n]
    applicable, safe = key % 3 != 0, (key % 3 != 0) & (n < 3)
    result = _made('{"object":"o:', key, '","property":"/status","state":"', state, '"}')
    shown = F.when((k % 23 == 0) & (key % 2 == 0), "/other").otherwise("/status")
    flag = lambda c: F.when(c, "true").otherwise("false")
    assessment = _made('{"applicable":', flag(applicable), ',"object":"o:', key, '","property":"', shown, '","reason":"x","safe":', flag(safe), "}")
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("at"), c.alias("x")))), lambda x: x["x"]), ",")
    sums = {name: F.count_if(state == s) for s, name in review.STATES.items()}
    sums |= {"reconciliation_safe": F.count_if(safe), "reconciliation_blocked": F.count_if(applicable & ~safe), "reconciliation_not_applicable": F.count_if(~applicable), "properties_analyzed": F.count(F.lit(1))}
    one = o.groupBy(k.alias("k")).agg(listed(result).alias("results"), listed(assessment).alias("assessments"), *(v.alias(name) for name, v in sums.items()))
    k = F.col("k")
    idle = k % 7 == 0
    shown_sum = lambda name: F.when(idle, 0).otherwise(F.col(name) + (F.when(k % 13 == 0, 1).otherwise(0) if name == "agreement" else 0))
    summary = _made("{", *(x for i, name in enumerate(sorted(sums)) for x in ("," if i else "", f'"{name}":', shown_sum(name))), "}")
    report = _made('{"conflict_schema":"governance-property-conflicts","conflict_version":"1","results":[', F.col("results"), "]}")
    conflict_status = F.when(idle, "not_run").when(F.col("reconciliation_blocked") > 0, "blocked").when(F.col("unresolved_conflict") + F.col("invalid_or_ambiguous_authority") > 0, "findings").otherwise("clear")
    some = _identity(F.sha2(k.cast("string"), 256))
    unless = lambda c: F.when(idle, "null").otherwise(c)
    conflicts = _made(
        '{"authority_content_identity":', F.when(k % 14 == 0, some).otherwise(unless(some)), ',"conflict_report":', unless(report),
        ',"conflict_report_content_identity":', unless(_identity(digest("property_conflicts", report))), ',"observations_content_identity":', unless(some),
        ',"reconciliation_assessments":[', F.when(idle, "").otherwise(F.col("assessments")), '],"status":"', conflict_status, '","summary":', summary, "}",
    )
    kind = k % 4
    drift_status = F.when(kind == 0, "not_run").when(kind == 1, "no_difference").when(kind == 2, "expected_difference").otherwise("unexpected_drift")
    ran = lambda c: F.when(kind == 0, "null").otherwise(c)
    policy = F.when((kind < 2) | (k % 31 == 0), "null").otherwise(some)
    counts = _made('{"affected_objects":', F.when((kind > 1) | (k % 29 == 0), 1).otherwise(0), ',"expected_differences":', F.when(kind == 2, 2).otherwise(0), ',"property_drift":0,"unexpected_drift":', F.when(kind == 3, 1).otherwise(0), "}")
    drift = _made('{"baseline_snapshot_identity":', ran(some), ',"candidate_snapshot_identity":', ran(some), ',"comparison_content_identity":', ran(some), ',"drift_policy_identity":', policy, ',"drift_result_content_identity":', ran(some), ',"status":"', drift_status, '","summary":', ran(counts), "}")
    blocked = (conflict_status == "blocked") | (drift_status == "unexpected_drift")
    status = F.when(blocked == (k % 17 != 0), "blocked").otherwise("passed")
    tail = _made(',"drift":', drift, ',"review_schema":"governance-ci-review-result","review_version":"1","status":"', status, '","writes_performed":0}')
    own = digest("ci_review", _made('{"conflicts":', conflicts, tail))
    own = F.when(k % 19 == 0, F.reverse(own)).otherwise(own)
    return one.select(_made('{"conflicts":', conflicts, ',"content_identity":', _identity(own), tail).alias("text"))


def review_problems(spark, d):
    """The faults by what they are and where in a review they stand."""
    found = review.Reviews(reviews(spark, d)).problems()
    return found.groupBy(F.regexp_replace("path", "/[0-9]+(?=/|$)", "/*").alias("place"), "problem").agg(F.count(F.lit(1)).alias("n_problems"))


def review_lanes(spark, d):
    """How reviews ended, and how many properties the results of each kind of end have."""
    rows = review.Reviews(reviews(spark, d)).reviews
    return rows.groupBy("status", "conflict_status", "drift_status").agg(F.count(F.lit(1)).alias("n_reviews"), F.sum("n_results").alias("n_results"), F.sum(F.col("counted")["reconciliation_blocked"]).alias("n_blocked"))


def review_properties(spark, d):
    """What reviews say of each property that their lanes of conflicts list."""
    return review.Reviews(reviews(spark, d)).properties.select(F.col("object").alias("object_json"), "property", "state", "applicable", "safe")


def compare_metadata_problems(spark, d):
    """Suppliers as comparisons of their nation with another: what they say of their two sides, of which some is wrong."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    s = P.table(spark, d, "supplier")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    side = lambda source, database, scanner, version: F.struct(F.lit("postgres").alias("system_type"), scanner.alias("scanner"), version.alias("scanner_contract_version"), source.alias("source"), database.alias("database"))
    base = side(name("s/", n), name("d", n), F.lit("a"), F.lit("1"))
    cand = side(name("s/", n + k % 2), name("d", n + k % 3), F.when(k % 11 == 0, "b").otherwise("a"), F.when(k % 13 == 0, "2").otherwise("1"))
    both = lambda a, b: F.struct(a.alias("baseline"), b.alias("candidate"))
    source = F.when((k % 2 == 1) & (k % 5 != 0), both(name("s/", n), name("s/", n + 1))).when(k % 10 == 0, both(F.lit("x"), F.lit("x")))
    database = F.when(k % 3 != 0, both(name("d", n), name("d", n + k % 3 + F.when(k % 7 == 0, 1).otherwise(0))))
    comparisons = s.select(k.alias("comparison"), base.alias("baseline"), cand.alias("candidate"), source.alias("aligned_source"), database.alias("aligned_database"))
    quoted = lambda prefix, c: F.concat(F.lit('"'), name(prefix, c), F.lit('"'))
    sides = lambda kind, a, b: s.select(k.alias("comparison"), F.lit(kind).alias("kind"), F.lit(True).alias("base_has"), a.alias("base_json"), F.lit(True).alias("cand_has"), b.alias("cand_json"))
    renamed = sides("data_source", quoted("s/", n), quoted("s/", n + 1)).filter((F.col("comparison") % 2 == 1) | (F.col("comparison") % 8 == 0))
    others = sides("database", quoted("d", n), F.when(k % 17 == 0, "null").otherwise(quoted("d", n + k % 3))).filter((F.col("comparison") % 3 != 0) & (F.col("comparison") % 19 != 0))
    return compare.metadata_problems(comparisons, renamed.unionByName(others))


def step_disagreements(spark, d):
    """Orders as runs: steps state the customer, date and priority; some plans state another date, some steps nothing."""
    o = P.table(spark, d, "orders")
    k = F.col("o_orderkey")
    of = lambda step, name, value: F.struct(F.lit(step).alias("step"), F.lit(name).alias("name"), value.cast("string").alias("digest"))
    date = F.when(k % 9 == 0, F.date_add("o_orderdate", 1)).otherwise(F.col("o_orderdate").cast("date"))
    told = F.array(
        of("config", "config", F.when(k % 10 != 0, F.col("o_custkey"))), of("plan", "config", F.col("o_custkey")),
        of("policy", "policy", F.col("o_orderdate").cast("date")), of("plan", "policy", date),
        of("policy", "snapshot", F.col("o_orderpriority")), of("plan", "snapshot", F.when(k % 11 != 0, F.col("o_orderpriority"))),
    )
    stated = o.select(k.alias("run"), F.explode(told).alias("x")).select("run", "x.*").filter("digest IS NOT NULL")
    return reconcile.disagreements(stated)


QUERIES: dict[str, Query] = {f.__name__: f for f in (review_problems, review_lanes, review_properties, compare_metadata_problems, step_disagreements)}

_REVIEWS = """o AS (SELECT o_custkey AS k, o_orderkey AS x, o_orderkey % 5 AS n, o_orderkey % 3 <> 0 AS applicable, o_orderkey % 3 <> 0 AND o_orderkey % 5 < 3 AS safe FROM orders),
r AS (SELECT k, k % 7 = 0 AS idle, k % 4 AS kind, count(*) AS many, count(*) FILTER (WHERE applicable AND NOT safe) AS blocked, count(*) FILTER (WHERE n > 2) AS bad, count(*) FILTER (WHERE k % 23 = 0 AND x % 2 = 0) AS other FROM o GROUP BY ALL),
l AS (SELECT *, CASE WHEN idle THEN 'not_run' WHEN blocked > 0 THEN 'blocked' WHEN bad > 0 THEN 'findings' ELSE 'clear' END AS cs, CASE kind WHEN 0 THEN 'not_run' WHEN 1 THEN 'no_difference' WHEN 2 THEN 'expected_difference' ELSE 'unexpected_drift' END AS ds FROM r),
v AS (SELECT *, CASE WHEN (cs = 'blocked' OR kind = 3) = (k % 17 <> 0) THEN 'blocked' ELSE 'passed' END AS status FROM l)"""

SQL = {
    "review_problems": f"""WITH {_REVIEWS}, p AS (
        SELECT '/conflicts/summary/agreement' AS place, 'is not the sum of the results' AS problem, count(*) AS n_problems FROM v WHERE NOT idle AND k % 13 = 0
        UNION ALL SELECT '/status', 'is not that of the lanes', count(*) FROM v WHERE k % 17 = 0
        UNION ALL SELECT '/content_identity', 'content differs from its identity', count(*) FROM v WHERE k % 19 = 0
        UNION ALL SELECT '/conflicts/reconciliation_assessments/*/property', 'is not that of its result', coalesce(sum(other), 0) FROM v WHERE NOT idle
        UNION ALL SELECT '/conflicts/authority_content_identity', 'a lane that did not run has no identities', count(*) FROM v WHERE k % 14 = 0
        UNION ALL SELECT '/drift/summary', 'no difference has sums of 0', count(*) FROM v WHERE kind = 1 AND k % 29 = 0
        UNION ALL SELECT '/drift/drift_policy_identity', 'differences need a policy', count(*) FROM v WHERE kind > 1 AND k % 31 = 0)
        SELECT place, problem, CAST(n_problems AS BIGINT) AS n_problems FROM p WHERE n_problems > 0""",
    "review_lanes": f"WITH {_REVIEWS} SELECT status, cs AS conflict_status, ds AS drift_status, count(*) AS n_reviews, CAST(sum(CASE WHEN idle THEN 0 ELSE many END) AS BIGINT) AS n_results, CAST(sum(CASE WHEN idle THEN 0 ELSE blocked END) AS BIGINT) AS n_blocked FROM v GROUP BY ALL",
    "review_properties": f"""WITH {_REVIEWS} SELECT '"o:' || x || '"' AS object_json, '/status' AS property, ['SINGLE_OBSERVATION', 'AGREEMENT', 'RESOLVED_BY_AUTHORITY', 'UNRESOLVED_CONFLICT', 'INVALID_OR_AMBIGUOUS_AUTHORITY'][n + 1] AS state, applicable, safe FROM o WHERE k % 7 <> 0""",
    "compare_metadata_problems": """WITH s AS (SELECT s_suppkey AS k FROM supplier)
        SELECT k AS comparison, '/candidate/scanner' AS path, 'must be that of the baseline' AS problem FROM s WHERE k % 11 = 0
        UNION ALL SELECT k, '/candidate/scanner_contract_version', 'unsupported version' FROM s WHERE k % 13 = 0
        UNION ALL SELECT k, '/root_alignment/source', 'must be null where names are equal' FROM s WHERE k % 10 = 0
        UNION ALL SELECT k, '/root_alignment/source', 'is not what the sides say' FROM s WHERE k % 2 = 1 AND k % 5 = 0
        UNION ALL SELECT k, '/root_alignment/database', 'is not what the sides say' FROM s WHERE k % 3 <> 0 AND k % 7 = 0
        UNION ALL SELECT k, '/object_changes', 'a change of the data_source''s name where names are equal' FROM s WHERE k % 8 = 0
        UNION ALL SELECT k, '/object_changes', 'no change of the database''s name' FROM s WHERE k % 3 <> 0 AND k % 19 = 0
        UNION ALL SELECT k, '/object_changes', 'the change of the database''s name is not what the sides say' FROM s WHERE k % 3 <> 0 AND k % 19 <> 0 AND k % 17 = 0""",
    "step_disagreements": """SELECT o_orderkey AS run, 'config' AS name, CAST(NULL AS VARCHAR) AS first_digest, CAST(o_custkey AS VARCHAR) AS second_digest FROM orders WHERE o_orderkey % 10 = 0
        UNION ALL SELECT o_orderkey, 'policy', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), CAST(CAST(o_orderdate AS DATE) + 1 AS VARCHAR) FROM orders WHERE o_orderkey % 9 = 0
        UNION ALL SELECT o_orderkey, 'snapshot', o_orderpriority, NULL FROM orders WHERE o_orderkey % 11 = 0""",
}
