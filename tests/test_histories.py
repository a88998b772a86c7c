"""Stored histories: verified entries, links, forks; and identities that follow changes."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from metaloom import catalog_histories
from metaloom.functions import canonical
from metaloom.operators import history
from metaloom.sinks import artifacts, histories

OBSERVED = histories.SCHEMAS["observations"]


def entries(spark, *rows):
    return spark.createDataFrame(rows, "entry_index int, context string")


def snapshots(spark, *rows):
    return spark.createDataFrame(rows, "object_key string, pointer string, value_json string, entry_index int")


def said(key, value, provider, ref, entry):
    return key, "ns", "table", "/name", value, [(provider, ref, None, "observed")], entry


def full_history(spark, folder):
    rules = spark.createDataFrame([("table", "/name", None, "dbt", None, 0), ("table", "/name", None, "odcs", None, 1)], histories.SCHEMAS["rules"])
    observed = spark.createDataFrame([said("a|b", '"x"', "dbt", "s", 0), said("a|b", '"y"', "odcs", "s", 0), said("a|b", '"x"', "dbt", "s", 1), said("a|b", '"y"', "odcs", "s", 1), said("c", '"z"', "dbt", "s", 0), said("c", '"z"', "dbt", "s", 1)], OBSERVED)
    histories.append(folder, entries(spark, (0, "full"), (1, "full"), (2, "none")), {"snapshot": snapshots(spark, ("a|b", "/name", '"x"', 0), ("a|b", "/name", '"y"', 1)), "observations": observed, "rules": rules})


def test_entries_of_a_history_and_their_dimensions(spark, tmp_path):
    folder = str(tmp_path / "h")
    full_history(spark, folder)
    h = histories.read(spark, folder)
    links = {r["entry_index"]: (r["follows"], r["link"]) for r in h.entries.collect()}
    assert links[0][0] is None and links[1][0] == links[0][1] and links[2][0] == links[1][1]
    facts = history.dimension_facts(h.observations, history.decisions(h.observations, h.rules))
    changed = history.dimension_changes(history.dimension_pairs(h.entries, facts, ("object_key", "pointer"))).filter("changed").collect()
    assert {(r["object_key"], r["dimension"]) for r in changed} == {("a|b", "authority"), ("a|b", "effective_value")}
    values = {r["dimension"]: (json.loads(r["base_json"]), json.loads(r["cand_json"])) for r in changed}
    assert [v["value"] for v in values["effective_value"]] == ["x", "y"]
    assert [v["winning_rule"]["provider_type"] for v in values["authority"]] == ["dbt", "odcs"]
    groups = [json.loads(r["payload_json"]) for r in facts.filter("dimension = 'provenance' AND entry_index = 0 AND object_key = 'a|b'").collect()]
    assert groups == [{"value_groups": [{"provenance": [{"observation_mode": "observed", "provider_type": p, "source_ref": "s", "source_version": None}], "value": v} for p, v in (("dbt", "x"), ("odcs", "y"))]}]


def test_damaged_histories(spark, tmp_path):
    folder = str(tmp_path / "h")
    full_history(spark, folder)
    snapshots(spark, ("new", "/name", "1", 1), ("new", "/name", "1", 7)).withColumn("entry", F.col("entry_index")).write.mode("append").partitionBy("entry").parquet(f"{folder}/snapshot")
    found = {(r["entry_index"], r["table"]): r["problem"] for r in histories.problems(spark, folder).collect()}
    assert found == {(1, "snapshot"): "content differs from its identity", (7, "snapshot"): "rows of no entry"}
    with pytest.raises(histories.HistoryError, match="entry 1 snapshot"):
        histories.read(spark, folder)
    index = spark.read.schema(histories.INDEX).parquet(f"{folder}/index").withColumn("link", F.when(F.col("entry_index") == 1, F.lit("00")).otherwise(F.col("link"))).collect()
    other = str(tmp_path / "o")
    full_history(spark, other)
    spark.createDataFrame(index, histories.INDEX).write.mode("overwrite").parquet(f"{other}/index")
    assert {(r["entry_index"], r["problem"]) for r in histories.problems(spark, other).collect()} == {(1, "its link is not that of its tables"), (2, "it follows no entry")}


def test_appending(spark, tmp_path):
    folder = str(tmp_path / "h")
    full_history(spark, folder)
    last = histories.last_link(spark, folder)
    one = {"snapshot": snapshots(spark, ("a", "/name", "1", 3))}
    histories.append(folder, entries(spark, (3, "none")), one, follows=last)
    assert histories.read(spark, folder).entries.count() == 4
    with pytest.raises(histories.HistoryError, match="since"):
        histories.append(folder, entries(spark, (4, "none")), one, follows=last)
    with pytest.raises(histories.HistoryError, match="context has none"):
        histories.append(folder, entries(spark, (5, "none")), {"rules": spark.createDataFrame([("table", "/name", None, "dbt", None, 5)], histories.SCHEMAS["rules"])}, follows=histories.last_link(spark, folder))
    with pytest.raises(histories.HistoryError, match="unknown context"):
        histories.append(str(tmp_path / "n"), entries(spark, (0, "some")), {})
    # Two writers that both saw the same last entry: the fork is told.
    index = spark.read.schema(histories.INDEX).parquet(f"{folder}/index").filter("entry_index = 3")
    index.withColumn("entry_index", F.lit(9).cast("bigint")).withColumn("n_rows", F.lit(0).cast("bigint")).write.mode("append").parquet(f"{folder}/index")
    assert (9, "two entries follow the same one") in {(r["entry_index"], r["problem"]) for r in histories.problems(spark, folder).collect()}


def test_identity_after_a_change(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("g"), F.col("id"), F.when(F.col("id") % 5 != 0, F.col("id").cast("string")).alias("name"))
    came, went = df.filter("id % 7 = 0").withColumn("name", F.lit("new")), df.filter("id % 7 = 0 OR g = 2")
    after = df.join(went.select("id"), "id", "left_anti").select(*df.columns).unionByName(came.filter("g != 2")).unionByName(came.filter("g = 2"))
    for by in ((), ("g",)):
        sums = lambda rows: artifacts.row_sums(rows, "snapshot", *by)  # noqa: E731, B023
        columns = [c for c in df.columns if c not in by]
        moved = artifacts.changed_sums(sums(df), sums(came), sums(went), *by).select(*by, "n_rows", artifacts.sums_digest("snapshot", columns).alias("digest"))
        assert sorted(map(tuple, moved.collect())) == sorted(map(tuple, artifacts.identity(after, "snapshot", *by).collect()))


def test_word_sums_are_whole_numbers_until_they_are_told(spark):
    rows = [(i, f"v{i}\\\x1f{i}\\" if i % 3 else None) for i in range(300)]
    sums = artifacts.row_sums(spark.createDataFrame(rows, "k bigint, v string"), "snapshot")
    escaped = lambda v: v.replace("\\", "\\\\").replace("\x1f", "\\\x1f")
    texts = ["=" + str(k) + "\x1f" + ("-" if v is None else "=" + escaped(v)) for k, v in rows]
    hashes = [hashlib.sha256((canonical.PREFIXES["snapshot"] + x).encode()).hexdigest() for x in texts]
    assert tuple(sums.first()) == (300, *(sum(int(h[8 * i : 8 * i + 8], 16) for h in hashes) for i in range(8)))
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("conv(") == 4 and "sum(cast" not in plan  # before: a decimal for each word of each row


def test_a_stored_history_groups_its_events_once(spark, monkeypatch):
    grouped, plain = [], catalog_histories.histories.append

    def append(folder, entries, tables, **more):
        grouped.append("Aggregate" in tables["snapshot"]._jdf.queryExecution().optimizedPlan().toString())
        plain(folder, entries, tables, **more)

    monkeypatch.setattr(catalog_histories.histories, "append", append)
    folder = catalog_histories._stored(spark, "/root/testdata/sf0.001")
    assert grouped == [False]  # before, the check of entries and the rows grouped them anew
    assert histories.read(spark, folder).snapshot.count() > 0
