"""Pseudonyms: validity, linkage, the way back, and what is left alone."""

import datetime
import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from metaloom.llm import pii

VALUES = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"],
    "ip": ["10.0.0.1", "255.255.255.255", "0.0.0.0", "192.168.17.4"],
    "date": ["2024-02-29", "31.12.1999", "12/31/1999", "31/12/1999", "2001/03/04"],
    "ssn": ["123-45-6789", "665-01-0001", "667-99-9999", "899-99-9999"],
    "phone": ["+1 (555) 010-9999", "(212) 555-0100", "212-555-0100", "+49 30 1234567", "212.555.0100"],
}
LEFT = ["4111111111111112", "256.1.1.1", "1.2.3.4.5", "2023-02-29", "32.01.2020", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "12345", "3.14159", "v1.2.3", "x" * 30, "7 of 9", "1,000,000"]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def shape(text):
    return re.sub("[0-9]", "9", text)


def run(spark, texts, key="a key of the tests", **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [(r["text"], r["found"]) for r in pii.pseudonymise(rows, key=key, **options).orderBy("doc_id").collect()]


@pytest.mark.parametrize("kind", sorted(VALUES))
def test_values_keep_their_format_and_come_back(spark, kind):
    texts = [f"Write to {v}, or not. Again: {v}" for v in VALUES[kind]]
    made = run(spark, texts)
    for v, text, (new, found) in zip(VALUES[kind], texts, made, strict=True):
        assert found == [kind] * 2 and new != text
        assert shape(new) == shape(text) or (kind == "ip" and re.sub("[0-9]+", "9", new) == re.sub("[0-9]+", "9", text))
        one, two = new.removeprefix("Write to ").split(", or not. Again: ")
        assert one == two != v
        if kind == "card":
            assert luhn(re.sub("[^0-9]", "", one))
        if kind == "ip":
            assert all(int(x) < 256 for x in one.split("."))
        if kind == "date":
            parts = [int(x) for x in re.split("[-/.]", one)]
            y, m, d = parts if parts[0] > 31 else (parts[2], parts[1], parts[0]) if "/" not in one or parts[0] > 12 else (parts[2], parts[0], parts[1])
            datetime.date(y, m, d)
        if kind == "ssn":
            a, b, c = one.split("-")
            assert 0 < int(a) < 900 and a != "666" and int(b) and int(c)
        if kind == "phone" and v.startswith("+"):
            assert one[:2] == v[:2]
    assert [t for t, _ in run(spark, [new for new, _ in made], reverse=True)] == texts
    assert [t for t, _ in run(spark, texts, key="other")] != [t for t, _ in made]


def test_dates_in_short_forms_come_back_to_the_same_day(spark):
    made = run(spark, ["1-2-1987", "3/4/2001"])
    back = run(spark, [t for t, _ in made], reverse=True)
    assert [[int(x) for x in re.split("[-/]", t)] for t, _ in back] == [[1, 2, 1987], [3, 4, 2001]]


def test_dates_do_not_share_pseudonyms(spark):
    days = [datetime.date(1999, 1, 1) + datetime.timedelta(days=k) for k in range(1500)]
    texts = [d.strftime("%m/%d/%Y") for d in days] + [d.strftime("%d/%m/%Y") for d in days if d.day > 12]
    made = run(spark, texts)
    assert len({t for t, _ in made}) == len(texts)
    assert [t for t, _ in run(spark, [t for t, _ in made], reverse=True)] == texts


def test_addresses_stay_linked(spark):
    (a, found), (b, _), (c, _) = run(spark, ["Ann.Lee@mail.example.org", "(ann.lee@MAIL.example.org)", "bob@mail.example.org"])
    assert found == ["email"] and b == f"({a})" and a.endswith(".org") and "ann" not in a.lower()
    assert a.split("@")[1] == c.split("@")[1] and a != c


def test_other_text_is_left_alone(spark):
    texts = [f"Here is {x} and more" for x in LEFT]
    assert run(spark, texts) == [(t, []) for t in texts]


def test_permutation_is_one_to_one(spark):
    rows = spark.range(1000).select(pii.digits_permuted(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "n").alias("d"))
    assert sorted(int(r["d"]) for r in rows.collect()) == list(range(1000))


def test_days_are_permuted_one_to_one(spark):
    size = pii.DAYS[0] * 3
    p = pii.permuted((F.col("id") / 3).cast("bigint"), F.col("id") % 3, pii.DAYS[0], 3, "k", "n")
    assert len({tuple(r["p"]) for r in spark.range(size).select(p.alias("p")).collect()}) == size


def test_hard_rows(spark):
    docs = brute.documents(spark, *brute.HARD, (50, "ip 10.0.0.1"), (51, "ip 10.0.0.1"))
    done = pii.pseudonymise(docs, key="k")
    assert done.columns == [c for c in docs.columns if c != "found"] + ["found"] or done.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in done.collect()}
    assert {d: got[d] for d, _ in brute.HARD} == dict(brute.HARD)
    assert got[50] == got[51] != "ip 10.0.0.1"
    assert pii.pseudonymise(docs.limit(0), key="k").count() == 0


def test_no_python_in_the_plan(spark):
    plan = pii.op8(spark, brute.SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_the_smallest_table_loses_its_values(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{brute.SF}/documents.parquet").collect()}
    done = pii.op8(spark, brute.SF).collect()
    assert len(done) == len(texts)
    for r in done:
        old = texts[r["doc_id"]] or ""
        for v in re.findall(r"[\w.]+@[\w.]+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b", old):
            assert v not in r["text"]
        if not r["n_found"]:
            assert r["text"] == texts[r["doc_id"]]


def test_the_key_is_in_no_plan(spark):
    docs = brute.documents(spark, *brute.HARD)
    shown = pii.pseudonymise(docs, key="a-key-to-keep")._jdf.queryExecution()
    assert "a-key-to-keep" not in shown.toString() + shown.stringWithStats() + shown.executedPlan().toString()


def test_a_missing_key_is_told(spark):
    with pytest.warns(UserWarning, match="links values within this result alone"):
        pii.session_key(spark)


def test_values_against_plain_python(spark):
    texts = [f"Write to {v}, or not. Again: {v}" for own in VALUES.values() for v in own]
    texts += [f"Here is {x} and more" for x in LEFT] + ["3/4/2001, 31/12/1999 4.5.1900", "Ann.Lee@mail.example.org at +1 (555) 010-9999", "", "none"]
    rng = random.Random(5)
    texts += ["".join(rng.choices("0123456789-./+() @a", k=40)) for _ in range(500)]
    plain = brute.Pseudonyms(pii.PATTERNS, "a key of the tests")
    assert run(spark, texts) == [plain(t) for t in texts]


def test_query_against_plain_python(spark):
    spark.conf.set(pii.KEY_SETTING, "stated")
    try:
        done = pii.op8(spark, brute.SF)
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    plain = brute.Pseudonyms(pii.PATTERNS, "stated")
    texts = {r["doc_id"]: plain(r["text"]) for r in spark.read.parquet(f"{brute.SF}/documents.parquet").collect()}
    got = done.collect()
    assert len(got) == len(texts)
    for r in got:
        text, found = texts[r["doc_id"]]
        assert r["text"] == text and r["n_found"] == len(found)
        assert all(r[f"n_{k}"] == found.count(k) for k in pii.PATTERNS)


def test_without_a_stated_key_no_two_results_are_linked(spark):
    assert pii.session_key(spark) != pii.session_key(spark)
    one, two = ({r["doc_id"]: r["text"] for r in pii.op8(spark, brute.SF).filter("n_found > 0").collect()} for _ in range(2))
    assert one.keys() == two.keys() and all(one[k] != two[k] for k in one)
