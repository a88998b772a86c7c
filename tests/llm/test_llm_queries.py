"""The registered queries against their SQL, and the pipeline against plain Python."""

import brute
import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from metaloom.llm import langid, packing, queries, shared


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    known = duck.sql(queries.oracle_sql()[name])
    columns = sorted(known.columns)
    df = queries.queries()[name](spark, brute.SF)
    assert sorted(df.columns) == columns
    at = [known.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in known.fetchall()), key=repr)


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries() if k.startswith("op")) == list(range(1, 14))


def hard_folder(spark, tmp_path):
    """A folder of tables with hard rows beside some of the smallest table."""
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    extra = brute.documents(spark, *[(10_000 + d, t) for d, t in brute.HARD], extra=False).select(*docs.columns)
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{brute.SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_every_stage_against_plain_python(spark, tmp_path):
    d = hard_folder(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [s.__name__ for s in stages.values()] == ["language", "lines", "near_duplicates", "benchmark", "pack"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]

    def step(name, before):
        after = stages[name](spark, before, d)
        assert after.columns == before.columns and after.schema["n_chars"].dataType == before.schema["n_chars"].dataType
        return shared.stored(after, f"test-{name}")

    one = step("language", docs)
    assert rows(one) == {k: t for k, t in rows(docs).items() if any(c.isalpha() for c in t or "")}
    named = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.train(docs.filter(~langid.held_out()))).collect()}
    assert {r["doc_id"]: r["lang"] for r in one.collect()} == {k: named[k] for k in rows(one)}
    two = step("lines", one)
    assert rows(two) == {k: "\n".join(stay) for k, (stay, _) in brute.keep_lines(rows(one).items()).items()}
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())
    three = step("near_duplicates", two)
    classes = brute.near_classes(rows(two).items())
    first = {}  # texts without words are one class for equal bytes
    for k, t in sorted(rows(two).items()):
        first.setdefault(t, k)
    assert rows(three) == {k: t for k, t in rows(two).items() if classes[k][0] == k and (brute.words(t) or first[t] == k)}
    four = step("benchmark", three)
    assert rows(four) == {k: t for k, t in rows(three).items() if not brute.contamination(t, items)[3]}
    last = stages["pack"](spark, four, d).collect()
    assert brute.check_packing(rows(four).items(), last, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))) < 0.02
    whole = corpus_pipeline.run(spark, d).collect()
    key = lambda r: (r["doc_id"], r["start"])
    assert sum(r["length"] for r in whole) == sum(r["length"] for r in last)
    assert {r["doc_id"] for r in whole} == {r["doc_id"] for r in last} and min(map(key, whole)) == min(map(key, last))


def test_stages_of_an_empty_table_and_of_extra_columns(spark, tmp_path):
    d = hard_folder(spark, tmp_path)
    for docs in (brute.documents(spark, *brute.HARD, (None, "no id here"), (None, None)), brute.documents(spark, *brute.HARD).limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, d)
            assert after.columns == docs.columns, name
            assert after.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, d).columns[0] == "doc_id"


def test_rows_without_an_id_pass_through(spark, tmp_path):
    d = hard_folder(spark, tmp_path)
    docs = brute.documents(spark, (None, "some words without an id"), (None, "some words without an id"), (1, "other words that have one"))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, d).count() == 3, name
    assert {r["doc_id"] for r in packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()} == {None, 1}
    assert langid.with_language(docs, langid.train(docs)).count() == 3
