"""Language identification and the quality classifier: against plain Python, and on held-out rows."""

import math

import brute
import numpy as np
from pyspark.sql import functions as F

from metaloom.llm import langid, quality, shared

SF = "/root/testdata/sf0.01"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_held_out_is_the_contract(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id")).withColumn("out", langid.held_out())
    assert all(r["out"] == brute.held_out(r["doc_id"]) for r in rows.collect())


def test_language_of_held_out_documents(spark):
    docs = table(spark, "documents")
    got = langid.op3(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    letters = [r for r in got if r["held_out"] and r["lang"] and any(c.isalpha() for c in r["text"] or "")]
    assert np.mean([r["lang"] == r["lang_pred"] for r in letters]) > 0.97
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert 0 <= r["score"] <= 1


def test_prediction_ignores_lang_source_and_id(spark):
    docs = table(spark, "documents", brute.SF)
    model = langid.train(docs.filter(~langid.held_out()))
    a = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    b = {r["doc_id"] - 5000: r["lang_pred"] for r in langid.predict(docs.withColumns({"doc_id": F.col("doc_id") + 5000, "lang": F.lit("zz"), "source": F.lit("q")}), model).collect()}
    assert a == b


def grams(text):
    """The n-grams of a text, by its definition."""
    runs = "".join(c if c.isalpha() else "\0" for c in text)
    out, chars = [], []
    for i, c in enumerate(runs):
        if c != "\0":
            low = c.lower()
            chars.append(low if len(low) == 1 else c)
        elif i and runs[i - 1] != "\0":
            chars.append(" ")
    for n in langid.SIZES:
        out += [tuple(chars[i : i + n]) for i in range(len(chars) - n + 1) if n > 1 or chars[i] != " "]
    return out


def test_features_follow_texts():
    texts = ["Ab c", "", "12 x", "É-é\U00010400 \U0001f600", "", "zz"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    features, at, has = langid.ngrams(data, offsets)
    assert has.tolist() == [any(c.isalpha() for c in t) for t in texts]
    for i, t in enumerate(texts):
        assert at[i + 1] - at[i] == len(grams(t))
        alone = langid.ngrams(np.frombuffer(raw[i], np.uint8), np.array([0, len(raw[i])]))[0]
        assert sorted(alone) == sorted(features[at[i] : at[i + 1]])


def test_scores_are_naive_bayes(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en"), ("the end", "en"), (None, "en"), ("x", None)])]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == ["de", "en"]
    assert np.allclose(np.exp(model.prior), [1 / 3, 2 / 3])
    assert np.allclose(np.exp(model.weights.astype(float)).sum(axis=0), 1, atol=1e-3)
    counts = {lang: {} for lang in model.languages}
    for _, t, lang in rows:
        for g in grams(t or "") if lang else ():
            counts[lang][g] = counts[lang].get(g, 0) + 1
    query = "the hund"
    log = [model.prior[k] + sum(math.log((counts[lang].get(g, 0) + langid.SMOOTHING) / (sum(counts[lang].values()) + langid.SMOOTHING * langid.FEATURES)) for g in grams(query)) for k, lang in enumerate(model.languages)]
    raw = np.frombuffer(query.encode(), np.uint8)
    name, score = langid.score_batch(model, raw, np.array([0, len(raw)]))
    assert name == [model.languages[int(np.argmax(log))]]
    assert abs(score[0] - 1 / sum(math.exp(x - max(log)) for x in log)) < 0.02


def test_hard_rows(spark):
    docs = brute.documents(spark, *brute.HARD)
    model = langid.train(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert {d for d, x in got.items() if x == "und"} == {1, 2, 3, 7, 10}
    kept = langid.with_language(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 8, 9]
    assert langid.predict(docs.limit(0), model).count() == 0 and langid.with_language(docs.limit(0), model).count() == 0
    none = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


# --- quality ---------------------------------------------------------------------------------------------------


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def test_quality_of_held_out_documents(spark):
    got = quality.op5(spark, SF)
    assert got.count() == table(spark, "documents").count()
    rows = got.join(table(spark, "labels"), "doc_id").filter("held_out AND quality IS NOT NULL").collect()
    assert auc([(r["score"], r["quality"]) for r in rows]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_one_update_is_ftrl_proximal():
    z, n = np.zeros(4), np.zeros(4)
    index, value = np.array([1, 3]), np.array([0.6, 0.8])
    quality.learn(z, n, index, value, 1.0)
    g = -0.5 * value
    assert np.allclose(z[index], g) and np.allclose(n[index], g * g) and not z[[0, 2]].any()
    w = quality.weights(z, n)
    assert np.allclose(w[1], (0.3 - quality.L1) / ((quality.BETA + 0.3) / quality.ALPHA + quality.L2)) and w[0] == 0


def test_quality_features_do_not_depend_on_neighbours():
    texts = ["a b a b", "", "x.y", "Ü ü"]
    raw = [t.encode() for t in texts]
    index, value, at = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    for i, x in enumerate(raw):
        alone = quality.features(np.frombuffer(x, np.uint8), np.array([0, len(x)]))
        assert np.array_equal(alone[0], index[at[i] : at[i + 1]]) and np.allclose(alone[1], value[at[i] : at[i + 1]])
        assert abs((alone[1] ** 2).sum() - 1) < 1e-6


def test_quality_of_hard_rows(spark):
    docs = brute.documents(spark, *brute.HARD)
    labelled = docs.withColumn("quality", F.when(F.col("doc_id") > 3, (F.col("doc_id") % 2).cast("int")))
    w = quality.train(labelled)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, w).collect()}
    assert len(got) == len(brute.HARD) and all(0 <= s <= 1 for s in got.values()) and got[4] == got[5] and got[1] == got[2]
    assert np.array_equal(w, quality.train(labelled.repartition(3)))  # the order of rows does not matter
    none = quality.train(labelled.filter("quality IS NULL"))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), w).count() == 0


def test_word_hashes_follow_words():
    texts = ["One two", "ONE-two", "", "öne", "  ", "x1y"]
    raw = [t.encode() for t in texts]
    hashes, at = shared.words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert [int(at[i + 1] - at[i]) for i in range(len(texts))] == [len(brute.words(t)) for t in texts]
    assert hashes[at[0] : at[1]].tolist() == hashes[at[1] : at[2]].tolist()
