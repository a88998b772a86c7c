"""Centroids, token counts and periodic runs: against plain Python, and rows that are hard to handle."""

import hashlib
import math
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from metaloom.llm import centroids, periodic_runs, queries, token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# --- centroids -------------------------------------------------------------------------------------------------


def lloyd(rows, centroids=16, components=64, rounds=3):
    """rows: (vec_id, components or None). [(vec_id, cluster, distance)] and the final centroids, by plain loops."""
    kept = [(k, [math.floor(64 * x) for x in v]) for k, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    seed = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=seed)[:centroids]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, row, strict=True)), k) for k, row in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, members in groups.items():
            c[k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return [(key, *nearest(v)[::-1]) for key, v in kept], c


def vectors(spark, rows, extra=True):
    more = ", own string, near string, rest string, x string, distance string" if extra else ""
    data = [(k, v, *(["z"] * 5 if extra else [])) for k, v in rows]
    return spark.createDataFrame(data, "vec_id bigint, embedding array<double>" + more)


def hard_vectors(n=300, seed=5):
    rng = random.Random(seed)
    around = [[rng.gauss(0, 0.2) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.15) for x in rng.choice(around)]) for i in range(n)]
    rows += [(i, rows[7][1]) for i in (900, 901, 901, 902)] + [(None, rows[3][1]), (None, rows[3][1])]  # copies, repeated and null ids
    rows += [(2000, None), (2001, []), (2002, [0.5] * 63), (2003, [0.5] * 65), (2004, [None] + [0.5] * 63), (2005, [float("nan")] * 64), (2006, [float("inf")] + [0.0] * 63), (2007, [0.0] * 64)]
    rng.shuffle(rows)
    return rows


def check_clusters(spark, rows):
    known, c = lloyd(rows)
    df = centroids.report(*centroids.cluster(vectors(spark, rows)))
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = df.collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r[0], r[1], r[2]) for r in got), key=key) == sorted(known, key=key)
    for r in got:
        assert r["inertia"] == sum(x[2] for x in known)
        assert r["cluster_inertia"] == sum(x[2] for x in known if x[1] == r["cluster"])
        assert r["centroid_sha256"] == brute.sha256(",".join(map(str, c[r["cluster"]])))


def test_clusters_against_plain_rounds(spark):
    check_clusters(spark, hard_vectors())


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    check_clusters(spark, hard_vectors()[:n])


def test_vectors_that_are_all_equal_and_ties(spark):
    check_clusters(spark, [(i, [0.25] * 64) for i in range(40)])
    check_clusters(spark, [(i, [(i % 3 - 1) / 64] * 64) for i in range(60)])


def test_bounds_certify_and_the_rest_is_measured():
    """Over rounds on clustered vectors: the same clusters as a full scan, and most vectors are not scanned."""
    rng = np.random.default_rng(1)
    x = (rng.integers(-60, 60, (12, 64))[rng.integers(0, 12, 4000)] + rng.integers(-20, 20, (4000, 64))).astype(np.int64)
    c = x[:16].copy()
    b = centroids.Bounds(x, c, 4)
    b.scan(np.arange(len(x)))
    scanned = []
    for keep in (4, 3, 2, 2):
        new = np.array([x[b.own == k].sum(0) // max((b.own == k).sum(), 1) if (b.own == k).any() else c[k] for k in range(16)])
        moved, c = np.sqrt(((new - c) ** 2).sum(1)), new
        after = centroids.Bounds(x, c, keep)
        after.carry(b.own, b.near, b.lower, b.rest, moved)
        d = centroids.distances(x, c)
        assert (after.own == d.argmin(1)).all() and (after.distance == d.min(1)).all()
        near = np.take_along_axis(d, after.near, 1)
        assert (after.lower <= np.sqrt(near)).all()
        others = d.copy()
        np.put_along_axis(others, np.concatenate([after.own[:, None], after.near], 1), 1 << 60, 1)
        assert (after.rest <= np.sqrt(others.min(1))).all()
        scanned.append((after.used == 16).mean())
        b = after
    assert scanned[-1] < 0.2


def test_large_components_are_exact_and_too_large_ones_an_error(spark):
    check_clusters(spark, [(i, [float((i * 37 + j) % 11 * 150_000) for j in range(64)]) for i in range(30)])
    with pytest.raises(Exception, match="too large for exact distances"):
        centroids.cluster(vectors(spark, [(1, [3e6] * 64)]))


# --- token counts ----------------------------------------------------------------------------------------------


def test_counts_agree_with_the_library():
    counter, known = token_counts.MergeCounter(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    want = lambda x: len(known.encode(x, add_special_tokens=False).ids)
    rng = random.Random(5)
    pool = ["a", "b", "e", "th", " ", "  ", "\n", "'s", "'S", "12", "é", "语", "\U0001f600", "!?", "-", "<|endoftext|>", "<|", "\t", "\x85", "　", "ing", "tion", "\x00", "İ", "٣", "½", "՘", "\U00018d09", "\U0003d000"]
    texts = ["", "<|endoftext|>", "a" * 3000, " " * 500 + "x", "ab" * 2000, "՘ a՘b", *("".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(3000))]
    texts += ["".join(rng.choice("abcdefghinorst") for _ in range(rng.randrange(400))) for _ in range(300)]
    assert [counter.count(x) for x in texts] == [want(x) for x in texts]


def test_token_counts_of_hard_rows(spark):
    known = Tokenizer.from_file(VOCABULARY)
    docs = brute.documents(spark, *brute.HARD, (None, None), (4, "again <|endoftext|>"))
    got = sorted(map(tuple, token_counts.count_tokens(docs, VOCABULARY).collect()), key=repr)
    n = lambda t: len(known.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((d, len((t or "").encode()), n(t), n(t) > 1024) for d, t in [*brute.HARD, (None, None), (4, "again <|endoftext|>")]), key=repr)
    assert token_counts.count_tokens(docs.limit(0), VOCABULARY).collect() == []


def test_query_of_token_counts_against_the_library(spark):
    known = Tokenizer.from_file(VOCABULARY)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{brute.SF}/documents.parquet").collect()}
    got = queries.queries()["op12_token_counts"](spark, brute.SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = {d: len(known.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == {d: (len(t.encode()), n[d], n[d] > 1024) for d, t in texts.items()}


def test_another_kind_of_vocabulary_is_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.MergeCounter(public_tokenizers.path("word_bpe_49k.json"))


# --- periodic runs ---------------------------------------------------------------------------------------------


def all_runs(words, least=12):
    """All runs (start, length, period), period by period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start >= max(least, 2 * q):
                best.setdefault((start, i), q)
    return sorted((s, t - s, q) for (s, t), q in best.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_against_all_periods():
    rng = random.Random(3)
    cases = [fibonacci(300), "".join("ab"[bin(i).count("1") % 2] for i in range(300)), "a" * 200, "ab" * 60 + "c" + "ab" * 50, "", "a", "abcdefghijkl", "aaaaaaaaaaa", "a" * 12]
    for k in range(800):
        letters, text = ("ab", "ab", "abcdef")[k % 3], ""
        while len(text) < 10 + k % 120:
            text += "".join(rng.choice(letters) for _ in range(rng.randrange(1, 15))) * rng.choice([1, 1, 1, 2, 3, 5])
        cases.append(text)
    for text in cases:
        words = [c.encode() for c in text]
        assert periodic_runs.document_runs(words) == periodic_runs.runs_of(words) == all_runs(words), text


def test_ordered_sets_of_many_blocks():
    rng = random.Random(1)
    values = rng.sample(range(100_000), 20_000)
    ends, seen = periodic_runs.Ends(values[0]), [values[0]]
    for v in values[1:]:
        before, after = ends.add(v)
        if len(seen) < 300 or v % 997 == 0:
            assert before == max((x for x in seen if x < v), default=None) and after == min((x for x in seen if x > v), default=None)
        seen.append(v)
    assert list(ends) == sorted(values) and ends.size == len(values) and len(ends.blocks) > 3


def plain_runs(doc, text):
    """The contract of the query for one document."""
    words = [x for x in __import__("re").split("[\x20\x09-\x0d]+", text or "") if x]
    n = len(words)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = all_runs(words) if n < 4000 else periodic_runs.runs_of(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in runs), default=None)
    four = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return doc, len(runs), *four, brute.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs)), brute.sha256(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_query_of_runs_against_its_contract(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{brute.SF}/documents.parquet").collect()]
    got = queries.queries()["op13_periodic_runs"](spark, brute.SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_runs(d, t) for d, t in texts)
    assert any(periodic_runs.planted(d, 10) is not None for d, _ in texts)


def test_runs_of_hard_rows(spark, tmp_path):
    space = " a b \x1c c\x85"  # white space beyond the six characters is part of words
    rows = [*brute.HARD, (None, None), (None, "a " * 30), (50, "x y " * 20), (50, "x y " * 20), (51, space * 8), (52, "q\n" * 11), (53, "q\n" * 12)]
    docs = brute.documents(spark, *rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["op13_periodic_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_runs(d, t) for d, t in rows), key=repr)
    found = {r["doc_id"]: r for r in periodic_runs.find_runs(docs).collect()}
    assert found[50]["collapsed"] == "x y" and [tuple(r) for r in found[50]["runs"]] == [(0, 40, 2)]
    assert periodic_runs.find_runs(docs.limit(0)).collect() == []
