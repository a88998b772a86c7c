"""Line dedup, exact dedup and the near-duplicate join against plain Python."""

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from metaloom.llm import components, exact_dedup, line_dedup, ngram_join

LINE = "the quick brown fox jumps over"


# --- line dedup ------------------------------------------------------------------------------------------------


def dropped(df):
    return {r["doc"]: (r["kept"], r["n_dropped"]) for r in df.collect()}


def lines_of(rows):
    return {d: ("\n".join(stay), gone) for d, (stay, gone) in brute.keep_lines(rows).items()}


ROWS = [(1, f"{LINE}\nown line of the first one"), (2, f"  {LINE.upper()}\t\n\nshort"), (3, f"{LINE}\n{LINE}\nx"), (7, f"a\n{LINE}\r"), *[(d + 100, t) for d, t in brute.HARD]]


def test_line_dedup_against_brute_force(spark):
    docs = brute.documents(spark, *ROWS)
    want = lines_of(ROWS)
    assert want[7][1] == 0 and want[3][1] == 2
    assert dropped(line_dedup.dedup_lines(docs)) == want
    assert dropped(line_dedup.dedup_lines(docs, filter_bytes=0)) == want  # lines sent to their filters


def test_lines_are_sent_to_copies_of_their_filter(spark):
    rows = [(i, "\n".join(f"line number {j} of some documents" for j in range(i % 7, 9))) for i in range(60)]
    index = line_dedup.build_index(brute.documents(spark, *rows), shards=2)
    lost = lambda *args: {r["doc"]: set(r["keys"]) for r in line_dedup.losses(index, *args).collect()}
    assert lost(0, 5) == lost(0) == lost() and len(lost()) == 59
    assert line_dedup._sent(index, 5).count() == index.holders.count()


def test_rows_that_repeat_an_id_are_one_document(spark):
    docs = brute.documents(spark, (1, LINE), (1, LINE), (2, LINE + "\nx"), (2, "own words"))
    index = line_dedup.build_index(docs)
    assert [tuple(r)[1:] for r in index.references.collect()] == [(2, 2)]
    assert not any(r["n_dropped"] for r in line_dedup.dedup_lines(docs, index).collect())
    three = line_dedup.update_index(index, added=brute.documents(spark, (3, LINE), (3, LINE), (2, LINE)))
    assert [tuple(r)[1:] for r in three.references.collect()] == [(3, 3)]
    got = sorted((r["doc"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs, three).collect())
    assert got == [(1, 1), (1, 1), (2, 0), (2, 1)]


def test_line_dedup_keeps_columns_and_null_texts(spark):
    docs = brute.documents(spark, *ROWS)
    done = line_dedup.drop_repeated_lines(docs)
    assert done.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in done.collect()}
    want = {d: t for d, (t, _) in lines_of(ROWS).items()}
    want[101] = None
    assert got == want


def test_line_dedup_takes_deletions_back(spark):
    first, more = ROWS[:4], [(8, LINE), (9, "another line that is long enough\n" + LINE)]
    index = line_dedup.build_index(brute.documents(spark, *first), shards=3)
    grown = line_dedup.update_index(index, added=brute.documents(spark, *more))
    assert dropped(line_dedup.dedup_lines(brute.documents(spark, *first, *more), grown)) == lines_of([*first, *more])
    gone = spark.createDataFrame([(3,), (8,), (9,), (9,), (77,)], "doc_id bigint")
    back = line_dedup.update_index(grown, removed=gone)
    left = [r for r in first if r[0] != 3]
    assert dropped(line_dedup.dedup_lines(brute.documents(spark, *left), back)) == lines_of(left)
    assert sorted(tuple(r) for r in back.references.collect()) == sorted(tuple(r) for r in line_dedup.build_index(brute.documents(spark, *left)).references.collect())
    # Down to two holders: the line is not repeated any more, and its filter does not know it.
    two = line_dedup.update_index(back, removed=spark.createDataFrame([(1,)], "doc_id bigint"))
    assert not any(n for _, n in dropped(line_dedup.dedup_lines(brute.documents(spark, *left[1:]), two)).values())


def test_line_dedup_of_nothing(spark):
    empty = brute.documents(spark, *ROWS[:1]).limit(0)
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_cuckoo_filter_has_no_false_negatives_and_deletes():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    made = line_dedup.CuckooFilter(len(keys))
    assert made.insert(keys) and made.contains(keys).all()
    made.delete(keys[:2500])
    assert made.contains(keys[2500:]).all()
    assert made.contains(keys[:2500]).mean() < 0.01
    assert line_dedup.CuckooFilter(0, made.slots.tobytes()).contains(keys[2500:]).all()


# --- exact dedup -----------------------------------------------------------------------------------------------


def exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate({ord(c): None for c in brute.SPACE}), []).append((-len(t or ""), d))
    return sorted((d, min(g)[1], len(g), d == min(g)[1], brute.sha256(k)) for k, g in groups.items() for _, d in g)


@pytest.mark.parametrize("historical", [None, "true", "false", "doc < 5"])
def test_exact_dedup_against_brute_force(spark, historical):
    rows = [*brute.HARD, (11, "o ne"), (12, "on e"), (13, "one  "), (14, LINE), (15, LINE + " "), (16, "\v"), (17, "ONE")]
    got = exact_dedup.exact_duplicates(brute.documents(spark, *rows), historical=historical and F.expr(historical))
    assert sorted(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == exact(rows)


def test_exact_dedup_of_nothing_and_of_null_ids(spark):
    docs = brute.documents(spark, (None, "a"), (3, "a"))
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_duplicates(docs).collect()} == {(None, 3, False), (3, 3, True)}


def test_rows_for_which_history_is_null_are_looked_up(spark):
    docs = brute.documents(spark, (1, "a"), (7, "a"), (None, "a"), (None, "b"), (9, "c"))
    got = exact_dedup.exact_duplicates(docs, historical=F.col("doc") < 5).collect()
    assert sorted((r["text_sha256"], r["group_size"]) for r in got) == sorted([(brute.sha256("a"), 3)] * 3 + [(brute.sha256("b"), 1), (brute.sha256("c"), 1)])
    assert {r["keep_id"] for r in got if r["text_sha256"] == brute.sha256("a")} == {1}


def test_perfect_hash_is_minimal():
    keys = np.stack([np.frombuffer(hashlib.sha256(bytes([i % 256, i // 256])).digest(), np.uint8) for i in range(3000)])
    made = exact_dedup.PerfectHash(keys)
    assert sorted(made.slot(keys)) == list(range(3000))


# --- near duplicates -------------------------------------------------------------------------------------------


def near(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def variants(seed=3):
    """Texts of 15 to 400 words with copies, changed copies on both sides of the threshold, and chains of changes."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randrange(15, 400))
        rows.append(base)
        for _ in range(4):
            new = list(rng.choice(rows[-3:]))
            for _ in range(rng.randrange(0, max(2, len(new) // 40))):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            rows.append(new)
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(1000 + i, " ".join(w)) for i, w in zip(order, rows, strict=True)]


@pytest.mark.parametrize("blocks", [(4096, 1 << 21, 4096), (7, 1 << 21, 3), (4096, 300, 2)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, blocks):
    for name, size in zip(("BLOCK_SETS", "BLOCK_SHINGLES", "BUCKET_SETS"), blocks, strict=True):
        monkeypatch.setattr(ngram_join, name, size)
    rows = [*variants(), *brute.HARD, (20, "one two"), (21, "ONE, two!"), (22, "one two three")]
    assert near(ngram_join.near_duplicates(brute.documents(spark, *rows))) == brute.near_classes(rows)


def test_near_duplicates_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute.near_classes(rows)
    assert near(ngram_join.near_duplicates(docs)) == want
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    # Texts without words are classes of their own there, and one class for equal bytes here.
    wordless = {}
    for k, t in rows:
        if not brute.words(t):
            wordless.setdefault(t or "", []).append(k)
    gone = {k for ks in wordless.values() for k in sorted(ks)[1:]}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in want.values()} - gone)


@pytest.mark.parametrize("most", [ngram_join.BROADCAST_KEYS, 0])
def test_rows_that_repeat_an_id_are_documents_of_their_own(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "BROADCAST_KEYS", most)
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = brute.documents(spark, (5, a), (5, a), (5, b), (6, b), (7, a + " more"), (8, c), (9, ""), (9, " "), (4, None))
    got = sorted((r["doc_id"], r["class_id"], r["copy_of"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect())
    assert got == [(4, 4, 4, 0), (5, 5, 5, 1), (5, 5, 5, 2), (5, 5, 5, 2), (6, 5, 5, 1), (7, 5, 7, 2), (8, 8, 8, 0), (9, 9, 9, 0), (9, 9, 9, 0)]
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(docs).collect()), key=repr)
    assert kept == sorted([(5, a), (5, b), (8, c), (9, " "), (4, None)], key=repr)


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    docs = brute.documents(spark, (None, "a b c d e f"), (None, None), (4, "a b c d e f"))
    assert near(ngram_join.near_duplicates(docs.limit(0))) == {}
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect()), key=repr)
    assert got == [(4, 4, 0), (None, None, 0), (None, None, 0)]
    assert ngram_join.one_of_each(docs).count() == 3


def test_pruning_bound_is_safe():
    for n in (16, 96, 192):
        least = ngram_join.least_matches(n, 0.8, 1e-6)
        assert least < 0.8 * n
        assert ngram_join.least_matches(n, 0.8, 0.5) >= least


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (9, 8), (3, 1)], [(i + 1, i) for i in range(60)], [(50, i) for i in range(49)]])
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: root(x) for x in parent}
