"""Packing and decontamination against plain Python."""

import random

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from metaloom.llm import decontam, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# --- packing ---------------------------------------------------------------------------------------------------


def test_documents_are_packed_whole(spark, tokenizer):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet").repartition(3)
    waste = brute.check_packing(pairs(docs), packing.op9(spark, brute.SF).collect(), tokenizer)
    assert waste < 0.01


def test_hard_documents_are_packed_whole(spark, tokenizer):
    docs = brute.documents(spark, *brute.HARD)
    got = packing.pack_documents(docs, PATH)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    brute.check_packing(brute.HARD, got.collect(), tokenizer)
    few = packing.pack_documents(docs, PATH, tokens=64, segments=2).collect()
    brute.check_packing(brute.HARD, few, tokenizer, most=64)
    assert max(np.unique([r["sequence_id"] for r in few], return_counts=True)[1]) <= 2
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_chunks_have_the_ids_of_the_whole_text(tokenizer):
    rng = random.Random(2)
    alphabet = [*"abcXYZ0129 .,'-_!\n\t\r\v\f", " ", " ", "é", "ß", "ſ", "İ", "ª", "²", "😀", "한", "<|endoftext|>", "don't", "'s", "​", "é", "\x00", "\x85"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(3000)] + [brute.LONG, "", " ", "\n"]
    made = packing.ChunkTokenizer(PATH, most=500)
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        ids, counts = made.encode(pa.array(part, pa.string()))
        for text, own in zip(part, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_parts_of_chunks_are_learned_once():
    rows = ["Word, word.  (WORD)\nÉté été!", None, "", "a1b22c", "don't 'Tis× <|ENDOFTEXT|> ß=Ø", "x", "y"]
    data, offsets = packing.shared.utf8(pa.array(rows))
    parts, starts = packing.pieces(data, offsets)
    got = [parts.to_pylist()[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert got == [["word", ",", "word", ".", "(", "word", ")", "été", "été", "!"], [], [], ["a", "1", "b", "2", "2", "c"], ["don't", "'Tis×", "<|ENDOFTEXT|>", "ß", "=", "ø"], ["x"], ["y"]]
    assert packing.pieces(*packing.shared.utf8(pa.array(["", " \n"])))[1].tolist() == [0, 0, 0]
    made, marks = packing.ChunkTokenizer(PATH), [".", ",", "!", "?", ";"]
    made.encode(pa.array([f"{x}{m} {x.title()}{m}" for x in ("one", "two", "three") for m in marks]))
    assert len(made.number) == 3 + len(marks)  # before, each word was learned anew with each mark and case: 30


def test_examples_respect_all_limits(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(1, 600), rng.randrange(0, 1)) for i in range(50)] + [(100 + i, n := rng.randrange(1, 900), rng.randrange(n)) for i in range(400)] + [(900, 1, None), (901, None, None), (902, 2048, 1024)]
    df = spark.createDataFrame(rows, "example_id bigint, n bigint, loss bigint")
    got = packing.pack_examples(df, example_id="example_id", tokens="n", loss_tokens="loss", max_segments=7).collect()
    known = {k: (n or 0, m or 0) for k, n, m in rows}
    assert sorted(r["example_id"] for r in got) == sorted(known)
    by = {}
    for r in got:
        assert r["length"] == known[r["example_id"]][0]
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: (r["offset"], r["length"])):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and len(own) <= 7 and sum(known[r["example_id"]][1] for r in own) <= 1024
    bound = max(sum(n for n, _ in known.values()) / 2048, sum(m for _, m in known.values()) / 1024, len(known) / 7)
    assert len(by) <= 1.35 * bound + 4
    assert all(r["loss_length"] == known[r["example_id"]][1] for r in got)
    large = packing.pack_examples(spark.createDataFrame([(1, 2049, 0), (2, 1025, 1025), (3, 5, 5)], df.schema), example_id="example_id", tokens="n", loss_tokens="loss").collect()
    assert sorted((r["example_id"], r["length"], r["sequence_id"] is None, r["offset"]) for r in large) == [(1, 2049, True, None), (2, 1025, True, None), (3, 5, False, 0)]
    assert packing.pack_examples(df.limit(0), example_id="example_id", tokens="n", loss_tokens="loss").count() == 0


def check_exchanges(rows, got, tokenizer, tokens=2048, segments=16, loss=1024):
    """rows: (conv_id, turn, role, text). Asserts that each exchange is there once, whole and in a sequence that it fits."""
    known = {}
    for c, t, role, text in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        a, b = known.get((c, t if t is None else t // 2), (0, 0))
        known[c, t if t is None else t // 2] = a + n, b + n * (role == "assistant")
    assert len(got) == len(known) and {(r["conv_id"], r["exchange"]): (r["length"], r["loss_length"]) for r in got} == known
    by = {}
    for r in got:
        assert (r["sequence_id"] is None) == (r["offset"] is None) == (r["length"] > tokens or r["loss_length"] > loss)
        if r["sequence_id"] is not None:
            by.setdefault(r["sequence_id"], []).append(r)
    full = [0, 0, 0]
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        bearing = sum(r["loss_length"] for r in own)
        assert at <= tokens and len(own) <= segments and bearing <= loss
        full = [full[0] + (at > 0.9 * tokens), full[1] + (len(own) == segments), full[2] + (bearing > 0.9 * loss)]
    placed = [r for own in by.values() for r in own]
    least = max(sum(r["length"] for r in placed) / tokens, sum(r["loss_length"] for r in placed) / loss, len(placed) / segments)
    return len(by), least, full


def test_conversations_are_packed_under_all_limits(spark, tokenizer):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    used, least, full = check_exchanges(rows, packing.pack_conversations(spark, d).collect(), tokenizer)
    print(used, least, full)
    assert used <= 1.3 * least + 4


def test_hard_conversations(spark, tokenizer):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "again"), (2, 0, "user", brute.LONG), (2, 1, "assistant", "short"), (3, 1, "assistant", "no question"), (3, 2, None, "no role"), (None, 0, "user", "x"), (4, None, "user", "y"), *[(5, 0, "user", "a"), (5, 1, "assistant", "b")] * 40]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, n string, exchange int")
    packed = packing.pack_examples(packing.exchanges(df, PATH), example_id="exchange", tokens="tokens", loss_tokens="loss_tokens", max_segments=2)
    got = packed.selectExpr("exchange.conv_id", "exchange.k AS exchange", "length", "loss_length", "sequence_id", "offset").collect()
    check_exchanges(rows, got, tokenizer, segments=2)
    assert packing.exchanges(df.limit(0), PATH).count() == 0


def test_another_tokenizer_takes_whole_texts():
    other = packing.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Two  words\n and more", None, "", "Über 12345"]
    ids, counts = other.encode(pa.array(texts))
    each = [other.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert not other.by_chunk and ids.tolist() == sum(each, []) and counts.tolist() == [len(x) for x in each]
    assert packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json")).by_chunk


# --- decontamination -------------------------------------------------------------------------------------------


def test_suffix_array_and_index():
    rng = np.random.default_rng(4)
    for size, letters in ((1, 3), (50, 2), (400, 5), (3000, 900)):
        s = np.append(rng.integers(2, 2 + letters, size), 0).astype(np.uint16)
        t = s.tolist()
        assert decontam.suffix_array(s).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        index = decontam.FMIndex(s)
        for _ in range(20):
            n = int(rng.integers(1, 5))
            at = int(rng.integers(0, size))
            phrase = t[at : at + n] if rng.random() < 0.7 and at + n <= size else rng.integers(2, 2 + letters, n).tolist()
            wide = np.zeros((1, 13), np.uint16)
            wide[0, 13 - len(phrase) :] = phrase
            low, high = index.search(wide, np.array([len(phrase)]))
            found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert found == [i for i in range(len(t)) if t[i : i + len(phrase)] == phrase]


def test_wavelet_matrix_ranks():
    s = np.random.default_rng(9).integers(0, 1 << 16, 500).astype(np.uint16) % 37
    made = decontam.WaveletMatrix(s)
    i = np.arange(len(s))
    symbol, before = made.access(i)
    assert symbol.tolist() == s.tolist()
    assert before.tolist() == [int((s[:k] == s[k]).sum()) for k in range(len(s))]
    assert made.rank(s.astype(np.int64), i).tolist() == before.tolist()


def found(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontam.verdicts(df).collect()}


def item_words(k, n):
    return " ".join(f"q{k}x{i}" for i in range(n))


ITEMS = [(10, item_words(1, 30)), (2, item_words(2, 13)), (3, "Short Item"), (4, ""), (5, None), (6, item_words(2, 13)), (7, "straße"), (8, item_words(3, 14))]
TEXTS = [
    (201, f"before {item_words(1, 30)} after"),
    (202, f"some {item_words(1, 30)[6 * 5:]} " + "filler " * 2000),
    (203, " ".join(item_words(2, 13).split()[:12])),
    (204, item_words(2, 13).upper().replace(" ", ", ")),
    (205, "a short  ITEM! and short item"),
    (206, f"{item_words(3, 14)} {item_words(3, 14)} STRASSE"),
    (207, "Straße"),
]


@pytest.mark.parametrize("options", [{}, {"shard_words": 20}, {"pass_windows": 8}, {"items_each": 1}, {"items_each": 1, "pass_windows": 8}])
def test_contamination_against_brute_force(spark, options):
    rows = [*TEXTS, *brute.HARD]
    benchmark = spark.createDataFrame([(*x, "z") for x in ITEMS], "item_id bigint, text string, doc string")
    docs = brute.documents(spark, *rows)
    want = {d: brute.contamination(t, ITEMS) for d, t in rows}
    assert want[205][3] and want[203][1] == 0
    assert found(decontam.contamination(docs, benchmark, **options)) == want
    kept = decontam.clean(docs, benchmark, **options)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, x in want.items() if not x[3])


@pytest.mark.parametrize("options", [{}, {"pass_windows": 8}])
def test_a_clean_text_stays_beside_a_contaminated_one_of_its_id(spark, options):
    benchmark = spark.createDataFrame([(*x, "z") for x in ITEMS], "item_id bigint, text string, doc string")
    bad, good = TEXTS[0][1], "nothing of it"
    docs = brute.documents(spark, (1, bad), (1, good), (1, bad), (1, good), (1, None), (None, bad), (None, good))
    kept = decontam.clean(docs, benchmark, **options).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, good), (1, good), (1, None), (None, good)], key=repr)


def test_contamination_on_the_smallest_table(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{brute.SF}/benchmark.parquet").collect()]
    rows = pairs(spark.read.parquet(f"{brute.SF}/documents.parquet"))
    got = {r["doc_id"]: r for r in decontam.op10(spark, brute.SF).collect()}
    for d, t in rows:
        n, hit, names, bad = brute.contamination(t, items)
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(names), bad)
        assert r["items_sha256"] == brute.sha256(",".join(names))
    assert any(r["contaminated"] for r in got.values())


def test_a_window_that_many_items_share_is_no_list_on_the_driver(spark):
    items = [(i, item_words(2, 13)) for i in range(300)] + [(1000 + i, item_words(2, 13) + f" own{i}") for i in range(3)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = brute.documents(spark, (1, f"x {item_words(2, 13)}"), (2, "nothing"), (3, item_words(2, 13) + " own1"), (3, None))
    every, handles, shared_by = decontam._passes(benchmark, "item_id", "text", 13, 1 << 18, 64)
    assert every == 1 and shared_by.count() == 303 and len(next(handles).value.names) < 10
    got = sorted(((r["doc_id"], r["n_hit"], len(r["items"]), r["items"] == sorted(r["items"])) for r in decontam.contamination(docs, benchmark).collect()))
    assert got == [(1, 13, 303, True), (2, 0, 0, True), (3, 0, 0, True), (3, 14, 303, True)]


def test_contamination_of_nothing(spark):
    docs = brute.documents(spark, *TEXTS)
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert all(x[1:] == (0, [], False) or x == (0, 0, [], False) for x in found(decontam.contamination(docs, benchmark)).values())
    assert decontam.contamination(docs.limit(0), spark.createDataFrame(ITEMS, benchmark.schema)).count() == 0


@pytest.mark.parametrize("options", [{}, {"pass_windows": 8}])
def test_spans_are_cut_out(spark, options):
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = brute.documents(spark, (1, TEXTS[0][1]), (1, "nothing of it"), (2, None), (3, item_words(3, 14)), (None, f"x {item_words(2, 13)}"))
    done = decontam.strip(docs, benchmark, **options)
    assert done.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in done.collect()), key=repr) == sorted([(1, "before  after"), (1, "nothing of it"), (2, None), (3, ""), (None, "x ")], key=repr)
    assert decontam.strip(docs.limit(0), benchmark, **options).count() == 0
