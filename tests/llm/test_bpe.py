"""Operators 2 and 5 against the tokenizers library on whole texts, odd rows included."""

import hashlib

import pytest
from conftest import SMALL
from tokenizers import Tokenizer

from mentionlake.llm import bpe, token_counts
from mentionlake.llm.common import table

ODD = [
    None, "", " ", "\n\n  x \t y  ", "a<|endoftext|>b<|startoftext|> <|endoftext|><|endoftext|>", "it's IT'S we'll 'tis ''s", "aaaa aaaaa aaaaaaaaaaaa " * 50,
    "ΑΣ ΟΔΟΣ Σ İ ﬁ é́ é", "日本語 テキスト 🙂🙂 x²½", "a\x00b\x1cc\x85d\xa0e", "word " * 60_000, "xy" * 40_000,
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "kept") for i, t in enumerate(ODD + ODD[3:5])], "doc_id long, text string, ids string")


def library(name):
    return Tokenizer.from_file(bpe.default_path(name))


def test_round_trip_equals_the_library(odd):
    path = bpe.default_path("byte_bpe_50k.json")
    lib = library("byte_bpe_50k.json")
    rows = bpe.decode_documents(bpe.encode_documents(odd, path), path).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False) == (r.text or "")


def test_small_caches_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    text = "the and thing things the the<|endoftext|> and"
    coder = bpe.Coder(bpe.tokenizer_text(bpe.default_path("byte_bpe_50k.json")))
    ids, counts = coder.encode([text, text])
    want = library("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and counts.tolist() == [len(want)] * 2


def test_counts_equal_the_library_and_do_not_depend_on_the_table(odd):
    path = bpe.default_path("word_bpe_49k.json")
    lib = library("word_bpe_49k.json")
    want = {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD + ODD[3:5])}
    for top in (1, 32_768):
        assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(odd, path, top=top).collect()} == want


@pytest.mark.parametrize("copies", [1, 3])
def test_a_frequent_pretoken_may_have_any_length(spark, copies):
    path = bpe.default_path("word_bpe_49k.json")
    text = "a" * 1_000_000
    want = len(library("word_bpe_49k.json").encode(text, add_special_tokens=False).ids)
    docs = spark.createDataFrame([(i, text) for i in range(copies)], "doc_id long, text string")
    assert want > 65_535 and text in {r.pretoken for r in token_counts.frequent_pretokens(docs, path).collect()}
    assert [r.n_tokens for r in token_counts.count_tokens(docs, path).collect()] == [want] * copies


def test_the_table_tells_texts_of_equal_hashes_apart():
    words = [f"w{i}é" for i in range(2_000)]
    tier = token_counts.Tier.of(words, list(range(2_000)))
    assert tier.find([*words[::7], "absent", ""]) == {w: int(w[1:-1]) for w in words[::7]}
    tier.text = tier.text.replace("w70é".encode(), "x70é".encode())
    assert "w70é" not in tier.find(words) and len(tier.find(words)) == 1_999
    assert token_counts.Tier.of([], []).find(words) == {} and tier.find([]) == {}


def test_summaries_are_merged_in_a_tree_without_a_key_of_texts(spark):
    from conftest import plan_text

    docs = spark.range(0, 300, 1, 40).selectExpr("id as doc_id", "concat('the the of w', id % 3) as text")
    found = token_counts.frequent_pretokens(docs, bpe.default_path("word_bpe_49k.json"), top=4)
    plan = plan_text(found)
    assert "hashpartitioning(pretoken" not in plan and plan.count("hashpartitioning(part") == len(token_counts.TREE)
    counts = {r.pretoken.strip(" \u2581\u0120"): r.n for r in found.collect()}
    assert counts["of"] == 300 and len(counts) <= 4


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(none, bpe.default_path("word_bpe_49k.json")).count() == 0
    assert bpe.encode_documents(none, bpe.default_path("byte_bpe_50k.json")).count() == 0


def test_queries_over_the_whole_table(spark):
    lib2, lib5 = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    got = bpe.op2_bpe_round_trip(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib2.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in token_counts.op5_token_counts(spark, SMALL).collect():
        n = len(lib5.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_counting_shuffles_summaries_only(spark):
    from conftest import plan_text

    plan = plan_text(token_counts.op5_token_counts(spark, SMALL))
    assert "Exchange" not in plan


def test_a_round_trip_encodes_each_text_once(spark, odd, monkeypatch):
    import corpus_pipeline
    from conftest import plan_text

    path = bpe.default_path("byte_bpe_50k.json")
    two = bpe.decode_documents(bpe.encode_documents(odd, path), path)
    one = bpe.round_trip_documents(odd, path)
    assert one.columns == two.columns and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    monkeypatch.setattr(bpe, "PORTION_BYTES", 40)
    assert sorted(map(repr, bpe.round_trip_documents(odd, path).collect())) == sorted(map(repr, two.collect()))
    assert bpe.round_trip_documents(odd.limit(0), path).count() == 0
    docs = odd.select("doc_id", "text")
    for plan in (bpe.op2_bpe_round_trip(spark, SMALL), corpus_pipeline.tokens(spark, docs, SMALL)):
        assert "decode(encode(" not in plan_text(plan) and plan_text(plan).count("ArrowEvalPython [") == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_both_regular_expression_modules_cut_alike(name, monkeypatch):
    import random

    import regex

    r = random.Random(8)
    pool = [chr(c) for c in (*range(0x250), 0x2028, 0x3000, 0x4E00, 0x0663, 0x2160, 0xFEFF, 0xD7FF, 0xFFFF, 0x1D7D8, 0x1F642, 0x10400)] + [" "] * 60 + list("'s't're'll") * 5
    texts = ["".join(r.choices(pool, k=r.randint(0, 60))) for _ in range(2_000)] + ["".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))]
    text = bpe.tokenizer_text(bpe.default_path(name))
    quick = bpe.Coder(text)
    monkeypatch.setattr(bpe, "finder", lambda pattern: regex.compile(pattern).findall)
    plain = bpe.Coder(text)
    assert all(quick.find(t) == plain.find(t) for t in texts)


def test_ids_that_cut_characters_decode_as_the_library_does(spark):
    path = bpe.default_path("byte_bpe_50k.json")
    lib = library("byte_bpe_50k.json")
    ids = lib.encode("é🙂ab日", add_special_tokens=False).ids
    lists = [ids[1:], ids[::-1], ids, [], None, ids[:1] * 3]
    rows = spark.createDataFrame(list(enumerate(lists)), "doc_id int, ids array<int>").coalesce(1)
    got = {r.doc_id: r.decoded for r in bpe.decode_documents(rows, path).collect()}
    assert got == {i: lib.decode(x or [], skip_special_tokens=False) for i, x in enumerate(lists)}
