"""The pipeline: each stage against brute force on its own input, and odd rows through all of them."""

import pytest
from conftest import SMALL
from test_jaccard import brute
from test_rules import plain_base, scan
from tokenizers import Tokenizer

import corpus_pipeline as P
from mentionlake.llm import bpe
from mentionlake.llm.common import table


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """[(name, rows in, rows out)] over the small documents with odd rows added."""
    docs = table(spark, SMALL, "documents")
    texts = [r.text for r in docs.filter("doc_id in (1, 6, 7)").collect()]
    odd = [(9001, None), (9002, ""), (None, texts[0]), (9003, texts[0]), (9003, texts[0]), (9004, " "), (9005, texts[1] + " write to ann.b@mail.example.com or +1 (968) 555-9369"), (None, None)]
    odd = spark.createDataFrame([(i, t, None, "odd", None) for i, t in odd], docs.schema)
    current, out = docs.unionByName(odd), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, current, SMALL).write.parquet(path)
        result = spark.read.parquet(path)
        if name != P.STAGES[-1][0]:
            assert result.columns == docs.columns
        out.append((name, current.collect(), result.collect()))
        current = result
    return out


def ids(rows):
    return sorted((repr(r.doc_id), repr(r.text)) for r in rows)


def test_quality_keeps_what_is_labelled_good(spark, steps):
    _, before, after = steps[0]
    label = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    kept = {r.doc_id for r in after}
    good = [k for k, q in label.items() if q == 1]
    assert sum(k in kept for k in good) >= 0.97 * len(good) and len(after) < len(before)


def test_one_of_each_group_stays(steps):
    _, before, after = steps[1]
    rows = [(r.doc_id, r.text) for r in before]
    heads = {(k, low) for k, n, low in brute(rows) if n and k == low and k != "None"}
    got = [r for r in after if r.doc_id is not None and (r.text or "").split()]
    assert sorted(repr(r.doc_id) for r in got) == sorted(k for k, _ in heads)
    assert sum(not (r.text or "").split() for r in after) == sum(not (r.text or "").split() for r in before)
    assert not [r for r in after if r.doc_id is None and r.text]  # a copy of document 1


def test_contaminated_documents_go(spark, steps):
    _, before, after = steps[2]
    bench = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    windows = {w for _, t in bench for w in grams(t)}
    assert ids(after) == ids(r for r in before if not windows & set(grams(r.text)))
    assert len(after) < len(before) and scan("", bench) == (0, 0, [])


def grams(text):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [tuple(words[i : i + 10]) for i in range(len(words) - 9)]


def test_personal_data_is_masked(steps):
    _, before, after = steps[3]
    assert len(before) == len(after) and any("[EMAIL]" in (r.text or "") for r in after)
    kept = {r.doc_id: r for r in after if r.doc_id is not None}
    for r in before:
        if r.doc_id is not None and not plain_base(r.text):
            assert kept[r.doc_id].text == r.text
    assert not any(plain_base(r.text) for r in after)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)


def test_tokens_equal_the_library(steps):
    _, before, after = steps[4]
    lib = Tokenizer.from_file(bpe.default_path("byte_bpe_50k.json"))
    assert len(before) == len(after)
    for r in after:
        assert r.ids == lib.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.exact


def test_run_gives_the_same_as_its_stages(spark):
    out = P.run(spark, SMALL)
    assert out.count() > 100 and P.QUERIES["pipeline"] is P.run and P.ORACLE_SQL is None
