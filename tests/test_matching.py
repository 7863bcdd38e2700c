import re

import pytest
from conftest import SMALL, plan_text
from pyspark.sql import functions as F

from mentionlake.functions.scalars import literal_table
from mentionlake.operators import matching as M
from mentionlake.plans.queries_match import terms as corpus_terms
from mentionlake.sources import tables as T


def match(spark, texts, terms, how, **kw):
    df = literal_table(spark, "id int, title string, description string", [(i, t, None) for i, t in enumerate(texts)])
    dic = literal_table(spark, "keyword string, term string", terms)
    return {r.id: r.matched_keywords for r in M.match_terms(df, dic, how=how, **kw).collect()}


WORD_TEXTS = ["AI and sea", "tidal power", "tidally locked", "une énergie bleue", "we use C++ here", "wave  energy", "wave energy.", "a.netx .net", "micro wave energyx", "εφη αβγδε"]
WORD_TERMS = [(t, t) for t in ("ai", "sea", "tidal", "nergie", "c++ ", "use c++", "wave energy", ".netx", "αβγδ")]


@pytest.mark.parametrize("limit", [100, 0])
def test_word_edges(spark, limit):
    out = match(spark, WORD_TEXTS, WORD_TERMS, "word", max_inline=limit)
    expected = {}
    for i, text in enumerate(WORD_TEXTS):
        low = text.lower()
        expected[i] = sorted(
            k for k, t in WORD_TERMS if len(t) >= 4 and re.search(r"(?<![A-Za-z0-9_])" + re.escape(t) + r"(?![A-Za-z0-9_])", low)
        )
    assert out == expected
    assert out[1] == ["tidal"] and out[2] == [] and out[3] == ["nergie"]


@pytest.mark.parametrize("limit", [100, 0])
def test_normalized_edges(spark, limit):
    texts = ["tidally", "wave—energy", "wave_energy", "see /wave-energy/x", "nothing"]
    terms = [("tide", "tidal"), ("wave", "wave energy"), ("sea", "wave energy"), ("x", "e e")]
    out = match(spark, texts, terms, "normalized", max_inline=limit)
    assert out == {0: ["tide"], 1: ["sea", "wave", "x"], 2: ["sea", "wave", "x"], 3: ["sea", "wave", "x"], 4: []}


@pytest.mark.parametrize("limit", [100, 0])
def test_substring_edges(spark, limit):
    out = match(spark, ["Big WAVE-maker ab", "xa bx"], [("w", "wave"), ("s", "a b"), ("o", "b")], "substring", max_inline=limit)
    assert out == {0: ["o", "w"], 1: ["o", "s"]}


@pytest.mark.parametrize("how", ["word", "normalized", "substring"])
def test_plans_agree_and_avoid_nested_loops(spark, how):
    docs = T.articles_from_documents(spark, SMALL)
    inline = M.match_terms(docs, corpus_terms(spark), how=how)
    joined = M.match_terms(docs, corpus_terms(spark), how=how, max_inline=0)
    assert {r.id: r.matched_keywords for r in inline.select("id", "matched_keywords").collect()} == {
        r.id: r.matched_keywords for r in joined.select("id", "matched_keywords").collect()
    }
    for df in (inline, joined):
        text = plan_text(df)
        assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text
    assert "Exchange" not in plan_text(inline.select("id", "matched_keywords"))


def test_empty_dictionary(spark):
    assert match(spark, ["abc"], [("zzzz", "zzzz")], "word") == {0: []}
    df = literal_table(spark, "id int, title string, description string", [(0, "abc", None)])
    none = literal_table(spark, "keyword string, term string", [("a", "ai")])
    assert M.match_terms(df, none, how="word").first().matched_keywords == []


def test_term_table_owners(spark):
    kw = literal_table(spark, "id int, text string, active boolean, expanded_terms array<string>",
                       [(1, "wave", True, ["Ocean", " x "]), (2, "tide", True, ["ocean"]), (3, "off", False, ["gone"])])
    rows = {(r.term, r.keyword) for r in M.term_table(kw, company="Acme").collect()}
    assert rows == {("wave", "wave"), ("tide", "tide"), ("ocean", "wave"), ("ocean", "tide"), ("x", "wave"), ("Acme", "Acme")}
    compat = {r.term: r.keyword for r in M.term_table(kw, compat=True).collect()}
    assert compat["ocean"] == "tide"
    assert ("My Company", "My Company") not in {tuple(r) for r in M.term_table(kw, company="My Company").collect()}


def test_expand_terms(spark):
    kw = literal_table(spark, "keyword string", [("Wave energy",), ("small wave energy plant",), ("solar",), ("ai",)])
    out = {}
    for r in M.expand_terms(kw).collect():
        out.setdefault(r.keyword, set()).add(r.term)
    assert "ocean power" in out["Wave energy"] and "tidal energy" in out["small wave energy plant"]
    assert out["solar"] == {"solar"} and "ai" not in out


def test_route_topics(spark):
    cands = literal_table(spark, "id int, title string, description string, connector string, fetch_priority int", [
        (1, "New wave energy plant", None, "rss", 30), (2, "Offshore news", None, "rss", 90), (3, "Offshore news", None, "rss", 50),
        (4, "wave power only", None, "gdelt", 90), (5, "wave power only", None, "rss", 30)])
    topics = literal_table(spark, "topic_id int, keywords array<string>, sources array<string>", [(1, ["wave energy"], ["rss"]), (2, ["solar"], ["rss"])])
    out = {(r.id, r.topic_id): (r.route, r.matched_keywords) for r in M.route_topics(cands, topics).collect()}
    assert out == {(1, "1"): ("exact", ["wave energy"]), (2, "1"): ("broad", []), (2, "2"): ("broad", []), (5, "1"): ("exact", [])}


def test_fallback(spark):
    df = literal_table(spark, "id int, matched_keywords array<string>", [(1, ["a"]), (2, []), (3, None)])
    out = {r.id: r.matched_keywords for r in M.with_fallback(df, F.lit("q")).collect()}
    assert out == {1: ["a"], 2: ["q"], 3: ["q"]}


def test_bodies_of_repeated_crawls_count_once(spark):
    left = literal_table(spark, "id int, url string, language string, published_at string", [(1, "u", None, None), (2, "v", None, None)])
    left = left.withColumn("published_at", F.col("published_at").cast("timestamp"))
    pages = literal_table(spark, "url string, body_text string, lang string, published_at string", [("u", "wave power", "en", None), ("u", "wave power", "en", "2024-01-02"), ("v", "none", "en", None)])
    pages = pages.withColumn("published_at", F.col("published_at").cast("timestamp"))
    rows = M.match_bodies(left, pages, literal_table(spark, "keyword string, term string", [("w", "wave")])).collect()
    assert [(r.id, r.matched_keywords, r.matched_via, r.language, str(r.published_at)) for r in rows] == [(1, ["w"], "body_scan", "en", "2024-01-02 00:00:00")]


@pytest.mark.parametrize("how", ["word", "normalized", "substring"])
def test_repeated_and_null_keys_keep_their_own_keywords(spark, how):
    frame = literal_table(spark, "id int, title string, description string", [(1, "tidal wave", ""), (1, "solar power", ""), (None, "tidal wave", ""), (None, "nothing", "")])
    words = literal_table(spark, "keyword string, term string", [("t", "tidal"), ("s", "solar"), ("q", "x\\Ey tidal")])
    for limit in (100, 0):
        rows = M.match_terms(frame, words, how=how, max_inline=limit).collect()
        assert sorted((str(r.id), r.title, r.matched_keywords) for r in rows) == [
            ("1", "solar power", ["s"]), ("1", "tidal wave", ["t"]), ("None", "nothing", []), ("None", "tidal wave", ["t"])
        ]


def test_routing_reads_and_matches_the_articles_once(spark):
    docs = T.articles_from_documents(spark, SMALL)
    topics = literal_table(spark, "topic_id int, keywords array<string>, sources array<string>", [(1, ["wave energy"], ["rss"])])
    plan = plan_text(M.route_topics(docs, topics))
    assert len(re.findall(r"FileScan parquet \[[^\]]*text#", plan)) == 1
