"""Filters, joins, exact de-duplication, registry, scores: hand-computed edge rows."""

import pytest
from conftest import SMALL, plan_text
from pyspark.sql import functions as F

from mentionlake.functions.scalars import literal_table
from mentionlake.operators import aggregates as A, dedup, enrich, filters, joins, registry, saved
from mentionlake.sources import sinks, tables as T

NOW = "2024-03-10 00:00:00"


def ts(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in cols})


def ids(df):
    return sorted(r.id for r in df.collect())


def test_language(spark):
    df = literal_table(spark, "id int, language string", [(1, None), (2, "EN-us"), (3, "English"), (4, "zh"), (5, "")])
    assert ids(filters.filter_language(df)) == [1, 2, 5]


def test_blocked(spark):
    df = literal_table(spark, "id int, url string, source_domain string", [
        (1, "https://m.facebook.com/x", "a.com"), (2, "https://news.ok.com/live/x", "ok.com"), (3, "not a url", "ok.com"), (4, "https://ok.com/post/1", None),
        (5, "https://ok.com/a?x=/live/", "ok.com"), (6, "https://ok.com/a", "www.reddit.com"), (7, "https://notfacebook.com/a", None)])
    assert ids(filters.filter_blocked(df)) == [3, 5, 7]


def test_era_edges(spark):
    df = ts(literal_table(spark, "id int, published_at string", [
        (1, "2024-03-03 00:00:00"), (2, "2024-02-09 00:00:00"), (3, None), (4, "2024-04-01"), (5, "2024-03-02 23:59:59"), (6, "2024-02-08")]), "published_at")
    label = {r.id: r.e for r in df.select("id", filters.era(F.col("published_at"), NOW).alias("e")).collect()}
    assert label == {1: "live", 2: "recent", 3: "archive", 4: "live", 5: "recent", 6: "archive"}
    assert ids(filters.filter_era(df, "recent", NOW)) == [2, 5]
    assert ids(filters.filter_era(df, "archive", NOW)) == [6]
    assert ids(filters.filter_recent(df, 30, NOW)) == [1, 2, 3, 4, 5]


def test_visible_and_tiers(spark):
    rows = [(i, d, lab, e) for i, (d, lab, e) in enumerate(
        (d, lab, e) for d in (None, True, False) for lab in (None, "noise", "low", "medium", "high") for e in (True, False))]
    df = literal_table(spark, "id int, is_duplicate boolean, relevance_label string, is_enriched boolean", rows)
    assert ids(filters.visible(df)) == [i for i, d, lab, _ in rows if not d and lab != "noise"]
    assert ids(filters.visible(df, "drop")) == [i for i, d, lab, _ in rows if not d and lab not in ("noise", None)]
    assert ids(filters.filter_relevance(df, "high")) == [i for i, _, lab, e in rows if (lab == "high" or not e) and lab != "noise"]
    assert ids(filters.filter_relevance(df, "medium")) == [i for i, _, lab, e in rows if (lab in ("high", "medium") or not e) and lab != "noise"]
    assert ids(filters.filter_relevance(df, "all")) == [i for i, _, lab, _ in rows if lab != "noise"]


def test_outlets(spark):
    df = literal_table(spark, "id int, source_domain string, source_url string", [
        (1, "microsoft.com", "https://microsoft.com"), (2, "news.bbc.co.uk", "https://www.ft.com/x"), (3, None, None)])
    assert [r.is_major_outlet for r in filters.flag_major(df).orderBy("id").collect()] == [False, True, False]
    assert [r.is_major_outlet for r in filters.flag_major(df, mode="substring").orderBy("id").collect()] == [True, True, False]
    assert [r.is_paywalled for r in filters.flag_paywalled(df).orderBy("id").collect()] == [False, True, False]
    assert [r.is_paywalled for r in filters.flag_paywalled(df, mode="substring").orderBy("id").collect()] == [True, True, False]


def _searchable(spark):
    df = literal_table(spark, "id int, title string, description string, matched_keywords array<string>, source_name string, sentiment string, language string, name string, country_code string", [
        (1, "Wave power", "grows", ["marine"], "A", "positive", "en", "Alpha", "SE"), (2, "Wavelet theory", None, [], "B", "neutral", "fr", None, None),
        (3, "Tidal power", "and waves", [], "B", None, "en", None, None), (4, "Nothing", None, None, "", "negative", "de", None, None)])
    return df.withColumns({"source": F.struct("name", "country_code"), "published_at": F.lit("2024-03-09").cast("timestamp")})


@pytest.mark.parametrize("query,plain,compat", [
    ({"terms": []}, [1, 2, 3, 4], [1, 2, 3, 4]),
    ({"terms": [{"value": "wave", "operator": "OR"}, {"value": "tidal", "operator": "OR"}]}, [1, 2, 3], [3]),
    ({"terms": [{"value": "wave", "operator": "AND", "exact": True}]}, [1], [1, 2, 3]),
    ({"terms": [{"value": "power", "operator": "AND"}, {"value": "tidal", "operator": "NOT"}]}, [1], [1]),
    ({"sources": ["Alpha"]}, [1], [1]), ({"countries": ["SE"]}, [1], [1]), ({"sentiments": ["negative"]}, [4], [4]),
    ({"languages": ["fr"]}, [2], [1, 2, 3, 4]), ({"dateRange": "1d"}, [1, 2, 3, 4], [1, 2, 3, 4]), ({"dateFrom": "2024-03-10"}, [], [1, 2, 3, 4]),
])
def test_search(spark, query, plain, compat):
    import json

    df = _searchable(spark)
    assert ids(filters.search(df, query, NOW)) == plain
    assert ids(filters.search(df, query, NOW, compat=True)) == compat
    stored = literal_table(spark, "search_id int, query string", [(7, json.dumps(query)), (8, json.dumps({"sentiments": ["negative"]}))])
    hits = saved.run_saved_searches(df, stored, NOW, chunk=1).collect()
    assert sorted(r.id for r in hits if r.search_id == 7) == plain
    assert sorted(r.id for r in hits if r.search_id == 8) == [4]


def test_alert_conditions(spark):
    import json

    a = ts(literal_table(spark, "id int, matched_keywords array<string>, sentiment string, source_name string, country string, source_category string, published_at string", [
        (1, ["Wave"], "positive", "A", "SE", "media", "2024-03-01"), (2, [], None, "B", None, "social", "2024-03-02"), (3, None, "negative", None, "NO", None, "2024-03-03")]), "published_at")
    rule = lambda i, cat, **c: (i, "instant", None, cat, True, json.dumps(c))
    rules = literal_table(spark, "rule_id int, rule_type string, digest_schedule string, alert_category string, active boolean, conditions string", [
        rule(1, "media"), rule(2, "media", keywords=["wave"]), rule(3, "media", sentiments=["negative"], countries=["NO"]), rule(4, "social"), rule(5, "media", sources=["B"])])
    out = sorted((r.rule_id, r.id) for r in saved.evaluate_alerts(a, rules).collect())
    assert out == [(1, 1), (1, 3), (2, 1), (3, 3), (4, 2)]


def test_period_edges(spark):
    df = ts(literal_table(spark, "id int, published_at string, sentiment string", [
        (1, "2024-03-03 12:00:00", "positive"), (2, "2024-03-10 00:00:00", None), (3, None, "negative"), (4, "2024-03-03 00:00:00", "negative")]), "published_at")
    daily = {str(r.day): (r.total, r.positive, r.neutral, r.negative) for r in A.daily_volume(df, 7, NOW).collect()}
    assert len(daily) == 7 and "2024-03-03" not in daily and daily["2024-03-10"] == (1, 0, 0, 0) and daily["2024-03-07"] == (0, 0, 0, 0)
    assert A.in_period(df, 7, NOW).count() == 3
    split = {r.sentiment: r.articles for r in A.sentiment_split(df).collect()}
    assert split == {"positive": 1, "negative": 2, "neutral": 1}


def test_source_labels_and_quality(spark):
    df = literal_table(spark, "id int, name string, source_name string, source_url string, sentiment string", [
        (1, "", "X", None, "positive"), (2, None, "", "", "positive"), (3, None, None, None, "positive"), (4, "S", "X", None, None)])
    df = df.withColumn("source", F.struct("name"))
    assert {r.name: r.articles for r in A.top_sources(df).collect()} == {"X": 1, "Unknown": 2, "S": 1}
    q = {r.name: (r.positive_rate, r.tier) for r in A.source_quality(df).collect()}
    assert q == {"X": (100, "High"), "Unknown": (100, "High"), "S": (0, "Low")}
    assert {r.name: r.positive_rate for r in A.source_quality(df, compat=True).collect()}["Unknown"] == 0


def test_topic_alignment(spark):
    df = literal_table(spark, "id int, source_category string, key_themes array<string>, matched_keywords array<string>", [
        (1, "owned", None, ["k"]), (2, "owned", [], ["k"]), (3, "media", ["k", "z"], []), (4, None, None, ["k"])])
    assert [tuple(r) for r in joins.topic_alignment(df).collect()] == [("k", 1, 2)]


def test_share_of_voice_counts_articles_once_per_entity(spark):
    df = ts(literal_table(spark, "id int, title string, description string, published_at string", [
        (1, "Alpha alpha beta", None, "2024-03-09"), (2, "beta", "BETA", "2024-03-08"), (3, "alpha", None, "2024-03-01"), (4, "alpha", None, None)]), "published_at")
    out = [tuple(r) for r in A.share_of_voice(df, {"A": ["alpha"], "B": ["beta"], "C": ["none"]}, 7, NOW).collect()]
    assert out == [("B", 2, 0, 67, 0, "flat"), ("A", 1, 1, 33, 0, "flat"), ("C", 0, 0, 0, 0, "flat")]


def test_exact_dedup(spark):
    df = literal_table(spark, "id int, url string, title string, topic_id int", [
        (2, "https://e.com/a?utm_source=x", "T", 1), (1, "https://e.com/a/", "T", 2), (3, "", "T", 1), (4, None, "t!", 1), (5, "https://e.com/a?utm_source=x", "U", 2)])
    first = dedup.dedup_first(df, [F.col("id").asc()])
    assert ids(first) == [1, 2]
    once = dedup.dedup_canonical(df.filter("url <> ''"), [F.col("id").asc()])
    assert ids(once) == [1] and ids(dedup.dedup_canonical(once.drop("canonical_url"), [F.col("id").asc()])) == [1]
    assert ids(dedup.dedup_title(df, [F.col("id").asc()])) == [1, 5]
    assert ids(dedup.purge_exact(df)) == [1, 2, 3, 4, 5]
    assert ids(dedup.purge_exact(df.withColumn("url", F.regexp_replace("url", r"\?.*", "")))) == [1, 3, 4, 5]
    assert "WindowGroupLimit" in plan_text(first)


def test_resolve_source_ties(spark):
    cands = literal_table(spark, "id int, source_domain string", [(1, "www.E.com"), (2, "other.org")])
    src = literal_table(spark, "id int, domain string, active boolean, fetch_priority int", [(1, "e.com", True, 30), (2, "https://www.e.com/x", True, 90), (3, "e.com", True, 50), (4, "e.com", False, 100)])
    got = lambda tie: {r.id: r.source_id for r in joins.resolve_source(cands, src, tie).collect()}
    assert got("max_priority") == {1: 2, 2: None} and got("first") == {1: 1, 2: None} and got("last") == {1: 3, 2: None}


def test_retention(spark):
    a = ts(literal_table(spark, "id int, published_at string", [(1, "2024-01-01"), (2, "2024-03-01"), (3, None)]), "published_at")
    child = literal_table(spark, "article_id int, tag string", [(1, "x"), (2, "y"), (3, "z")])
    out = joins.apply_retention({"articles": a, "tags": child}, 30, NOW)
    assert ids(out["articles"]) == [2, 3] and sorted(r.tag for r in out["tags"].collect()) == ["y", "z"]


def test_registry_rules(spark):
    df = literal_table(spark, "name string, domain string, region string", [
        ("Reuters", "reuters.com", None), ("reNEWS", "renews.biz", None), ("Wave Weekly", "w.com", None), ("X", "y.com", None),
        ("Daily Press", "dp.com", None), ("Hello", "avis.se", None), ("Hej", "h.com", "Europe"), ("TechWire", "t.com", None)])
    got = [(r.a, r.b) for r in df.select(registry.source_priority(F.col("name"), F.col("domain")).alias("a"),
           registry.source_priority(F.col("name"), F.col("domain"), F.col("region"), "keyword").alias("b")).collect()]
    assert got == [(100, 30), (90, 50), (50, 30), (30, 30), (30, 100), (30, 70), (30, 60), (30, 90)]


def test_health(spark):
    src = ts(literal_table(spark, "id int, consecutive_failures int, health_status string, last_success_at string", [
        (1, 3, "degraded", None), (2, 0, "healthy", None), (3, 19, "degraded", None), (4, 1, "healthy", None)]), "last_success_at")
    out = ts(literal_table(spark, "source_id int, ok boolean, at string", [(1, True, "2024-03-02"), (1, False, "2024-03-01"), (2, False, "2024-03-01"), (3, False, "2024-03-01")]), "at")
    got = {r.id: (r.consecutive_failures, r.health_status) for r in A.update_health(src, out).collect()}
    assert got == {1: (0, "healthy"), 2: (1, "degraded"), 3: (20, "error"), 4: (1, "healthy")}
    late = {r.id: r.health_status for r in A.update_health(src, out, degraded_at=5).collect()}
    assert late[2] == "healthy"


def test_upsert_ignore_is_idempotent(spark, tmp_path):
    df = ts(literal_table(spark, "id int, url string, published_at string", [(1, "a", "2024-03-01"), (2, "a", "2024-03-02"), (3, "b", None), (4, "", "2024-03-01")]), "published_at")
    target, order = str(tmp_path / "t"), [F.col("id").asc()]
    assert sinks.upsert_ignore(target, df, order=order) == 2
    assert sinks.upsert_ignore(target, df, order=order) == 0
    assert ids(spark.read.parquet(target)) == [1, 3]


def test_upsert_merge_and_updates(spark):
    t = literal_table(spark, "k int, a string, b string", [(1, "x", "x"), (2, "y", "y")])
    n = literal_table(spark, "k int, a string, b string", [(2, "Y", "Z"), (3, "n", "m")])
    assert sorted(tuple(r) for r in sinks.upsert_merge(t, n, ["k"], ["a"]).collect()) == [(1, "x", "x"), (2, "Y", "y"), (3, "n", "m")]
    u = literal_table(spark, "id int, a string, v int", [(2, "old", 1), (2, "new", 2), (9, "no", 1)])
    base = literal_table(spark, "id int, a string, v int", [(1, "x", 0), (2, "y", 0)])
    assert sorted(tuple(r) for r in sinks.apply_updates(base, u, order=[F.col("v").desc()]).collect()) == [(1, "x", 0), (2, "new", 2)]


def test_export_quotes(spark, tmp_path):
    df = literal_table(spark, "title string, source_name string, language string, sentiment string, matched_keywords array<string>, url string", [('He said "x", y', None, None, None, ["a", "b"], "u")])
    df = df.withColumns({"source": F.lit(None).cast("struct<name:string,country_code:string>"), "published_at": F.lit("2024-03-01").cast("timestamp")})
    sinks.export_csv(df, str(tmp_path / "out"), "archive")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text == '"Title","Source","Date","Sentiment","Keywords","URL"\n"He said ""x"", y","","2024-03-01","","a; b","u"\n'


def test_scores(spark):
    a = literal_table(spark, "batch int, index int, title string", [(0, 0, "a"), (0, 1, "b")])
    s = literal_table(spark, "batch int, index int, sentiment string, sentiment_score double, importance string, confidence double, matched_reason string, primary_entity string, ai_summary string",
                      [(0, 1, "positive", 0.9, "high", 0.8, "r", "e", "s")])
    out = {r.title: (r.sentiment, r.sentiment_score, r.importance) for r in enrich.merge_scores(a, s, ("batch", "index"), enrich.BY_INDEX_DEFAULTS).collect()}
    assert out == {"a": ("neutral", 0.5, "medium"), "b": ("positive", 0.9, "high")}
    replies = literal_table(spark, "reply string", [('```json\n[{"id": "7", "relevance_score": 0.9, "key_themes": ["t"]}]\n```',), ("no json",), (None,)])
    assert [(r.id, r.relevance_score, r.key_themes) for r in enrich.parse_score_reply(replies).collect()] == [("7", 0.9, ["t"])]


def test_page_and_feed_order(spark):
    df = ts(literal_table(spark, "id int, is_enriched boolean, published_at string, fetched_at string", [
        (1, None, "2024-03-09", "2024-03-09"), (2, True, None, "2024-03-05"), (3, True, "2024-03-01", "2024-03-09")]), "published_at", "fetched_at")
    assert [r.id for r in filters.order_feed(df).collect()] == [2, 3, 1]
    row = filters.page(filters.order_feed(df), 1, 2).collect()
    assert [(r.id, r.total_pages) for r in row] == [(1, 2)]


def test_pushdown_reaches_the_scan(spark):
    a = T.articles_from_events(spark, SMALL)
    text = plan_text(A.sentiment_split(a.filter(F.col("user_id") == 5)))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,5)]" in text and "ReadSchema: struct<user_id:bigint,event_type:string>" in text


def test_saved_searches_keep_rules_that_share_an_id_at_a_page_border(spark):
    def query(value):
        return '{"terms": [{"id": "1", "value": "%s", "operator": "%s", "exact": true}]}' % value

    rules = [(1, query(("tide", "AND"))), (1, query(("wave", "other"))), (1, query(("wave", "other"))), (2, query((r"a\\Eb", "AND")))]
    frame = literal_table(spark, "search_id int, query string", rules)
    ddl = "id int, title string, description string, source_name string, sentiment string, language string, published_at timestamp, source struct<name:string,country_code:string>, matched_keywords array<string>"
    a = spark.createDataFrame([(i, t, "", None, None, "en", None, None, None) for i, t in ((7, "tide"), (8, "wave"), (9, "x a\\Eb"))], ddl)
    for chunk in (1, 2, 100):
        assert sorted(tuple(r) for r in saved.run_saved_searches(a, frame, "2024-01-31 00:00:00", chunk).collect()) == [(1, 7), (1, 8), (2, 9)]
