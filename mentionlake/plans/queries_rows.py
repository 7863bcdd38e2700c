"""Queries over filters, joins, user data, registry and stored searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from mentionlake.functions.scalars import literal_table
from mentionlake.functions import text as X
from mentionlake.operators import dedup, enrich, filters, joins, matching, registry, saved
from mentionlake.plans import report
from mentionlake.plans.oracle_base import AS_OF as SQL_NOW, pct, sql
from mentionlake.sources import tables as T
from mentionlake.sources.payloads import union_connectors
from mentionlake.sources.registry_files import import_registry
from mentionlake.sources.sinks import apply_updates, upsert_merge

NOW = T.AS_OF
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def _doc(s, d):
    return joins.with_source(T.articles_from_documents(s, d), T.sources(s, d))


# --- filters ----------------------------------------------------------------
@query("language_filter", sql("doc", "SELECT id, language FROM doc WHERE language IN ('en', 'de', 'es')"))
def language_filter(s, d):
    return filters.filter_language(T.articles_from_documents(s, d), ["en", "de", "es"]).select("id", "language")


_HOSTS = ["example.org", "ththth.example.net"]


@query("blocked_filter", sql("pg", """SELECT id, url FROM pg WHERE NOT (source_domain LIKE '%.example.org' OR source_domain = 'example.org'
  OR source_domain = 'ththth.example.net' OR source_domain LIKE '%.ththth.example.net') AND NOT regexp_matches(url, '^https?://[^/?#]+/(fr/1|de/)')"""))
def blocked_filter(s, d):
    return filters.filter_blocked(T.candidates_from_pages(s, d), _HOSTS, ["^/fr/1", "^/de/"]).select("id", "url")


@query("blocked_variants", """SELECT doc_id AS id, host NOT IN ('x.com', 'm.youtube.com') AND NOT contains(path, '/watch/') AS model, host = 'ok.example.com' AS backfill
  FROM (SELECT doc_id, ['x.com', 'm.youtube.com', 'ok.example.com'][doc_id % 3 + 1] AS host, ['/a', '/watch/1', '/b?u=/watch/2'][doc_id % 7 % 3 + 1] AS path FROM documents)""")
def blocked_variants(s, d):
    i = F.col("doc_id")
    host = F.get(F.array(*map(F.lit, ("x.com", "m.youtube.com", "ok.example.com"))), (i % 3).cast("int"))
    path = F.get(F.array(*map(F.lit, ("/a", "/watch/1", "/b?u=/watch/2"))), (i % 7 % 3).cast("int"))
    rows = T.read(s, d, "documents").select(i.alias("id"), F.concat(F.lit("https://"), host, path).alias("url"))

    def passes(variant: str):
        hosts, paths, whole_url = filters.BLOCK_VARIANTS[variant]
        return ~filters.is_blocked(F.col("url"), None, hosts, paths, whole_url)

    # m.youtube.com is a sub-domain of a listed host in both lists.
    return rows.select("id", passes("model").alias("model"), passes("backfill").alias("backfill"))


@query("recent_filter", sql("doc", f"SELECT id FROM doc WHERE published_at >= {SQL_NOW} - INTERVAL 30 DAY"))
def recent_filter(s, d):
    return filters.filter_recent(T.articles_from_documents(s, d), 30, NOW).select("id")


@query("era_counts", sql("doc", f"""SELECT CASE WHEN published_at >= {SQL_NOW} - INTERVAL 7 DAY THEN 'live' WHEN published_at >= {SQL_NOW} - INTERVAL 30 DAY THEN 'recent'
  ELSE 'archive' END AS era, count(*) AS articles FROM doc GROUP BY 1"""))
def era_counts(s, d):
    return T.articles_from_documents(s, d).groupBy(filters.era(F.col("published_at"), NOW).alias("era")).agg(F.count(F.lit(1)).alias("articles"))


@query("era_screen", sql("doc", f"SELECT id FROM doc WHERE published_at >= {SQL_NOW} - INTERVAL 30 DAY AND published_at < {SQL_NOW} - INTERVAL 7 DAY"))
def era_screen(s, d):
    return filters.filter_era(T.articles_from_documents(s, d), "recent", NOW).select("id")


@query("visible_feed", sql("doc", """SELECT 'keep' AS mode, relevance_label, count(*) AS articles FROM doc WHERE coalesce(is_duplicate, false) = false AND coalesce(relevance_label, '') <> 'noise' GROUP BY 2
  UNION ALL SELECT 'drop', relevance_label, count(*) FROM doc WHERE coalesce(is_duplicate, false) = false AND relevance_label <> 'noise' GROUP BY 2"""))
def visible_feed(s, d):
    out = None
    for mode in ("keep", "drop"):
        part = filters.visible(T.articles_from_documents(s, d), mode).groupBy("relevance_label").agg(F.count(F.lit(1)).alias("articles"))
        part = part.withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query("relevance_tier", sql("doc", """SELECT 'high' AS tier, id FROM doc WHERE (relevance_label = 'high' OR NOT is_enriched) AND coalesce(relevance_label, '') <> 'noise'
  UNION ALL SELECT 'medium', id FROM doc WHERE (relevance_label IN ('high', 'medium') OR NOT is_enriched) AND coalesce(relevance_label, '') <> 'noise'"""))
def relevance_tier(s, d):
    a = T.articles_from_documents(s, d)
    part = lambda t: filters.filter_relevance(a, t).select(F.lit(t).alias("tier"), "id")
    return part("high").unionByName(part("medium"))


@query("major_flag", sql("pg", """SELECT id, source_domain, source_domain = 'ththth.example.net' OR source_domain LIKE '%.ththth.example.net' OR source_domain = 'com' OR source_domain LIKE '%.com' AS is_major_outlet,
  contains(source_domain, 'th.example.net') AS loose FROM pg"""))
def major_flag(s, d):
    c = T.candidates_from_pages(s, d)
    strict = filters.flag_major(c, ["ththth.example.net", "com"])
    return strict.select("id", "source_domain", "is_major_outlet", filters.major_flag(F.col("source_domain"), ["th.example.net"], "substring").alias("loose"))


@query("paywall_flag", sql("reg", "SELECT seq, domain, domain IN ('reuters.com', 'renews.biz') AS is_paywalled FROM reg"))
def paywall_flag(s, d):
    return filters.flag_paywalled(T.registry(s, d), ["reuters.com", "renews.biz"], column="domain").select("seq", "domain", "is_paywalled")


@query("quick_search", sql("doc", "SELECT id FROM doc WHERE contains(lower(title), 'ment') OR contains(lower(description), 'hent')"))
def quick_search(s, d):
    a = T.articles_from_documents(s, d)
    return filters.quick_search(a, "MENT", ["title"]).select("id").unionByName(filters.quick_search(a, "hent", ["description"]).select("id")).distinct()


_SEARCH = {
    "terms": [{"value": "the", "operator": "OR", "exact": True}, {"value": "que", "operator": "OR", "exact": False},
              {"value": "kw", "operator": "AND", "exact": False}, {"value": "hent", "operator": "NOT", "exact": False}],
    "sources": [], "countries": ["NATION_1", "NATION_2", "NATION_3", "NATION_5"], "languages": ["en", "fr"], "sentiments": ["positive", "neutral"], "dateRange": "30d",
}
_TXT = "lower(title || ' ' || description || ' ' || array_to_string(matched_keywords, ' '))"


@query("boolean_search", sql("docs", f"""SELECT id FROM docs WHERE (regexp_matches({_TXT}, '(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') OR contains({_TXT}, 'que'))
  AND contains({_TXT}, 'kw') AND NOT contains({_TXT}, 'hent') AND country_code IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_5') AND language IN ('en', 'fr')
  AND sentiment IN ('positive', 'neutral') AND published_at >= {SQL_NOW} - INTERVAL 30 DAY"""))
def boolean_search(s, d):
    return filters.search(_doc(s, d), _SEARCH, NOW).select("id")


@query("boolean_search_compat", sql("docs", f"""SELECT id FROM docs WHERE contains({_TXT}, 'the') AND contains({_TXT}, 'que') AND contains({_TXT}, 'kw')
  AND NOT contains({_TXT}, 'hent') AND country_code IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_5') AND sentiment IN ('positive', 'neutral')
  AND published_at >= {SQL_NOW} - INTERVAL 30 DAY"""))
def boolean_search_compat(s, d):
    return filters.search(_doc(s, d), _SEARCH, NOW, compat=True).select("id")


@query("date_ranges", sql("doc", f"""SELECT '1d' AS range, count(*) AS articles FROM doc WHERE published_at >= {SQL_NOW} - INTERVAL 1 DAY
  UNION ALL SELECT '7d', count(*) FROM doc WHERE published_at >= {SQL_NOW} - INTERVAL 7 DAY
  UNION ALL SELECT '3m', count(*) FROM doc WHERE published_at >= {SQL_NOW} - INTERVAL 3 MONTH
  UNION ALL SELECT 'days', count(*) FROM doc WHERE published_at >= TIMESTAMP '2024-01-05' AND published_at <= TIMESTAMP '2024-01-20 23:59:59'"""))
def date_ranges(s, d):
    a, ts = T.articles_from_documents(s, d), F.col("published_at")
    conds = {n: filters.date_range_condition(ts, n, NOW) for n in ("1d", "7d", "3m")}
    conds["days"] = filters.between_dates(ts, "2024-01-05", "2024-01-20")
    one = a.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in conds.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("range"), F.col(n).alias("articles")) for n in conds])))


@query("keyword_filter", sql("ev", "SELECT id FROM ev WHERE list_has_any(matched_keywords, ['kw3', 'kw7'])"))
def keyword_filter(s, d):
    return filters.filter_keywords(T.articles_from_events(s, d), ["KW3", "kw7"]).select("id")


@query("favourites", sql("doc", """SELECT id FROM doc WHERE matched_keywords[1] IN ('kw3', 'hent') OR contains(lower(title || ' ' || description), 'kw3')
  OR contains(lower(title || ' ' || description), 'hent') ORDER BY published_at DESC, id LIMIT 10"""))
def favourites(s, d):
    return filters.favourites(T.articles_from_documents(s, d), ["Kw3", "hent"]).select("id")


@query("eligible_sources", sql("src", """SELECT id, name, CAST(fetch_priority AS INTEGER) AS fetch_priority FROM src WHERE active AND approval_status = 'approved'
  AND consecutive_failures < 30 AND health_status IN ('healthy', 'degraded') ORDER BY fetch_priority DESC, id"""))
def eligible_sources(s, d):
    return filters.eligible_sources(T.sources(s, d)).select("id", "name", "fetch_priority")


@query("priority_tier", sql("reg", "SELECT seq FROM reg WHERE priority >= 70"))
def priority_tier(s, d):
    return filters.tier(T.registry(s, d), low=70).select("seq")


@query("off_topic_purge", sql("doc", """SELECT id FROM doc WHERE NOT (NOT regexp_matches(lower(title), 'hent|of the') AND regexp_matches(lower(title), 'tion|ment'))"""))
def off_topic_purge(s, d):
    return filters.purge_off_topic(T.articles_from_documents(s, d), ["hent", "of the"], ["tion", "ment"]).select("id")


@query("term_hygiene", """SELECT doc_id AS id, array_to_string(list_filter(string_split(split_part(text, chr(10), 1), ' '),
  lambda t: regexp_matches(t, '^[a-zA-Z0-9 \\-/.,()]+$') AND NOT regexp_matches(split_part(text, chr(10), 1), '[\\x{4e00}-\\x{9fff}]')), '|') AS terms FROM documents""")
def term_hygiene(s, d):
    kw = T.read(s, d, "documents").select(F.col("doc_id").alias("id"), F.split(X.first_line(F.col("text")), " ").alias("expanded_terms"))
    return filters.clean_terms(kw).select("id", F.array_join("expanded_terms", "|").alias("terms"))


@query("registry_filter", sql("reg", """SELECT seq, name FROM reg WHERE region = (SELECT r_name FROM region WHERE r_regionkey = 1) AND language = 'en'
  AND (contains(lower(name), 'supplier') OR contains(lower(domain), 'reuters'))"""))
def registry_filter(s, d):
    region = T.read(s, d, "region").filter("r_regionkey = 1").select("r_name").scalar()
    rows = T.registry(s, d).filter(F.col("region") == region)
    return filters.filter_registry(rows, language="en", q="supplier").select("seq", "name")


_REPAIR = """SELECT id, CASE WHEN id % 5 = 0 THEN 'a,b,c,d' WHEN id % 5 = 1 THEN 'x&#160;y' ELSE 'plain' END AS snippet,
  CASE id % 4 WHEN 0 THEN title || ' - Reuters' WHEN 1 THEN title || ' - Nature' WHEN 2 THEN title || ' - Local-Paper' ELSE title END AS title,
  CASE WHEN id % 3 = 0 THEN 'news.google.com' WHEN id % 3 = 1 THEN '' ELSE source_domain END AS source_domain,
  CASE WHEN id % 2 = 0 THEN '' ELSE 'BBC' END AS source_name, url, CASE WHEN id % 7 = 0 THEN 'sitemap' ELSE 'rss' END AS discovery_method FROM doc"""
_REPAIR2 = """SELECT id, replace(title, '&#160;', ' ') AS title, snippet, discovery_method,
  coalesce(nullif(source_domain, ''), regexp_replace(regexp_replace(url, '^https?://(www\\.)?', ''), '(?s)/.*$', '')) AS dom, source_name,
  regexp_matches(replace(title, '&#160;', ' '), '(?s)^.* - [^-]+$') AS suf,
  trim(regexp_extract(replace(title, '&#160;', ' '), '(?s)^(.*) - ([^-]+)$', 2)) AS pub,
  trim(regexp_extract(replace(title, '&#160;', ' '), '(?s)^(.*) - ([^-]+)$', 1)) AS head FROM r0"""
_REPAIR3 = """SELECT *, CASE WHEN dom = 'news.google.com' AND suf AND source_name = '' THEN pub ELSE source_name END AS name FROM r1"""
_REPAIR4 = """SELECT *, CASE WHEN dom = 'news.google.com' THEN CASE name WHEN 'Reuters' THEN 'reuters.com' WHEN 'Nature' THEN 'nature.com'
  WHEN 'BBC' THEN 'bbc.co.uk' ELSE dom END ELSE dom END AS fdom FROM r2"""


@query("repair_articles", sql("doc", """SELECT id, CASE WHEN fdom = 'news.google.com' AND suf AND title = head || ' - ' || pub THEN head ELSE title END AS title,
  CASE WHEN discovery_method = 'sitemap' AND snippet = 'a,b,c,d' THEN NULL ELSE replace(snippet, '&#160;', ' ') END AS snippet, fdom AS source_domain,
  name AS source_name, CASE WHEN dom = 'news.google.com' AND name IN ('Reuters', 'Nature', 'BBC') THEN true END AS is_major_outlet FROM r3""",
  r0=_REPAIR, r1=_REPAIR2, r2=_REPAIR3, r3=_REPAIR4))
def repair_articles(s, d):
    i = F.col("id")
    suffix = F.when(i % 4 == 0, " - Reuters").when(i % 4 == 1, " - Nature").when(i % 4 == 2, " - Local-Paper").otherwise("")
    broken = T.articles_from_documents(s, d).select(
        "id", "url", F.concat("title", suffix).alias("title"),
        F.when(i % 5 == 0, "a,b,c,d").when(i % 5 == 1, "x&#160;y").otherwise("plain").alias("snippet"),
        F.when(i % 3 == 0, "news.google.com").when(i % 3 == 1, "").otherwise(F.col("source_domain")).alias("source_domain"),
        F.when(i % 2 == 0, "").otherwise("BBC").alias("source_name"),
        F.when(i % 7 == 0, "sitemap").otherwise("rss").alias("discovery_method"), F.lit(None).cast("boolean").alias("is_major_outlet"),
    )
    return filters.repair_articles(broken).select("id", "title", "snippet", "source_domain", "source_name", "is_major_outlet")


# --- scores, enrichment, retention --------------------------------------------
@query("merge_scores", """SELECT d.doc_id AS id, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN quality = 1 THEN 0.9::DOUBLE ELSE 0.2::DOUBLE END END, 0.5::DOUBLE) AS relevance_score,
  CASE WHEN l.doc_id IS NULL THEN 'medium' WHEN quality = 1 THEN 'high' ELSE 'low' END AS relevance_label,
  CASE WHEN l.doc_id IS NULL THEN 'neutral' WHEN toxic = 1 THEN 'negative' ELSE 'positive' END AS sentiment,
  CASE WHEN quality = 1 THEN 'good' ELSE '' END AS themes FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def merge_scores(s, d):
    from mentionlake.functions.scalars import band_label

    score = F.when(F.col("quality") == 1, 0.9).otherwise(0.2)
    scores = T.read(s, d, "labels").select(
        F.col("doc_id").alias("id"), score.alias("relevance_score"), band_label(score).alias("relevance_label"), F.lit("label").alias("relevance_reason"),
        F.when(F.col("toxic") == 1, "negative").otherwise("positive").alias("sentiment"), F.lit(0.1).alias("sentiment_score"),
        F.when(F.col("quality") == 1, F.array(F.lit("good"))).otherwise(F.array().cast("array<string>")).alias("key_themes"),
    )
    base = T.articles_from_documents(s, d).select("id", "title")
    out = enrich.merge_scores(base, scores)
    return out.select("id", "relevance_score", "relevance_label", "sentiment", F.array_join("key_themes", ",").alias("themes"))


@query("accepted_candidates", sql("doc", "SELECT id FROM doc WHERE relevance_label IN ('high', 'medium') AND relevance_score >= 0.4::DOUBLE"))
def accepted_candidates(s, d):
    a = T.articles_from_documents(s, d).withColumn("relevant", F.col("relevance_label").isin("high", "medium"))
    return filters.accept(a, 0.4).select("id")


@query("enrichment", """SELECT d.doc_id AS id, CASE WHEN l.quality = 1 AND d.doc_id % 2 = 0 THEN 'Writer ' || (d.doc_id % 9) END AS author_name,
  l.doc_id IS NULL AS pending FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def enrichment(s, d):
    i = F.col("doc_id")
    cached = T.read(s, d, "labels").select(
        i.alias("article_id"), F.when((F.col("quality") == 1) & (i % 2 == 0), F.concat(F.lit("Writer "), (i % 9).cast("string"))).otherwise("").alias("author_name"),
        F.lit(None).cast("string").alias("author_email"), F.lit(None).cast("string").alias("author_url"),
    )
    base = T.articles_from_documents(s, d).select("id")
    todo = enrich.pending_enrichment(base, cached).withColumn("pending", F.lit(True))
    named = enrich.apply_enrichment(base, cached).select("id", "author_name")
    return named.join(todo, "id", "left").withColumn("pending", F.coalesce("pending", F.lit(False)))


@query("retention", sql("doc", f"""SELECT 'articles' AS part, count(*) AS n FROM doc WHERE published_at >= {SQL_NOW} - INTERVAL 30 DAY
  UNION ALL SELECT 'bookmarks', count(*) FROM b WHERE article_id NOT IN (SELECT id FROM doc WHERE published_at < {SQL_NOW} - INTERVAL 30 DAY)""",
  b="SELECT DISTINCT user_id, event_id % 1000 AS article_id FROM events WHERE event_type = 'purchase'"))
def retention(s, d):
    kept = joins.apply_retention({"articles": T.articles_from_documents(s, d), "bookmarks": T.bookmarks(s, d)}, 30, NOW)
    count = lambda name: kept[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count("articles").unionByName(count("bookmarks"))


# --- user data ----------------------------------------------------------------
@query("annotated_feed", sql("doc", """SELECT doc.id, b.article_id IS NOT NULL AS is_bookmarked, coalesce(t.n, 0) AS tag_count, coalesce(n.n, 0) AS note_count, n.latest AS latest_note
  FROM doc LEFT JOIN (SELECT DISTINCT event_id % 1000 AS article_id FROM events WHERE event_type = 'purchase' AND user_id = 5) b ON b.article_id = doc.id
  LEFT JOIN (SELECT event_id % 1000 AS article_id, count(DISTINCT event_id % 7) AS n FROM events WHERE event_type = 'click' AND user_id = 5 GROUP BY 1) t ON t.article_id = doc.id
  LEFT JOIN (SELECT event_id % 1000 AS article_id, count(*) AS n, arg_max('note ' || event_id, ts) AS latest FROM events WHERE event_type = 'error' AND user_id = 5 GROUP BY 1) n ON n.article_id = doc.id"""))
def annotated_feed(s, d):
    out = joins.with_annotations(T.articles_from_documents(s, d).select("id"), T.bookmarks(s, d), T.tags(s, d), T.notes(s, d), 5)
    return out


@query("annotation_rows", """SELECT DISTINCT event_id % 1000 AS article_id, 'tag' AS kind, 'tag' || (event_id % 7) AS value FROM events WHERE event_type = 'click' AND user_id = 8
  UNION ALL SELECT event_id % 1000, 'note', 'note ' || event_id FROM events WHERE event_type = 'error' AND user_id = 8""")
def annotation_rows(s, d):
    return joins.annotation_rows(T.tags(s, d), T.notes(s, d), 8)


@query("toggled_bookmarks", """SELECT user_id, article_id FROM (SELECT DISTINCT user_id, event_id % 1000 AS article_id FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT user_id, event_id % 1000 FROM events WHERE event_type = 'view') GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def toggled_bookmarks(s, d):
    views = T.read(s, d, "events").filter(F.col("event_type") == "view").select("user_id", (F.col("event_id") % 1000).alias("article_id"))
    return joins.toggle_bookmarks(T.bookmarks(s, d), views)


@query("saved_only", sql("doc", "SELECT id FROM doc WHERE id IN (SELECT event_id % 1000 FROM events WHERE event_type = 'purchase' AND user_id = 5)"))
def saved_only(s, d):
    return joins.saved_only(T.articles_from_documents(s, d), T.bookmarks(s, d), 5).select("id")


# --- keywords -----------------------------------------------------------------
@query("expand_terms", """SELECT kw AS keyword, count(*) AS terms FROM (SELECT DISTINCT kw, unnest(CASE WHEN contains(lower(kw), 'ation') AND contains(lower(kw), 'th') THEN [kw, 'alpha', 'beta', 'gamma']
  WHEN contains(lower(kw), 'ation') THEN [kw, 'alpha', 'beta'] WHEN contains(lower(kw), 'th') THEN [kw, 'beta', 'gamma'] ELSE [kw] END) AS t
  FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS kw FROM benchmark))
  WHERE t NOT IN ('wec', 'ev', 'ai', 'llm', 'ccs', 'ccus') GROUP BY 1""")
def expand_terms(s, d):
    words = T.read(s, d, "benchmark").select(F.explode(F.split("text", " ")).alias("keyword")).distinct()
    out = matching.expand_terms(words, {"ation": ["alpha", "beta"], "th": ["beta", "gamma"]})
    return out.groupBy("keyword").agg(F.count(F.lit(1)).alias("terms"))


@query("term_table", """SELECT term, keyword FROM (SELECT trim(name) AS term, name AS keyword FROM k UNION SELECT lower(trim(x)), name FROM k, unnest(exp) u(x)
  UNION SELECT 'Acme', 'Acme') WHERE length(term) > 0""".replace("FROM k", "FROM (SELECT 'item ' || item_id AS name, string_split(text, ' ')[1:6] AS exp FROM benchmark) k"))
def term_table(s, d):
    kw = T.read(s, d, "benchmark").select(
        F.col("item_id").alias("id"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("text"), F.lit(True).alias("active"),
        F.slice(F.split("text", " "), 1, 6).alias("expanded_terms"),
    )
    return matching.term_table(kw, company="Acme").select("term", "keyword")


@query("merge_expansions", """SELECT item_id AS id, array_to_string(list_sort(list_distinct(CASE WHEN item_id % 3 = 0 THEN ['kept'] ELSE
  list_filter(list_transform(string_split(text, ' '), lambda t: lower(trim(t))), lambda t: length(t) > 1 AND t <> 'item ' || item_id) END)), ',') AS terms FROM benchmark""")
def merge_expansions(s, d):
    b = T.read(s, d, "benchmark")
    name = F.concat(F.lit("item "), F.col("item_id").cast("string"))
    kw = b.select(F.col("item_id").alias("id"), name.alias("text"), F.when(F.col("item_id") % 3 == 0, F.array(F.lit("kept"))).alias("expanded_terms"))
    proposals = b.select(F.upper(name).alias("keyword"), F.split("text", " ").alias("terms"))
    return joins.merge_expansions(kw, proposals).select("id", F.array_join(F.array_sort("expanded_terms"), ",").alias("terms"))


@query("new_suggestions", """SELECT DISTINCT w AS keyword FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark)
  WHERE lower(w) NOT IN (SELECT lower(x) FROM (SELECT unnest(string_split(split_part(text, chr(10), 1), ' ')) AS x FROM documents))""")
def new_suggestions(s, d):
    words = T.read(s, d, "benchmark").select(F.explode(F.split("text", " ")).alias("keyword")).distinct()
    known = T.read(s, d, "documents").select(F.explode(F.split(X.first_line(F.col("text")), " ")).alias("text"))
    return joins.new_suggestions(words, known)


@query("match_counts", sql("doc", """SELECT kw.name AS text, kw.base + coalesce(n, 0) AS match_count FROM (SELECT 'kw' || i AS name, i AS base FROM range(12) t(i)) kw
  LEFT JOIN (SELECT matched_keywords[1] AS name, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM doc) WHERE rn = 1 GROUP BY 1) m USING (name)"""))
def match_counts(s, d):
    from mentionlake.operators.aggregates import update_match_counts

    a = T.articles_from_documents(s, d)
    kw = s.range(12).select(F.concat(F.lit("kw"), F.col("id").cast("string")).alias("text"), F.col("id").alias("match_count"))
    return update_match_counts(kw, dedup.dedup_first(a, [F.col("id").asc()])).select("text", "match_count")


@query("group_share", sql("ev", """SELECT g AS group_id, 'group ' || g AS group_name, count(*) AS keywords, CAST(sum(coalesce(n, 0)) AS BIGINT) AS hits
  FROM (SELECT i, 'kw' || i AS name, unnest([i % 3, 3 + i % 2]) AS g FROM range(12) t(i)) k
  LEFT JOIN (SELECT kw AS name, count(*) AS n FROM (SELECT unnest(matched_keywords) AS kw FROM ev) GROUP BY 1) h USING (name) GROUP BY 1"""))
def group_share(s, d):
    ids = s.range(12).select("id", F.concat(F.lit("kw"), F.col("id").cast("string")).alias("text"))
    member = ids.select("id", F.explode(F.array(F.col("id") % 3, F.col("id") % 2 + 3)).alias("group_id"))
    groups = member.groupBy("group_id").agg(F.collect_list("id").alias("keyword_ids")).withColumn("name", F.concat(F.lit("group "), F.col("group_id").cast("string")))
    return saved.group_share(T.articles_from_events(s, d), ids, groups)


# --- registry -----------------------------------------------------------------
_TOP = "contains(lower(name), 'energy') OR contains(lower(name), 'renew') OR contains(lower(name), 'ocean') OR contains(lower(name), 'wave') OR contains(lower(name), 'tidal') OR contains(lower(name), 'marine') OR contains(lower(name), 'hydrogen') OR contains(lower(domain), 'energy')"
_PRIO = f"CASE WHEN domain = 'reuters.com' THEN 100 WHEN domain = 'renews.biz' THEN 90 WHEN {_TOP} THEN 50 ELSE 30 END"


@query("registry_priority", sql("reg", f"""SELECT seq, {_PRIO} AS curated, CASE WHEN contains(lower(name), 'press') THEN 100 WHEN contains(lower(name), 'tech') THEN 80
  WHEN contains(lower(region), 'europe') THEN 60 WHEN contains(lower(name), 'energy') OR contains(lower(domain), 'renew') THEN 50 ELSE 30 END AS keyword FROM reg"""))
def registry_priority(s, d):
    n, dom, r = F.col("name"), F.col("domain"), F.col("region")
    return T.registry(s, d).select(
        "seq", registry.source_priority(n, dom).alias("curated"), registry.source_priority(n, dom, r, "keyword").alias("keyword")
    )


_REGSRC = """SELECT seq, name, domain, 'https://feeds.example.com/' || seq AS rss_url, active FROM reg WHERE feed_url IS NOT NULL AND approval_status = 'approved'"""


@query("registry_sync", sql("reg", f"""SELECT coalesce(s.rss_url, u.rss_url) AS rss_url, coalesce(u.domain, s.domain) AS domain,
  (u.domain IS NOT NULL OR s.active) AND coalesce(u.domain, s.domain) NOT IN (SELECT domain FROM last WHERE approval_status <> 'approved' AND old_status = 'approved') AS active,
  coalesce(u.p, 30) AS fetch_priority FROM src0 s FULL OUTER JOIN up u ON u.rss_url = s.rss_url""",
  src0=_REGSRC,
  chg="""SELECT *, approval_status AS old_status, CASE WHEN approval_status = 'approved' THEN 'pending' ELSE 'approved' END AS new_status FROM reg WHERE seq % 5 = 0 OR seq % 50 = 7""",
  last="""SELECT seq, name, domain, feed_url, old_status, new_status AS approval_status FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq DESC) AS rn FROM chg) WHERE rn = 1""",
  up=f"""SELECT rss_url, domain, {_PRIO} AS p FROM (SELECT *, row_number() OVER (PARTITION BY rss_url ORDER BY seq DESC) AS rn FROM (
    SELECT *, coalesce(feed_url, 'https://' || domain || '/rss') AS rss_url FROM last WHERE approval_status = 'approved')) WHERE rn = 1"""))
def registry_sync(s, d):
    r = T.registry(s, d)
    src = r.filter("feed_url IS NOT NULL AND approval_status = 'approved'").select(
        F.col("seq").cast("string").alias("id"), "name", "domain", F.col("feed_url").alias("rss_url"), "source_type", "country_code", "region", "language",
        "active", "approval_status", F.lit("healthy").alias("health_status"), F.lit(0).alias("consecutive_failures"), F.lit(30).alias("fetch_priority"),
    )
    flipped = F.when(F.col("approval_status") == "approved", "pending").otherwise("approved")
    changes = r.filter("seq % 5 = 0 OR seq % 50 = 7").withColumn("old_status", F.col("approval_status")).withColumn("approval_status", flipped)
    return registry.sync_registry(changes, src).select("rss_url", "domain", "active", "fetch_priority")


@query("registry_import", sql("reg", """SELECT domain, name, country_code, language, source_type, 'pending' AS approval_status, active FROM (
  SELECT domain, min(name) AS name, 'US' AS country_code, 'en' AS language, 'rss' AS source_type, true AS active FROM reg WHERE seq % 2 = 0 GROUP BY 1)
  WHERE domain NOT IN (SELECT domain FROM reg WHERE seq % 3 = 0)"""))
def registry_import(s, d):
    r = T.registry(s, d)
    rows = r.filter("seq % 2 = 0").select(
        "name", "domain", F.lit("").alias("country_code"), F.lit(None).cast("string").alias("region"), F.lit("").alias("language"),
        F.lit(None).cast("string").alias("source_type"), F.lit("").alias("feed_url"), F.lit(None).cast("string").alias("active"),
    )
    out = import_registry(rows, r.filter("seq % 3 = 0"))
    return out.select("domain", "name", "country_code", "language", "source_type", "approval_status", "active")


@query("upsert_merge", sql("reg", """SELECT seq, CASE WHEN seq % 4 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN seq % 6 = 1 THEN 0 ELSE priority END AS priority FROM reg"""))
def upsert_merge_query(s, d):
    r = T.registry(s, d).select("seq", "name", F.col("priority").cast("bigint").alias("priority"))
    target = r.filter("seq % 6 <> 1")
    new = r.filter("seq % 4 = 0").withColumn("name", F.upper("name")).unionByName(
        r.filter("seq % 6 = 1 AND seq % 4 <> 0").withColumn("priority", F.lit(0).cast("bigint")))
    return upsert_merge(target, new, ["seq"], ["name"])


@query("apply_updates", sql("doc", "SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE title END AS title FROM doc WHERE id % 2 = 0"))
def apply_updates_query(s, d):
    a = T.articles_from_documents(s, d).select("id", "title", "published_at")
    batch = a.filter("id % 3 = 0").withColumn("title", F.lit("new"))
    return apply_updates(a.filter("id % 2 = 0"), batch).select("id", "title")


@query("union_connectors", sql("doc", """SELECT connector, CASE connector WHEN 'rss' THEN 0 WHEN 'gdelt' THEN 1 ELSE 2 END AS connector_rank, count(*) AS n FROM doc GROUP BY 1, 2"""))
def union_connectors_query(s, d):
    a = T.articles_from_documents(s, d)
    parts = {c: a.filter(F.col("connector") == c).select("id", "url", *(["title"] if c != "gdelt" else [])) for c in ("gdelt", "newsapi", "rss")}
    return union_connectors(parts).groupBy("connector", "connector_rank").agg(F.count(F.lit(1)).alias("n"))


# --- stored searches and alerts --------------------------------------------------
def _searches(s, d):
    """One stored search per region key: its nations' articles mentioning a word."""
    n = T.read(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("nations"))
    q = F.to_json(F.struct(
        F.array(F.struct(F.lit("ment").alias("value"), F.lit("AND").alias("operator"), F.lit(False).alias("exact"))).alias("terms"),
        F.col("nations").alias("countries"), F.lit("30d").alias("dateRange"),
    ))
    return n.select(F.col("n_regionkey").alias("search_id"), q.alias("query"))


@query("saved_searches", sql("docs", f"""SELECT n.n_regionkey AS search_id, docs.id FROM docs JOIN nation n ON n.n_name = docs.country_code
  WHERE contains({_TXT}, 'ment') AND published_at >= {SQL_NOW} - INTERVAL 30 DAY"""))
def saved_searches(s, d):
    return saved.run_saved_searches(_doc(s, d), _searches(s, d), NOW)


def alert_rules(s, d):
    """One rule per source: negative or keyworded mentions of it."""
    i = F.col("id")
    cond = F.to_json(F.struct(
        F.when(i % 2 == 0, F.array(F.concat(F.lit("KW"), (i % 12).cast("string")))).otherwise(F.array().cast("array<string>")).alias("keywords"),
        F.when(i % 3 == 0, F.array(F.lit("negative"))).otherwise(F.array().cast("array<string>")).alias("sentiments"),
        F.array(F.concat(F.lit("feed-"), (i % 7).cast("string"))).alias("sources"), F.array().cast("array<string>").alias("countries"),
    ))
    return T.sources(s, d).select(
        i.alias("rule_id"), F.when(i % 2 == 0, "digest").otherwise("instant").alias("rule_type"),
        F.when(i % 4 == 0, "daily").when(i % 4 == 2, "weekly").alias("digest_schedule"),
        F.when(i % 5 == 0, "social").otherwise("media").alias("alert_category"), (i % 9 != 8).alias("active"), cond.alias("conditions"),
    )


ALERT_SQL = """SELECT r.id AS rule_id, CASE WHEN r.id % 2 = 0 THEN 'digest' ELSE 'instant' END AS rule_type,
  CASE WHEN r.id % 4 = 0 THEN 'daily' WHEN r.id % 4 = 2 THEN 'weekly' END AS schedule, e.id, e.published_at FROM src r JOIN ev e
  ON (r.id % 5 = 0) = (e.source_category = 'social') AND e.source_name = 'feed-' || (r.id % 7)
  AND (r.id % 2 <> 0 OR list_contains(e.matched_keywords, 'kw' || (r.id % 12))) AND (r.id % 3 <> 0 OR e.sentiment = 'negative') WHERE r.id % 9 <> 8"""


@query("alerts_batch", sql("ev src", "SELECT rule_id, rule_type, schedule, id FROM (" + ALERT_SQL + ")"))
def alerts_batch(s, d):
    return saved.evaluate_alerts(T.articles_from_events(s, d), alert_rules(s, d)).select("rule_id", "rule_type", "schedule", "id")


@query("report_templates", sql("docs", f"""SELECT t.region AS template_id, e.entity, e.mentions, {pct('mentions', 'sum(mentions) OVER (PARTITION BY t.region)')} AS share FROM
  (SELECT 1 AS region UNION ALL SELECT 2) t JOIN (SELECT 1 AS region, * FROM e1 UNION ALL SELECT 2, * FROM e2) e USING (region)""",
  f1=f"SELECT lower(title || ' ' || description) AS txt FROM docs WHERE published_at >= {SQL_NOW} - INTERVAL 30 DAY AND language = 'en'",
  f2=f"SELECT lower(title || ' ' || description) AS txt FROM docs WHERE published_at >= {SQL_NOW} - INTERVAL 30 DAY AND sentiment = 'positive'",
  **{f"e{k}": " UNION ALL ".join(f"SELECT '{n}' AS entity, count(*) FILTER ({' OR '.join(f'''contains(txt, '{x}')''' for x in t)}) AS mentions FROM f{k}" for n, t in T.ENTITIES.items()) for k in (1, 2)}))
def report_templates(s, d):
    templates = literal_table(s, "template_id int, filters string", [(1, '{"languages": ["en"]}'), (2, '{"sentiments": ["positive"]}')])
    out = report.run_reports(_doc(s, d), templates, T.ENTITIES, 30, NOW).filter("section = 'share_of_voice'")
    return out.select(
        "template_id", F.col("label").alias("entity"), F.substring_index("value", " ", 1).cast("bigint").alias("mentions"),
        F.regexp_extract("value", r"\((\d+)%\)", 1).cast("bigint").alias("share"),
    )
