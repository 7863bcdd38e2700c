"""Queries over acquisition: feeds, sitemaps, pages, payloads, imports, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from mentionlake.functions.scalars import literal_table
from mentionlake.functions import dates as D, text as X
from mentionlake.operators import filters
from mentionlake.plans import ingest
from mentionlake.plans.oracle_base import AS_OF as SQL_NOW, sql
from mentionlake.plans.queries_match import READABLE, _strip, _normal
from mentionlake.session import shared_path
from mentionlake.sources import feeds, owned, pages as P, payloads, sitemaps, sinks, tables as T

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


def _stamp(c: str = "published_at"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


_SQL_STAMP = "strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at"
_TRIM = "trim(title)"


# --- feeds ---------------------------------------------------------------------
@query("ingest_feeds", sql("docs", f"""SELECT id, {_TRIM} AS title, url, {_SQL_STAMP}, source_name, source_domain, country_code AS country, source_name AS author,
  'about ' || id AS description FROM docs WHERE {_TRIM} <> '' AND published_at >= {SQL_NOW} - INTERVAL 7 DAY"""))
def ingest_feeds(s, d):
    out = feeds.ingest_feeds(T.raw_feeds(s, d), T.sources(s, d), NOW)
    return out.select(F.col("guid").cast("bigint").alias("id"), "title", "url", _stamp(), "source_name", "source_domain", "country", "author", "description")


@query("ingest_search_feed", sql("doc", f"""SELECT {_TRIM} AS title, url, CASE id % 3 WHEN 0 THEN 'Reuters' WHEN 1 THEN 'El País' ELSE 'Paper ' || source_name END AS source_name,
  CASE id % 3 WHEN 0 THEN 'reuters.com' WHEN 1 THEN 'elpais.com' ELSE source_domain END AS source_domain, {_SQL_STAMP} FROM doc WHERE {_TRIM} <> ''"""))
def ingest_search_feed(s, d):
    return feeds.ingest_search_feed(T.raw_feeds(s, d, publisher=True)).select("title", "url", "source_name", "source_domain", _stamp())


@query("discovery_items", sql("doc", f"""SELECT {_strip('trim(title)')} AS title, replace(url, '?utm_source=feed', '') AS url, 'about ' || id AS snippet, {_SQL_STAMP}, source_domain
  FROM doc WHERE {_TRIM} <> ''"""))
def discovery_items(s, d):
    return feeds.discovery_items(T.raw_feeds(s, d), NOW).select("title", "url", "snippet", _stamp(), "source_domain")


@query("scheduled_ingest", sql("doc", f"""SELECT url, id, CAST(topic_id AS VARCHAR) AS topic_id, era FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_id, pos, CAST(id AS VARCHAR), CAST(topic_id AS VARCHAR)) AS rn FROM (
  SELECT doc.id, url, source_id, (id % 400) // 20 AS pos, t.topic_id,
    CASE WHEN published_at >= {SQL_NOW} - INTERVAL 7 DAY THEN 'live' ELSE 'recent' END AS era FROM doc JOIN t ON list_contains(t.sources, 'rss')
  WHERE {_TRIM} <> '' AND published_at >= {SQL_NOW} - INTERVAL 7 DAY
    AND len(list_filter(t.keywords, lambda k: regexp_matches(lower(trim(title) || ' about ' || id), '(^|[^A-Za-z0-9_])' || k || '($|[^A-Za-z0-9_])'))) > 0)) WHERE rn = 1""",
  t="SELECT * FROM (VALUES (1, ['of', 'that', 'with'], ['rss']), (2, ['from', 'this'], ['rss', 'gdelt'])) v(topic_id, keywords, sources)").replace("['of', 'that', 'with']", "['that', 'with']"))
def scheduled_ingest(s, d):
    topics = literal_table(s, "topic_id int, keywords array<string>, sources array<string>", [(1, ["of", "that", "with"], ["rss"]), (2, ["from", "this"], ["rss", "gdelt"])])
    raw = T.raw_feeds(s, d)
    out = ingest.scheduled_ingest(raw, T.sources(s, d), topics, None, NOW)
    return out.select("url", F.col("guid").cast("bigint").alias("id"), "topic_id", F.col("articles_era").alias("era"))


# --- sitemaps --------------------------------------------------------------------
_SLUG = "trim(regexp_replace(regexp_extract(url, '([^/?]+)(\\?[^/]*)?$', 1), '[-_]+', ' ', 'g'))"
_SM_TITLE = f"substr({_strip(f'CASE WHEN id % 2 = 0 AND trim(title) <> {chr(39)}{chr(39)} THEN trim(title) ELSE {_SLUG} END')}, 1, 220)"


@query("sitemap_items", sql("doc", f"""SELECT source_domain AS domain, {_SM_TITLE} AS title, replace(url, '?utm_source=feed', '') AS url,
  strftime(published_at, '%Y-%m-%d') AS day FROM doc"""))
def sitemap_items(s, d):
    out = sitemaps.sitemap_items(T.raw_sitemaps(s, d), NOW)
    return out.select("domain", "title", "url", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


@query("sitemap_harvest", sql("doc", """SELECT source_domain AS domain, replace(url, '?utm_source=feed', '') AS url FROM doc"""))
def sitemap_harvest(s, d):
    domains = T.sources(s, d).select("domain", F.when(F.col("id") % 2 == 0, 90).otherwise(40).alias("priority"))
    return sitemaps.ingest_sitemaps(T.raw_sitemaps(s, d), domains, NOW, keep="first").select("domain", "url")


@query("sitemap_locations", sql("pg", """SELECT domain, CAST(position AS BIGINT) AS position, u[position + 1] AS url FROM (SELECT domain, u, unnest(range(0, len(u))) AS position FROM (
  SELECT domain, CASE WHEN contains(domain, 'th') THEN ['https://' || domain || '/robots-map.xml', 'https://' || domain || '/news-sitemap.xml', 'https://' || domain || '/sitemap.xml', 'https://' || domain || '/sitemap_index.xml']
    ELSE ['https://' || domain || '/sitemap.xml', 'https://' || domain || '/news-sitemap.xml', 'https://' || domain || '/sitemap_index.xml'] END AS u
  FROM (SELECT DISTINCT source_domain AS domain FROM pg)))"""))
def sitemap_locations(s, d):
    domains = T.candidates_from_pages(s, d).select(F.col("source_domain").alias("domain")).distinct()
    body = F.concat(F.lit("User-agent: *\r\nSITEMAP:  https://"), "domain", F.lit("/robots-map.xml \r\nSitemap: https://"), "domain", F.lit("/news-sitemap.xml\nDisallow: /x"))
    robots = domains.filter(F.contains("domain", F.lit("th"))).select("domain", body.alias("body"))
    out = sitemaps.sitemap_locations(domains.withColumn("sitemap_url", F.lit(None).cast("string")), robots)
    return out.select("domain", F.col("position").cast("bigint").alias("position"), "url")


# --- pages ---------------------------------------------------------------------
_DAY = "lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0')"


@query("extract_pages", sql("pg", f"""SELECT id AS page_id, url, CASE WHEN id % 4 = 1 THEN 'https://canonical.example.com/p/' || id ELSE canon END AS canonical_url, source_domain AS domain,
  lower(split_part(regexp_extract(html, '(?i)<html[^>]+lang=["'']([^"'']+)["'']', 1), '-', 1)) AS lang,
  CASE id % 4 WHEN 0 THEN '2024-01-' || {_DAY} || ' 10:00:00' WHEN 2 THEN '2024-01-' || {_DAY} || ' 00:00:00' END AS published_at,
  length({READABLE}) AS n_chars, md5({READABLE}) AS body_md5 FROM pg"""))
def extract_pages(s, d):
    out = P.extract_pages(T.annotated_pages(s, d), NOW)
    n = F.length("body_text").cast("bigint")
    return out.select("page_id", "url", "canonical_url", "domain", "lang", _stamp(), n.alias("n_chars"), F.md5("body_text").alias("body_md5"))


_ANCHOR = "(?is)<a[^>]+href=[\"''](https?://[^\"'']+)[\"''][^>]*>(.*?)</a>"


@query("harvest_links", sql("pg", f"""SELECT page, CAST(position AS BIGINT) AS position, substr({_strip('t')}, 1, 220) AS title, u AS url FROM l WHERE length({_strip('t')}) >= 6""",
  l=f"""SELECT page, unnest(range(0, len(u))) AS position, unnest(u) AS u, unnest(t) AS t FROM (SELECT page, regexp_extract_all(h, '{_ANCHOR}', 1) AS u,
    regexp_extract_all(h, '{_ANCHOR}', 2) AS t FROM (SELECT url AS page, id, replace(html, 'href="/', 'href="' || regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/2024/05/') AS h FROM pg))"""))
def harvest_links(s, d):
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    p = T.read(s, d, "pages").withColumn("html", F.replace("html", F.lit('href="/'), F.concat(F.lit('href="'), base, F.lit("/2024/05/"))))
    out = P.harvest_links(p, NOW, min_text=6, key="page_id").join(p.select("page_id", F.col("url").alias("page_url")), F.col("page") == F.col("page_id"))
    return out.select(F.col("page_url").alias("page"), F.col("position").cast("bigint").alias("position"), "title", "url")


@query("classify_documents", sql("pg doc", """SELECT source_type, feed_kind, n_preview, count(*) AS documents FROM (
  SELECT CASE WHEN id % 4 = 3 THEN 'rss' ELSE 'html' END AS source_type, CASE WHEN id % 4 = 3 THEN 'feed.xml' ELSE 'site' END AS feed_kind, 0 AS n_preview FROM pg
  UNION ALL SELECT CASE WHEN chunk % 2 = 0 THEN 'rss' ELSE 'atom' END, 'self', least(n, 5) FROM (SELECT source_id, id // 400 AS chunk, count(*) FILTER (trim(title) <> '') AS n FROM doc GROUP BY 1, 2)
  UNION ALL SELECT 'sitemap', 'self', least(n, 5) FROM (SELECT source_id, id // 400 AS chunk, count(*) AS n FROM doc GROUP BY 1, 2)
  UNION ALL SELECT DISTINCT ON (source_id, id // 8000) 'sitemap', 'self', 0 FROM doc) GROUP BY 1, 2, 3"""))
def classify_documents(s, d):
    pages = T.annotated_pages(s, d).select("url", F.col("html").alias("body"))
    bodies = T.raw_feeds(s, d).select(F.concat(F.lit("https://"), "source_domain", F.lit("/feed")).alias("url"), "body")
    maps = T.raw_sitemaps(s, d).select("url", "body")
    out = P.classify_documents(pages.unionByName(bodies).unionByName(maps))
    kind = F.when(F.endswith("feed_url", F.lit("/feed.xml")), "feed.xml").when(F.col("feed_url") == F.col("url"), "self").otherwise("site")
    return out.groupBy("source_type", kind.alias("feed_kind"), F.size("preview").alias("n_preview")).agg(F.count(F.lit(1)).alias("documents"))


@query("import_blog", sql("pg", f"""SELECT url, substr(body, 1, 300) AS description, array_to_string(list_filter(['ment', 'tion', 'Hest'], lambda t: contains(lower(body), lower(t))), '|') AS themes
  FROM (SELECT url, {READABLE} AS body FROM pg) WHERE (contains(lower(url), '/blog') OR contains(lower(url), '/news') OR contains(lower(url), '/post')) AND body <> ''"""))
def import_blog(s, d):
    content = P.extract_pages(T.read(s, d, "pages"), NOW).select("url", F.col("body_text").alias("content"))
    out = P.import_blog(content, ["ment", "tion", "Hest"])
    return out.select("url", "description", F.array_join("key_themes", "|").alias("themes"))


@query("discovery", sql("pg", """SELECT u.id, coalesce(t.keywords, bm.keywords) AS keywords, CASE WHEN t.id IS NOT NULL THEN 'title_snippet' ELSE 'body_scan' END AS matched_via, src.lo AS source_id FROM
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY id) AS rn FROM pg WHERE NOT regexp_matches(canon, '/(live|video)/')) WHERE rn = 1
    AND canon NOT IN (SELECT canon FROM pg WHERE contains(url, '/es/'))) u LEFT JOIN t USING (id) LEFT JOIN bm USING (id)
  LEFT JOIN (SELECT source_domain, min(id) AS lo FROM pg GROUP BY 1) src ON src.source_domain = u.source_domain WHERE t.id IS NOT NULL OR bm.id IS NOT NULL""",
  terms="SELECT * FROM (VALUES ('hent', 'hent'), ('anble', 'anble'), ('ment', 'ment')) v(keyword, term)",
  hay=f"SELECT id, {_normal(chr(34) + 't' + chr(34))} AS n FROM (SELECT id, title || '  ' || url AS t FROM pg)",
  t="SELECT id, array_to_string(list_sort(list(DISTINCT keyword)), '|') AS keywords FROM hay JOIN terms ON contains(hay.n, terms.term) GROUP BY id",
  bm=f"""SELECT b.id, array_to_string(list_sort(list(DISTINCT keyword)), '|') AS keywords FROM (SELECT id, {_normal('body')} AS n FROM (SELECT id, {READABLE} AS body FROM pg)) b
    JOIN terms ON contains(b.n, terms.term) GROUP BY b.id"""))
def discovery(s, d):
    cands = T.candidates_from_pages(s, d)
    known = cands.filter(F.contains("url", F.lit("/es/"))).select("url")
    terms = literal_table(s, "keyword string, term string", [("hent", "hent"), ("anble", "anble"), ("ment", "ment")])
    src = cands.select("id", F.col("source_domain").alias("domain"), F.lit(True).alias("active"), F.lit(30).alias("fetch_priority"))
    out = ingest.discovery(cands, P.extract_pages(T.read(s, d, "pages"), NOW), terms, src, known, NOW)
    return out.select("id", F.array_join("matched_keywords", "|").alias("keywords"), "matched_via", "source_id")


# --- payloads -------------------------------------------------------------------
_DOC_FILTER = "WHERE title <> ''"


def _articles_json(s, d, item, wrap: str):
    """Replies with one item each; ``wrap`` is the path of the item array."""
    a = T.articles_from_documents(s, d)
    reply = F.array(item(a))
    for part in reversed(wrap.split(".")):
        reply = F.struct(reply.alias(part))
    return a.select(F.to_json(reply).alias("payload"))


@query("payload_perigon", sql("doc", f"SELECT title, url, substr(description, 1, 50) AS description, source_domain, source_name, {_SQL_STAMP}, language FROM doc {_DOC_FILTER} AND language <> 'es'"))
def payload_perigon(s, d):
    raw = _articles_json(s, d, lambda a: F.struct(
        "title", "url", F.when(F.col("id") % 2 == 0, F.substring("description", 1, 50)).alias("description"), F.substring("description", 1, 50).alias("summary"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("pubDate"), "language",
        F.struct(F.col("source_name").alias("name"), F.when(F.col("language") != "es", F.col("source_domain")).alias("domain")).alias("source")), "articles")
    out = payloads.normalize_payload(raw, "perigon", NOW)
    return out.select("title", "url", "description", "source_domain", "source_name", _stamp(), "language")


@query("payload_guardian", sql("doc", f"SELECT title, url, 'GB' AS country, 'The Guardian' AS source_name, {_SQL_STAMP}, 'guardian-uk' AS ingestion_source FROM doc"))
def payload_guardian(s, d):
    raw = _articles_json(s, d, lambda a: F.struct(
        F.col("url").alias("webUrl"), F.col("title").alias("webTitle"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("webPublicationDate")), "response.results")
    out = payloads.normalize_payload(raw, "guardian", NOW)
    return out.select("title", "url", "country", "source_name", _stamp(), "ingestion_source")


@query("payload_gdelt", sql("doc", f"SELECT title, url, source_domain, {_SQL_STAMP} FROM doc {_DOC_FILTER}"))
def payload_gdelt(s, d):
    raw = _articles_json(s, d, lambda a: F.struct(
        "title", "url", F.col("source_domain").alias("domain"), F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'").alias("seendate")), "articles")
    return payloads.normalize_payload(raw, "gdelt", NOW).select("title", "url", "source_domain", _stamp())


@query("payload_newsapi", sql("doc", f"""SELECT title, url, source_domain AS source_name, {_SQL_STAMP}, contains(lower(title), 'ment') AS hit FROM doc
  {_DOC_FILTER} AND id % 10 <> 0 AND regexp_matches(lower(title), '(^|[^A-Za-z0-9_])(that|with)($|[^A-Za-z0-9_])')"""))
def payload_newsapi(s, d):
    from mentionlake.operators.matching import match_terms

    raw = _articles_json(s, d, lambda a: F.struct(
        F.when(F.col("id") % 10 == 0, "[Removed]").otherwise(F.col("title")).alias("title"), "url", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt")), "articles")
    rows = payloads.normalize_payload(raw, "newsapi", NOW)
    terms = literal_table(s, "keyword string, term string", [("that", "that"), ("with", "with")])
    out = match_terms(rows, terms, how="word", key="url").filter(F.size("matched_keywords") > 0)
    return out.select("title", "url", "source_name", _stamp(), F.contains(F.lower("title"), F.lit("ment")).alias("hit"))


@query("payload_web_search", sql("pg", """SELECT canon AS url, substr(title, 1, 220) AS title, source_domain, CASE WHEN id % 2 = 0 THEN '2024-01-05 00:00:00' END AS published_at, 'kw' AS fallback
  FROM pg WHERE NOT regexp_matches(canon, '/(live|video)/')"""))
def payload_web_search(s, d):
    c = T.candidates_from_pages(s, d)
    item = F.struct("url", "title", F.struct(F.when(F.col("id") % 2 == 0, "2024-01-05").alias("article:published_time")).alias("metadata"))
    raw = c.select(F.to_json(F.struct(F.array(item).alias("data"))).alias("payload"), F.lit("kw").alias("query_keyword"))
    out = payloads.normalize_payload(raw, "web_search", NOW)
    return out.select("url", "title", "source_domain", _stamp(), F.col("query_keyword").alias("fallback"))


_POST = "split_part(text, chr(10), 1)"


@query("payload_reddit", f"""SELECT {_POST} AS title, 'https://www.reddit.com/r/c' || conv_id || '/' || turn AS url, substr(text, 1, 300) || CASE WHEN length(text) > 300 THEN '…' ELSE '' END AS description,
  'r/c' || conv_id AS source_name, '2024-01-10 00:00:00' AS published_at, CAST(turn AS INTEGER) AS engagement_score, 0 AS comment_count FROM conversations WHERE {_POST} <> ''""")
def payload_reddit(s, d):
    c = T.read(s, d, "conversations")
    sub = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    post = F.struct(F.struct(
        X.first_line(F.col("text")).alias("title"), F.concat(F.lit("/r/"), sub, F.lit("/"), F.col("turn").cast("string")).alias("permalink"), F.col("text").alias("selftext"),
        sub.alias("subreddit"), F.col("role").alias("author"), F.lit(1704844800.0).alias("created_utc"), F.col("turn").cast("int").alias("score")).alias("data"))
    raw = c.select(F.to_json(F.struct(F.struct(F.array(post).alias("children")).alias("data"))).alias("payload"))
    out = payloads.normalize_payload(raw, "reddit", NOW)
    return out.select("title", "url", "description", "source_name", _stamp(), "engagement_score", "comment_count")


@query("payload_youtube", f"""SELECT {_POST} AS title, 'https://www.youtube.com/watch?v=v' || conv_id || '-' || turn AS url, substr(text, 1, 300) AS description, 'role ' || role AS source_name
  FROM conversations WHERE {_POST} <> ''""")
def payload_youtube(s, d):
    c = T.read(s, d, "conversations")
    vid = F.concat(F.lit("v"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    item = F.struct(F.struct(vid.alias("videoId")).alias("id"), F.struct(
        X.first_line(F.col("text")).alias("title"), F.col("text").alias("description"), F.concat(F.lit("role "), "role").alias("channelTitle")).alias("snippet"))
    raw = c.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))
    return payloads.normalize_payload(raw, "youtube", NOW).select("title", "url", "description", "source_name")


# --- owned exports ----------------------------------------------------------------
def _export_lines(s, d):
    """One export per day of events: a note line, a header line, one line per event."""
    e = T.read(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.floor("value").cast("bigint").alias("v"))
    day, daily = F.date_format("ts", "yyyy-MM-dd"), F.dayofmonth("ts") % 2 == 1
    n = lambda c: F.col(c).cast("string")
    post = F.concat(F.lit('"Post ""'), "event_type", F.lit('"", no. '), n("event_id"), F.lit('",https://l.example.com/'), n("event_id"), F.lit(","), day, F.lit(","), n("v"), F.lit(",3,,"), n("user_id"), F.lit(",x"))
    total = F.concat(day, F.lit(","), n("v"), F.lit(",1,2,3,4"))
    rows = e.select(day.alias("file"), F.lit(0).cast("bigint").alias("block"), (F.col("event_id") + 2).alias("line_id"), F.when(daily, total).otherwise(post).alias("line"))
    days = e.select(day.alias("file"), daily.alias("daily")).distinct()
    head = F.when(F.col("daily"), "Date,Impressions (total),Clicks (total),Reactions (total),Comments (total),Reposts (total)").otherwise(
        "Post title,Post link,Posted on,Impressions,Clicks,Reposts,Likes,Comments")
    lines = F.array(F.struct(F.lit(0).cast("bigint").alias("line_id"), F.lit("Page export; all times UTC").alias("line")), F.struct(F.lit(1).cast("bigint").alias("line_id"), head.alias("line")))
    heads = days.select("file", F.lit(0).cast("bigint").alias("block"), F.inline(lines))
    return heads.unionByName(rows)


@query("owned_export", """SELECT CASE WHEN odd THEN 'LinkedIn Daily Metrics — ' || day ELSE 'Post "' || event_type || '", no. ' || event_id END AS title,
  CASE WHEN odd THEN 'linkedin-daily-' || day ELSE 'https://l.example.com/' || event_id END AS url, CAST(floor(value) AS INTEGER) AS impressions,
  CASE WHEN odd THEN 1 ELSE 3 END AS clicks, CASE WHEN odd THEN 4 ELSE 0 END AS shares, CASE WHEN odd THEN 2 ELSE CAST(user_id AS INTEGER) END AS engagement_score,
  CASE WHEN odd THEN 3 ELSE 0 END AS comment_count, day || ' 00:00:00' AS published_at
  FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day, day(ts) % 2 = 1 AS odd FROM events)""")
def owned_export(s, d):
    out = owned.owned_articles(owned.owned_rows(_export_lines(s, d)))
    return out.select("title", "url", "impressions", "clicks", "shares", "engagement_score", "comment_count", _stamp())


# --- sinks ------------------------------------------------------------------------
@query("upsert_ignore", sql("doc", """SELECT 'first' AS run, count(DISTINCT url) AS inserted FROM doc WHERE language = 'en' UNION ALL
  SELECT 'second', count(DISTINCT url) FROM doc WHERE url NOT IN (SELECT url FROM doc WHERE language = 'en') UNION ALL SELECT 'again', 0
  UNION ALL SELECT 'stored', count(DISTINCT url) FROM doc"""))
def upsert_ignore(s, d):
    a = T.articles_from_documents(s, d).select("id", "url", "language", "published_at")
    target = shared_path(s, "articles")
    order = [F.col("id").asc()]
    counts = [("first", sinks.upsert_ignore(target, a.filter("language = 'en'"), order=order)),
              ("second", sinks.upsert_ignore(target, a, order=order)), ("again", sinks.upsert_ignore(target, a, order=order))]
    stored = s.read.parquet(target).agg(F.lit("stored").alias("run"), F.count(F.lit(1)).alias("inserted"))
    return literal_table(s, "run string, inserted bigint", counts).unionByName(stored)
