"""Queries over counts, trends, shares and rankings, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from mentionlake.functions import dates as D
from mentionlake.functions.scalars import trend_dir, trend_pct
from mentionlake.operators import aggregates as A, filters, joins
from mentionlake.plans import report
from mentionlake.plans.ingest import insight_period
from mentionlake.plans.oracle_base import AS_OF as SQL_NOW, pct, sql, trend
from mentionlake.sources import tables as T
from mentionlake.sources.sinks import export_rows

NOW = T.AS_OF
COORDS = {f"NATION_{i}": (i * 5.0 - 60.0, i * 2.0 - 20.0) for i in range(15)}


def _ev(s, d):
    return joins.with_source(T.articles_from_events(s, d), T.sources(s, d))


def _doc(s, d):
    return joins.with_source(T.articles_from_documents(s, d), T.sources(s, d))


def _day(df, column="day"):
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd"))


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


# --- share of voice: the flagship -----------------------------------------
def _hit(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


_ENT = " UNION ALL ".join(
    f"SELECT '{n}' AS entity, count(*) FILTER (cur AND {_hit('txt', t)}) AS mentions, count(*) FILTER (prev AND {_hit('txt', t)}) AS prev_mentions FROM two"
    for n, t in T.ENTITIES.items()
)
_TWO = f"""SELECT lower(coalesce(title, '') || ' ' || coalesce(description, '')) AS txt, published_at >= {SQL_NOW} - INTERVAL 30 DAY AS cur,
  published_at >= {SQL_NOW} - INTERVAL 60 DAY AND published_at < {SQL_NOW} - INTERVAL 30 DAY AS prev FROM doc WHERE published_at >= {SQL_NOW} - INTERVAL 60 DAY"""
_P, _D = trend("mentions", "prev_mentions")


@query("share_of_voice", sql("doc", f"""SELECT entity, mentions, prev_mentions, {pct('mentions', '(SELECT sum(mentions) FROM n)')} AS share,
  {_P} AS trend_pct, {_D} AS trend_dir FROM n""", two=_TWO, n=_ENT))
def share_of_voice(s, d):
    return A.share_of_voice(T.articles_from_documents(s, d), T.ENTITIES, 30, NOW)


@query("sov_daily", sql("doc", f"""SELECT strftime(spine.day, '%Y-%m-%d') AS day, {', '.join(f'coalesce({n}, 0) AS {n}' for n in T.ENTITIES)}
  FROM spine LEFT JOIN c ON c.day = spine.day""",
  spine=f"SELECT CAST(unnest(generate_series(DATE '2024-01-31' - 89, DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day",
  c=f"""SELECT CAST(published_at AS DATE) AS day, {', '.join(f"count(*) FILTER {_hit('txt', t)} AS {n}" for n, t in T.ENTITIES.items())}
  FROM (SELECT published_at, lower(title || ' ' || description) AS txt FROM doc WHERE published_at >= {SQL_NOW} - INTERVAL 90 DAY) GROUP BY 1"""))
def sov_daily(s, d):
    return _day(A.sov_daily(T.articles_from_documents(s, d), T.ENTITIES, 90, NOW))


# --- counts and KPIs --------------------------------------------------------
@query("headline_counts", sql("ev", f"""SELECT count(*) FILTER (published_at >= {SQL_NOW} - INTERVAL 1 DAY) AS today,
  count(*) FILTER (published_at >= {SQL_NOW} - INTERVAL 7 DAY) AS week, count(*) AS total,
  count(*) FILTER (published_at < {SQL_NOW} - INTERVAL 30 DAY) AS archive FROM ev"""))
def headline_counts(s, d):
    return A.headline_counts(T.articles_from_events(s, d), NOW)


_T1, _T1D = trend("total", "prev_total")
_T2, _T2D = trend("positive", "prev_positive")
_T3, _T3D = trend("brand", "prev_brand")


@query("period_kpis", sql("docs", f"""SELECT total, {_T1} AS total_pct, {_T1D} AS total_dir, {pct('positive', 'total')} AS positive_share,
  {_T2} AS positive_pct, {_T2D} AS positive_dir, unique_sources, brand, {_T3} AS brand_pct, {_T3D} AS brand_dir FROM k""",
  two=f"""SELECT *, published_at >= {SQL_NOW} - INTERVAL 30 DAY AS cur, published_at < {SQL_NOW} - INTERVAL 30 DAY AS prev,
  contains(lower(title || ' ' || description), 'ment') AS named FROM docs WHERE published_at >= {SQL_NOW} - INTERVAL 60 DAY""",
  k="""SELECT count(*) FILTER (cur) AS total, count(*) FILTER (prev) AS prev_total, count(*) FILTER (cur AND sentiment = 'positive') AS positive,
  count(*) FILTER (prev AND sentiment = 'positive') AS prev_positive, count(DISTINCT CASE WHEN cur THEN coalesce(s_name, source_name) END) AS unique_sources,
  count(*) FILTER (cur AND named) AS brand, count(*) FILTER (prev AND named) AS prev_brand FROM two"""))
def period_kpis(s, d):
    return A.period_kpis(_doc(s, d), 30, NOW, ["ment"])


@query("sentiment_split", sql("ev", f"""SELECT CASE WHEN sentiment IN ('positive', 'negative') THEN sentiment ELSE 'neutral' END AS sentiment, count(*) AS articles
  FROM ev WHERE published_at >= {SQL_NOW} - INTERVAL 30 DAY GROUP BY 1"""))
def sentiment_split(s, d):
    return A.sentiment_split(A.in_period(T.articles_from_events(s, d), 30, NOW))


@query("daily_volume", sql("ev", """SELECT strftime(spine.day, '%Y-%m-%d') AS day, coalesce(total, 0) AS total, coalesce(positive, 0) AS positive,
  coalesce(neutral, 0) AS neutral, coalesce(negative, 0) AS negative FROM spine LEFT JOIN c ON c.day = spine.day""",
  spine="SELECT CAST(unnest(generate_series(DATE '2024-01-31' - 13, DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day",
  c="""SELECT CAST(published_at AS DATE) AS day, count(*) AS total, count(*) FILTER (sentiment = 'positive') AS positive,
  count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative FROM ev GROUP BY 1"""))
def daily_volume(s, d):
    return _day(A.daily_volume(T.articles_from_events(s, d), 14, NOW))


_NAME = "coalesce(nullif(s_name, ''), nullif(source_name, ''), 'Unknown')"


@query("top_sources", sql("evs", f"""SELECT {_NAME} AS name, count(*) AS articles FROM evs WHERE published_at >= {SQL_NOW} - INTERVAL 30 DAY
  GROUP BY 1 ORDER BY articles DESC, name LIMIT 10"""))
def top_sources(s, d):
    return A.top_sources(A.in_period(_ev(s, d), 30, NOW), 10)


@query("dashboard_sources", sql("docs", """SELECT coalesce(nullif(s_name, ''), nullif(source_name, ''), nullif(source_domain, ''), 'Unknown') AS name,
  count(*) AS articles FROM docs WHERE source_category <> 'social' GROUP BY 1 ORDER BY articles DESC, name LIMIT 6"""))
def dashboard_sources(s, d):
    return A.top_sources(_doc(s, d).filter("source_category <> 'social'"), 6, "source_domain")


@query("top_countries", sql("evs", """SELECT coalesce(nullif(country_code, ''), 'Unknown') AS country, count(*) AS articles FROM evs
  GROUP BY 1 ORDER BY articles DESC, country LIMIT 10"""))
def top_countries(s, d):
    return A.top_countries(_ev(s, d))


@query("geo_markers", sql("evs", """SELECT c.country, n AS articles, c.longitude, c.latitude,
  4.0::DOUBLE + 10.0::DOUBLE * n / (SELECT max(n) FROM k JOIN coords USING (country)) AS radius FROM k JOIN coords c USING (country)""",
  coords="SELECT * FROM (VALUES " + ", ".join(f"('{c}', {x}::DOUBLE, {y}::DOUBLE)" for c, (x, y) in COORDS.items()) + ") t(country, longitude, latitude)",
  k="SELECT country_code AS country, count(*) AS n FROM evs GROUP BY 1"))
def geo_markers(s, d):
    return A.geo_markers(_ev(s, d), COORDS)


@query("top_authors", sql("ev", """SELECT coalesce(nullif(author, ''), nullif(author_name, '')) AS author, count(*) AS articles FROM ev
  WHERE length(coalesce(nullif(author, ''), author_name)) > 2 GROUP BY 1 ORDER BY articles DESC, author LIMIT 8"""))
def top_authors(s, d):
    return A.top_authors(T.articles_from_events(s, d))


@query("keyword_share", sql("ev", f"""SELECT keyword, hits, {pct('hits', '(SELECT sum(hits) FROM h)')} AS share FROM h ORDER BY hits DESC, keyword LIMIT 10""",
  h=f"SELECT keyword, count(*) AS hits FROM (SELECT unnest(matched_keywords) AS keyword FROM ev WHERE published_at >= {SQL_NOW} - INTERVAL 30 DAY) GROUP BY 1"))
def keyword_share(s, d):
    return A.keyword_share(A.in_period(T.articles_from_events(s, d), 30, NOW))


@query("source_quality", sql("evs", """SELECT name, articles, CAST(floor(pos::DOUBLE / articles * 100 + 0.5::DOUBLE) AS BIGINT) AS positive_rate,
  CASE WHEN pos::DOUBLE / articles > 0.5 THEN 'High' WHEN pos::DOUBLE / articles > 0.25 THEN 'Medium' ELSE 'Low' END AS tier
  FROM g ORDER BY articles DESC, name LIMIT 10""",
  g=f"SELECT {_NAME} AS name, count(*) AS articles, count(*) FILTER (sentiment = 'positive') AS pos FROM evs GROUP BY 1"))
def source_quality(s, d):
    return A.source_quality(_ev(s, d))


_PP, _PD = trend("posts", "prev_posts")


@query("owned_kpis", sql("ev", f"""SELECT posts, prev_posts, earned, impressions, engagement_score, clicks, {_PP} AS posts_pct, {_PD} AS posts_dir FROM k""",
  two=f"""SELECT *, published_at >= {SQL_NOW} - INTERVAL 14 DAY AS cur, source_category = 'owned' AS owned FROM ev WHERE published_at >= {SQL_NOW} - INTERVAL 28 DAY""",
  k="""SELECT count(*) FILTER (cur AND owned) AS posts, count(*) FILTER (NOT cur AND owned) AS prev_posts, count(*) FILTER (cur AND NOT owned) AS earned,
  CAST(coalesce(sum(impressions) FILTER (cur AND owned), 0) AS BIGINT) AS impressions,
  CAST(coalesce(sum(engagement_score) FILTER (cur AND owned), 0) AS BIGINT) AS engagement_score,
  CAST(coalesce(sum(clicks) FILTER (cur AND owned), 0) AS BIGINT) AS clicks FROM two"""))
def owned_kpis(s, d):
    return A.owned_kpis(T.articles_from_events(s, d), 14, NOW)


@query("owned_calendar", sql("ev", """SELECT strftime(spine.day, '%Y-%m-%d') AS day, coalesce(owned, 0) AS owned, coalesce(earned, 0) AS earned
  FROM spine LEFT JOIN c ON c.day = spine.day""",
  spine="SELECT CAST(unnest(generate_series(DATE '2024-01-31' - 89, DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day",
  c="""SELECT CAST(published_at AS DATE) AS day, count(*) FILTER (source_category = 'owned') AS owned, count(*) FILTER (source_category <> 'owned') AS earned
  FROM ev GROUP BY 1"""))
def owned_calendar(s, d):
    return _day(A.owned_calendar(T.articles_from_events(s, d), 90, NOW))


# --- pipeline ---------------------------------------------------------------
@query("pipeline_health", sql("ev runs topics reg", f"""SELECT (SELECT count(*) FROM ev WHERE topic_id IS NOT NULL) AS total_articles,
  (SELECT count(*) FROM ev WHERE topic_id IS NOT NULL AND fetched_at >= {SQL_NOW} - INTERVAL 1 DAY) AS last_24h,
  strftime((SELECT max(completed_at) FROM runs WHERE status = 'success'), '%Y-%m-%d %H:%M:%S') AS last_success,
  (SELECT count(*) FROM topics WHERE is_active) AS active_topics,
  (SELECT count(*) FROM runs WHERE status = 'failed' AND started_at >= {SQL_NOW} - INTERVAL 1 DAY) AS failed_runs_24h,
  (SELECT count(*) FROM reg WHERE feed_url IS NOT NULL AND active) AS rss_feeds"""))
def pipeline_health(s, d):
    out = A.pipeline_health(T.articles_from_events(s, d), T.runs(s, d), T.topics(s, d), T.registry(s, d), NOW)
    return out.withColumn("last_success", F.date_format("last_success", "yyyy-MM-dd HH:mm:ss"))


@query("api_usage", sql("runs", f"""SELECT api, count(*) AS calls FROM (SELECT unnest(['rss', 'guardian', '_total_runs']) AS api FROM runs
  WHERE started_at >= {SQL_NOW} - INTERVAL 30 DAY) GROUP BY 1"""))
def api_usage(s, d):
    return A.api_usage(T.runs(s, d), NOW)


@query("recent_runs", sql("runs topics", """SELECT run_id, t.name AS topic_name, r.status, articles_fetched, articles_inserted,
  CAST(floor((epoch_us(completed_at) - epoch_us(started_at)) / 1000000) AS BIGINT) AS duration_seconds
  FROM runs r LEFT JOIN topics t USING (topic_id) ORDER BY started_at DESC, run_id LIMIT 5"""))
def recent_runs(s, d):
    return joins.recent_runs(T.runs(s, d), T.topics(s, d)).select(
        "run_id", "topic_name", "status", "articles_fetched", "articles_inserted", "duration_seconds"
    )


@query("topic_activity", sql("ev topics", f"""SELECT t.topic_id, t.name, coalesce(n, 0) AS articles_last_days FROM topics t
  LEFT JOIN (SELECT topic_id, count(*) AS n FROM ev WHERE fetched_at >= {SQL_NOW} - INTERVAL 7 DAY GROUP BY 1) a USING (topic_id) WHERE t.is_active"""))
def topic_activity(s, d):
    return joins.topic_activity(T.topics(s, d), T.articles_from_events(s, d), NOW).select("topic_id", "name", "articles_last_days")


@query("user_scope", sql("runs topics", "SELECT run_id, status FROM runs WHERE topic_id IN (SELECT topic_id FROM topics WHERE user_id = 1)"))
def user_scope(s, d):
    return filters.scope_runs(T.runs(s, d), T.topics(s, d), 1).select("run_id", "status")


@query("run_summary", sql("doc", """SELECT connector, count(*) AS fetched, count(*) FILTER (rn = 1) AS inserted, count(*) FILTER (rn > 1) AS duplicate
  FROM (SELECT connector, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM doc) GROUP BY 1"""))
def run_summary(s, d):
    from mentionlake.operators.dedup import dedup_first

    cands = T.articles_from_documents(s, d).withColumn("ingestion_source", F.col("connector"))
    return A.run_summary(cands, dedup_first(cands, [F.col("id").asc()]))


@query("source_health", sql("src", """SELECT s.id, CASE WHEN ok THEN 0 WHEN NOT ok THEN consecutive_failures + 1 ELSE consecutive_failures END AS consecutive_failures,
  CASE WHEN ok THEN 'healthy' WHEN NOT ok AND consecutive_failures + 1 >= 10 THEN 'error' WHEN NOT ok THEN 'degraded' ELSE health_status END AS health_status,
  CASE WHEN ok THEN strftime(last_at, '%Y-%m-%d %H:%M:%S') END AS last_success_at
  FROM src s LEFT JOIN (SELECT user_id % 25 AS id, arg_max(event_type <> 'error', ts) AS ok, max(ts) AS last_at FROM events GROUP BY 1) o USING (id)"""))
def source_health(s, d):
    outcomes = T.read(s, d, "events").select(
        (F.col("user_id") % 25).alias("source_id"), (F.col("event_type") != "error").alias("ok"), F.col("ts").cast("timestamp").alias("at")
    )
    src = T.sources(s, d).withColumn("last_success_at", F.lit(None).cast("timestamp"))
    out = A.update_health(src, outcomes, error_at=10)
    return out.select("id", F.col("consecutive_failures").cast("bigint"), "health_status", F.date_format("last_success_at", "yyyy-MM-dd HH:mm:ss").alias("last_success_at"))


# --- screens ----------------------------------------------------------------
@query("facets", sql("docs", """SELECT DISTINCT facet, value FROM (
  SELECT 'source' AS facet, coalesce(nullif(source_name, ''), s_name) AS value FROM docs UNION ALL SELECT 'country', country_code FROM docs
  UNION ALL SELECT 'language', language FROM docs UNION ALL SELECT 'keyword', unnest(matched_keywords) FROM docs) WHERE coalesce(value, '') <> ''"""))
def facets(s, d):
    return A.facets(_doc(s, d))


@query("archive_trend", sql("doc", """SELECT strftime(day, '%Y-%m-%d') AS day, articles FROM (SELECT CAST(published_at AS DATE) AS day, count(*) AS articles
  FROM doc GROUP BY 1 ORDER BY 1 DESC LIMIT 45)"""))
def archive_trend(s, d):
    return _day(A.archive_trend(T.articles_from_documents(s, d), 45))


@query("unread_counts", "SELECT user_id, count(*) FILTER (event_id % 2 <> 0) AS unread FROM events WHERE event_type = 'signup' GROUP BY 1")
def unread_counts(s, d):
    return A.unread_counts(T.notifications(s, d))


@query("registry_by_region", sql("reg", "SELECT region, domain, name, count(*) OVER (PARTITION BY region) AS region_sources FROM reg"))
def registry_by_region(s, d):
    return A.sources_by_region(T.registry(s, d)).select("region", "domain", "name", "region_sources")


@query("top_stories", sql("docs", f"""SELECT row_number() OVER (ORDER BY sc DESC, published_at DESC, id) AS rank, id, title FROM (
  SELECT id, title, published_at, coalesce(relevance_score, 0.5::DOUBLE) AS sc FROM docs WHERE (relevance_label = 'high' OR is_major_outlet)
  AND published_at >= {SQL_NOW} - INTERVAL 30 DAY ORDER BY sc DESC, published_at DESC, id LIMIT 20)"""))
def top_stories(s, d):
    return A.top_stories(A.in_period(_doc(s, d), 30, NOW)).select(F.col("rank").cast("bigint").alias("rank"), "id", "title")


@query("feed_page", sql("doc", """SELECT id, (SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) FROM doc) AS total_pages FROM doc
  ORDER BY is_enriched DESC, published_at DESC, id LIMIT 20 OFFSET 40"""))
def feed_page(s, d):
    return filters.page(filters.order_feed(T.articles_from_documents(s, d)), 2, 20).select("id", "total_pages")


@query("latest_per_user", """SELECT user_id, event_id AS id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
  FROM events WHERE event_type = 'signup') WHERE rank <= 20""")
def latest_per_user(s, d):
    out = filters.latest(T.notifications(s, d), 20, [F.col("created_at").desc(), F.col("id").desc()], ["user_id"])
    return out.select("user_id", "id", F.col("rank").cast("bigint").alias("rank"))


@query("topic_alignment", sql("doc", """SELECT theme, owned, earned FROM (SELECT theme, count(*) FILTER (own) AS owned, count(*) FILTER (NOT own) AS earned FROM (
  SELECT source_category = 'owned' AS own, unnest(coalesce(key_themes, matched_keywords)) AS theme FROM doc) GROUP BY 1) WHERE owned > 0
  ORDER BY owned + earned DESC, theme LIMIT 12"""))
def topic_alignment(s, d):
    return joins.topic_alignment(T.articles_from_documents(s, d))


@query("insight_rows", sql("docs", f"""SELECT id, s_name AS source, country_code FROM docs WHERE is_duplicate = false AND published_at >= {SQL_NOW} - INTERVAL 30 DAY
  AND list_has_any(matched_keywords, ['kw1', 'kw5'])"""))
def insight_rows(s, d):
    out = insight_period(T.articles_from_documents(s, d), T.sources(s, d), 30, NOW, ["KW1", "kw5"])
    return out.select("id", F.col("source.name").alias("source"), F.col("source.country_code").alias("country_code"))


_SP, _SD = trend("cur", "prev")


@query("source_trend", sql("doc", f"""SELECT source_name, cur, prev, {_SP} AS pct, {_SD} AS dir FROM (SELECT source_name,
  count(*) FILTER (published_at >= {SQL_NOW} - INTERVAL 30 DAY) AS cur, count(*) FILTER (published_at < {SQL_NOW} - INTERVAL 30 DAY) AS prev
  FROM doc WHERE published_at >= {SQL_NOW} - INTERVAL 60 DAY GROUP BY 1)"""))
def source_trend(s, d):
    g = A.in_two_periods(T.articles_from_documents(s, d), 30, NOW).groupBy("source_name").agg(
        F.count(F.when(A.current(NOW, 30), 1)).alias("cur"), F.count(F.when(A.previous(NOW, 30), 1)).alias("prev")
    )
    c, p = F.col("cur"), F.col("prev")
    return g.withColumns({"pct": trend_pct(c, p), "dir": trend_dir(c, p)})


_OP, _OD = trend("cur", "prev")


@query("order_trend", f"""SELECT o_orderpriority, cur, prev, {_OP} AS pct, {_OD} AS dir FROM (SELECT o_orderpriority,
  count(*) FILTER (o_orderdate >= TIMESTAMP '1997-01-01') AS cur, count(*) FILTER (o_orderdate < TIMESTAMP '1997-01-01') AS prev
  FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1)""")
def order_trend(s, d):
    at = F.col("o_orderdate").cast("timestamp")
    split = F.lit("1997-01-01").cast("timestamp")
    rows = T.read(s, d, "orders").filter((at >= F.lit("1996-01-01").cast("timestamp")) & (at < F.lit("1998-01-01").cast("timestamp")))
    g = rows.groupBy("o_orderpriority").agg(F.count(F.when(at >= split, 1)).alias("cur"), F.count(F.when(at < split, 1)).alias("prev"))
    c, p = F.col("cur"), F.col("prev")
    return g.withColumns({"pct": trend_pct(c, p), "dir": trend_dir(c, p)})


@query("lineitem_share", """SELECT l_suppkey, n, CAST(floor(n::DOUBLE / (SELECT count(*) FROM lineitem) * 10000 + 0.5::DOUBLE) AS BIGINT) AS share_bp
  FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10)""")
def lineitem_share(s, d):
    counts = T.read(s, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    total = counts.select(F.sum("n")).scalar()
    top = counts.orderBy(F.col("n").desc(), "l_suppkey").limit(10)
    return top.withColumn("share_bp", F.floor(F.col("n") / total * 10000 + 0.5).cast("bigint"))


@query("export_rows", sql("docs", """SELECT title AS "Title", coalesce(s_name, source_name) AS "Source", country_code AS "Country", language AS "Language",
  strftime(published_at, '%Y-%m-%d') AS "Date", coalesce(sentiment, '') AS "Sentiment", coalesce(relevance_label, '') AS "Relevance",
  array_to_string(matched_keywords, '; ') AS "Keywords", url AS "URL" FROM docs"""))
def export(s, d):
    return export_rows(_doc(s, d), "analytics")


_REPORT = sql("docs", f"""SELECT * FROM (
  SELECT 'summary' AS section, 1 AS rank, 'Total mentions' AS label, CAST(count(*) AS VARCHAR) AS value FROM cur
  UNION ALL SELECT 'summary', 2, 'Unique sources', CAST(count(DISTINCT source_name) AS VARCHAR) FROM cur
  UNION ALL SELECT 'sentiment', 3, 'positive', CAST(count(*) FILTER (sentiment = 'positive') AS VARCHAR) FROM cur
  UNION ALL SELECT 'sentiment', 4, 'neutral', CAST(count(*) FILTER (sentiment = 'neutral') AS VARCHAR) FROM cur
  UNION ALL SELECT 'sentiment', 5, 'negative', CAST(count(*) FILTER (sentiment = 'negative') AS VARCHAR) FROM cur
  UNION ALL SELECT 'share_of_voice', row_number() OVER (ORDER BY mentions DESC, entity), entity,
    mentions || ' (' || ({pct('mentions', '(SELECT sum(mentions) FROM n)')}) || '%)' FROM n
  UNION ALL SELECT 'top_sources', row_number() OVER (ORDER BY c DESC, s_name), s_name, CAST(c AS VARCHAR) FROM (
    SELECT s_name, count(*) AS c FROM cur GROUP BY 1 ORDER BY c DESC, s_name LIMIT 8)
  UNION ALL SELECT 'top_stories', row_number() OVER (ORDER BY sc DESC, published_at DESC, id), title, url FROM (
    SELECT *, coalesce(relevance_score, 0.5::DOUBLE) AS sc FROM cur WHERE relevance_label = 'high' OR is_major_outlet
    ORDER BY sc DESC, published_at DESC, id LIMIT 10))""",
    cur=f"SELECT * FROM docs WHERE published_at >= {SQL_NOW} - INTERVAL 30 DAY", two=_TWO, n=_ENT)


@query("summary_report", _REPORT.replace("1 AS rank", "CAST(1 AS BIGINT) AS rank"))
def summary_report(s, d):
    return report.summary_report(_doc(s, d), T.ENTITIES, 30, NOW).withColumn("rank", F.col("rank").cast("bigint"))
