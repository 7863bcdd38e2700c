"""Queries that run a stream over everything available and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from mentionlake.functions.scalars import literal_table
from mentionlake.operators import saved
from mentionlake.plans import ingest
from mentionlake.plans.oracle_base import sql
from mentionlake.plans.queries_rows import ALERT_SQL, ORACLES as ROW_ORACLES, alert_rules
from mentionlake.session import shared_path
from mentionlake.sources import buckets, tables as T
from mentionlake.streaming import jobs

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


def _events(s, d):
    return T.event_articles(jobs.stream_files(s, f"{d}/events.parquet", T.EVENTS_DDL))


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _landed(s, df, label: str):
    """Write rows to the shared folder and open them as a stream."""
    path = shared_path(s, label)
    df.write.parquet(path)
    return s.readStream.schema(df.schema).parquet(path)


@query("live_feed", sql("ev", "SELECT id, sentiment FROM ev WHERE NOT coalesce(is_duplicate, false)"))
def live_feed(s, d):
    stream = _events(s, d).withColumn("relevance_label", F.lit(None).cast("string"))
    return jobs.drain(jobs.live_feed(stream).select("id", "sentiment"), "live-feed")


@query("stream_volume", sql("ev", """SELECT strftime(date_trunc('day', published_at), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS articles,
  count(*) FILTER (sentiment = 'negative') AS negative FROM ev GROUP BY 1"""))
def stream_volume(s, d):
    counts = jobs.stream_volume(_events(s, d))
    out = jobs.drain(counts, "volume", "update", ["window_start"])
    return out.select(_stamp("window_start"), "articles", "negative")


@query("stream_volume_sliding", sql("ev", """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, source_category, count(*) AS articles FROM (
  SELECT source_category, date_trunc('day', published_at) - to_days(i) AS w FROM ev, range(2) t(i)) GROUP BY 1, 2"""))
def stream_volume_sliding(s, d):
    counts = jobs.stream_volume(_events(s, d), "2 days", "1 day", ["source_category"])
    out = jobs.drain(counts, "sliding", "update", ["window_start", "source_category"])
    return out.select(_stamp("window_start"), "source_category", "articles")


@query("stream_bursts", sql("ev", """SELECT source_id, strftime(min(published_at), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS articles FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY published_at, id) AS burst FROM (SELECT *, CASE WHEN published_at >= lag(published_at) OVER (
  PARTITION BY source_id ORDER BY published_at, id) + INTERVAL 30 MINUTE OR lag(id) OVER (PARTITION BY source_id ORDER BY published_at, id) IS NULL THEN 1 ELSE 0 END AS fresh FROM ev))
  GROUP BY source_id, burst"""))
def stream_bursts(s, d):
    """All bursts: closed ones as the stream wrote them, those still open at the end of the input from its state."""
    found = jobs.all_bursts(_events(s, d), shared_path(s, "bursts"), shared_path(s, "bursts-state"), delay="1 hour")
    return found.select("source_id", _stamp("window_start"), "articles")


@query("run_status", """SELECT strftime(CAST(ts AS DATE), '%Y%m%d') || '-' || user_id % 10 AS run_id, arg_max(event_type, (ts, event_type)) AS status FROM events GROUP BY 1""")
def run_status(s, d):
    e = jobs.stream_files(s, f"{d}/events.parquet", T.EVENTS_DDL).withColumn("at", F.col("ts").cast("timestamp"))
    changes = e.select(F.concat_ws("-", F.date_format("at", "yyyyMMdd"), (F.col("user_id") % 10).cast("string")).alias("run_id"), F.col("event_type").alias("status"), "at")
    return jobs.drain(jobs.run_status(changes), "run-status", "update", ["run_id"]).select("run_id", "status")


@query("is_fetching", """SELECT count(*) FILTER (status = 'view') > 0 AS fetching, count(*) FILTER (status = 'view') AS running FROM (
  SELECT arg_max(event_type, (ts, event_type)) AS status FROM events GROUP BY strftime(CAST(ts AS DATE), '%Y%m%d') || '-' || user_id % 10)""")
def is_fetching(s, d):
    running = F.when(F.col("status") == "view", "running").otherwise(F.col("status"))
    return jobs.is_fetching(run_status(s, d).withColumn("status", running))


@query("notification_feed", """SELECT user_id, event_id AS id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE event_type = 'signup') WHERE rn <= 20""")
def notification_feed(s, d):
    stream = T.event_notifications(jobs.stream_files(s, f"{d}/events.parquet", T.EVENTS_DDL))
    snapshot = shared_path(s, "notifications")
    jobs.notification_feed(stream, snapshot, shared_path(s, "notifications-state")).awaitTermination()
    return jobs.latest_snapshot(s, snapshot).select("user_id", "id")


@query("alert_stream", sql("ev src", "SELECT rule_id, id FROM (" + ALERT_SQL + ")"))
def alert_stream(s, d):
    alerts = jobs.alert_stream(_events(s, d), alert_rules(s, d))
    return jobs.drain(alerts.select("rule_id", "id"), "alerts")


@query("alert_digest", sql("ev src", f"""SELECT rule_id, strftime(date_trunc('day', published_at), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS alerts
  FROM ({ALERT_SQL}) WHERE schedule = 'daily' GROUP BY 1, 2"""))
def alert_digest(s, d):
    alerts = jobs.alert_stream(_events(s, d), alert_rules(s, d))
    out = jobs.drain(saved.digest(alerts, "daily"), "digest", "update", ["rule_id", "window_start"])
    return out.select("rule_id", _stamp("window_start"), "alerts")


@query("update_stream", sql("doc", "SELECT id, CASE WHEN relevance_label = 'noise' THEN 'seen' ELSE title END AS title FROM doc WHERE language = 'en'"))
def update_stream(s, d):
    a = T.articles_from_documents(s, d)
    snapshot = shared_path(s, "live")
    buckets.create(snapshot, a.filter("language = 'en'").select("id", "title", "fetched_at"), "id")
    changes = a.filter("relevance_label = 'noise'").select("id", F.lit("seen").alias("title"), "fetched_at")
    jobs.update_stream(_landed(s, changes, "changes"), snapshot, shared_path(s, "live-state")).awaitTermination()
    return jobs.latest_snapshot(s, snapshot).select("id", "title")


@query("registry_stream", ROW_ORACLES["registry_sync"])
def registry_stream(s, d):
    r = T.registry(s, d)
    src = r.filter("feed_url IS NOT NULL AND approval_status = 'approved'").select(
        F.col("seq").cast("string").alias("id"), "name", "domain", F.col("feed_url").alias("rss_url"), "source_type", "country_code", "region", "language",
        "active", "approval_status", F.lit("healthy").alias("health_status"), F.lit(0).alias("consecutive_failures"), F.lit(30).alias("fetch_priority"),
    )
    snapshot = shared_path(s, "registry")
    src.write.parquet(f"{snapshot}/batch=-1")
    flipped = F.when(F.col("approval_status") == "approved", "pending").otherwise("approved")
    changes = r.filter("seq % 5 = 0 OR seq % 50 = 7").withColumn("old_status", F.col("approval_status")).withColumn("approval_status", flipped)
    jobs.registry_stream(_landed(s, changes, "registry-changes"), snapshot, shared_path(s, "registry-state")).awaitTermination()
    return jobs.latest_snapshot(s, snapshot).select("rss_url", "domain", "active", "fetch_priority")


@query("ingest_stream", sql("doc", """SELECT url, id FROM (SELECT id, url, row_number() OVER (PARTITION BY url ORDER BY source_id, (id % 400) // 20, CAST(id AS VARCHAR)) AS rn FROM doc
  WHERE trim(title) <> '' AND published_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY
  AND regexp_matches(lower(trim(title) || ' about ' || id), '(^|[^A-Za-z0-9_])(that|with|from)($|[^A-Za-z0-9_])')) WHERE rn = 1"""))
def ingest_stream(s, d):
    sources = T.sources(s, d)
    topics = literal_table(s, "topic_id int, keywords array<string>, sources array<string>", [(1, ["that", "with", "from"], ["rss"])])
    target = shared_path(s, "ingested")
    pipeline = lambda raw: ingest.scheduled_ingest(raw, sources, topics, None, NOW)
    landed = _landed(s, T.raw_feeds(s, d), "landed-feeds")
    jobs.start_ingest(landed, pipeline, target, shared_path(s, "ingest-state")).awaitTermination()
    return s.read.parquet(target).select("url", F.col("guid").cast("bigint").alias("id"))
