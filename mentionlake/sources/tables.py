"""The given tables read as the tables of this domain.

``documents`` and ``events`` become articles, ``pages`` crawled pages,
``supplier`` the publisher registry, and so on. The mapping is a projection over
the scan (plus one dimension join), so pruning and pushdown still work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mentionlake.functions.scalars import literal_table

AS_OF = "2024-01-31 00:00:00"

# Words of medium frequency in the given documents; used as monitored terms.
KEYWORDS = [
    (1, "hent", ["hest", "rehe"]), (2, "anble", ["edst"]), (3, "edha", []), (4, "hees", ["inble", "hent"]),
    (5, "ntre", []), (6, "ench", ["rend"]), (7, "ment", []), (8, "tion", ["ation"]), (9, "the and", ["of the"]),
]
TOPICS = [
    (1, "north", ["hent", "anble"], ["rss", "gdelt"]), (2, "south", ["edha", "hees", "ntre"], ["rss"]),
    (3, "east", ["ench", "the and"], ["gdelt", "newsapi"]), (4, "west", ["inble"], ["newsapi", "perigon"]),
]
ENTITIES = {
    "Alder": ["hent", "hest"], "Birch": ["anble"], "Cedar": ["edst", "edha"], "Douglas": ["ment"], "Elm": ["the and", "of the"],
    "Fir": ["ntre", "ench"],
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in the splits that its files give."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _moment(ts: str | Column) -> Column:
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed source per document source, placed in a nation and region."""
    ids = read(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    ids = ids.withColumn("id", F.regexp_extract("name", r"(\d+)$", 1).cast("bigint"))
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = nation.select(F.col("n_nationkey").cast("bigint").alias("place"), F.col("n_name").alias("country_code"), F.col("r_name").alias("region"))
    return ids.withColumn("place", F.col("id") % 25).join(place, "place", "left").select(
        "id", "name", F.concat("name", F.lit(".example.com")).alias("domain"),
        F.concat(F.lit("https://"), "name", F.lit(".example.com/rss")).alias("rss_url"), "country_code", "region",
        F.when(F.col("id") % 7 == 0, "approved").when(F.col("id") % 6 == 5, "pending").otherwise("approved").alias("approval_status"),
        (F.col("id") % 5 != 4).alias("active"),
        F.when(F.col("id") % 4 == 0, "degraded").when(F.col("id") % 9 == 8, "error").otherwise("healthy").alias("health_status"),
        (F.col("id") % 13).cast("int").alias("consecutive_failures"), (F.lit(30) + (F.col("id") % 8) * 10).cast("int").alias("fetch_priority"),
        F.lit("en").alias("language"), F.lit("rss").alias("source_type"),
    )


# Schema of the events table, for streams (files are never inspected).
EVENTS_DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def articles_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_articles(read(spark, sf_dir, "events"))


def event_articles(e: DataFrame) -> DataFrame:
    """Events, batch or stream, as articles."""
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("int")
    kind = F.col("event_type")
    second = F.when(k % 3 == 0, F.array(F.concat(F.lit("kw"), (k % 5).cast("string")))).otherwise(F.array().cast("array<string>"))
    return e.select(
        F.col("event_id").alias("id"), _moment("ts").alias("published_at"), _moment("ts").alias("fetched_at"),
        (F.col("user_id") % 25).alias("source_id"), "user_id",
        F.when(kind.isin("purchase", "signup"), "positive").when(kind == "error", "negative").when(kind == "view", "neutral").alias("sentiment"),
        F.array_distinct(F.concat(F.array(F.concat(F.lit("kw"), (k % 12).cast("string"))), second)).alias("matched_keywords"),
        F.when(F.col("user_id") % 10 == 0, "owned").when(F.col("user_id") % 10 == 1, "social").otherwise("media").alias("source_category"),
        F.floor(F.col("value") * 100).cast("bigint").alias("impressions"), F.floor("value").cast("bigint").alias("clicks"),
        F.when(k % 4 != 0, k.cast("bigint")).alias("engagement_score"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 13 == 0).alias("is_duplicate"),
        F.concat(F.lit("Author "), (F.col("user_id") % 40).cast("string")).alias("author_name"),
        F.when(F.col("event_id") % 6 == 0, F.lit("")).alias("author"),
        F.when(F.col("user_id") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("feed-"), (F.col("user_id") % 7).cast("string"))).alias("source_name"),
        F.lit(None).cast("string").alias("source_url"), F.col("event_type").alias("topic_id"),
        F.concat(F.lit("Event "), kind, F.lit(" by user "), F.col("user_id").cast("string")).alias("title"),
        F.lit(None).cast("string").alias("description"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("country"),
    )


def articles_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One row per key: a repeated label multiplies nothing, and a query that reads no label
    # column has this join removed by the optimizer.
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = read(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    q, t, i = F.col("quality"), F.col("toxic"), F.col("doc_id")
    label = F.when((q == 1) & (t == 0), "high").when((q == 1) & (t == 1), "medium").when((q == 0) & (t == 0), "low").when((q == 0) & (t == 1), "noise")
    feeling = F.when(t == 1, "negative").when(q == 1, "positive").when(q.isNotNull(), "neutral")
    score = F.when((q == 1) & (t == 0), 0.9).when((q == 1) & (t == 1), 0.6).when((q == 0) & (t == 0), 0.3).when((q == 0) & (t == 1), 0.1)
    sid = F.regexp_extract("source", r"(\d+)$", 1).cast("bigint")
    published = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval((i % 60).cast("int"), (i % 24).cast("int"))
    host = F.concat(F.lit("https://"), "source", F.lit(".example.com"))
    url = F.concat(host, F.lit("/"), "lang", F.lit("/"), (F.col("n_chars") % 500).cast("string"), F.when(i % 2 == 0, "?utm_source=feed").otherwise(""))
    themes = F.when(i % 5 == 0, F.array().cast("array<string>")).when(label == "high", F.array(F.concat(F.lit("th"), (i % 7).cast("string"))))
    return d.select(
        i.alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"),
        F.col("text").alias("description"), url.alias("url"), F.col("lang").alias("language"),
        F.col("source").alias("source_name"), sid.alias("source_id"), F.concat("source", F.lit(".example.com")).alias("source_domain"),
        F.concat("source", F.lit(".example.com")).alias("source_url"), published.alias("published_at"),
        (published + F.expr("INTERVAL 1 HOUR")).alias("fetched_at"), label.alias("relevance_label"), score.alias("relevance_score"),
        feeling.alias("sentiment"), q.isNotNull().alias("is_enriched"), (sid % 10 == 0).alias("is_major_outlet"),
        F.when(i % 11 != 0, i % 13 == 0).alias("is_duplicate"), F.array(F.concat(F.lit("kw"), (i % 12).cast("string"))).alias("matched_keywords"),
        themes.alias("key_themes"), F.when(sid % 10 == 3, "owned").when(sid % 10 == 7, "social").otherwise("media").alias("source_category"),
        (i % 6).alias("topic_id"), F.when(i % 3 == 0, "rss").when(i % 3 == 1, "gdelt").otherwise("newsapi").alias("connector"),
        (F.lit(30) + (sid % 8) * 10).cast("int").alias("fetch_priority"), F.lit(None).cast("string").alias("country"),
        F.lit(None).cast("string").alias("story_cluster_id"),
    )


def candidates_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery candidates: one per crawled page, titled by its <title>."""
    p = read(spark, sf_dir, "pages")
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    stage = F.when(F.col("page_id") % 4 == 0, "sitemaps").when(F.col("page_id") % 4 == 1, "tier2").when(F.col("page_id") % 4 == 2, "sources").otherwise("firecrawl")
    host = F.regexp_replace(F.regexp_extract("url", r"^https?://([^/?#]+)", 1), r"^www\.", "")
    return p.select(
        F.col("page_id").alias("id"), F.col("page_id").alias("ordinal"), "url", title.alias("title"), F.lit("").alias("snippet"),
        host.alias("source_domain"), F.concat(F.lit("Site "), host).alias("source_name"), stage.alias("stage"), stage.alias("discovery_method"),
        F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("description"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country_code"), F.col("r_name").alias("region"))
    k = F.col("s_suppkey")
    word = F.when(k % 10 == 0, " Energy").when(k % 10 == 3, " Press").when(k % 10 == 6, " Tech").otherwise("")
    domain = F.concat(F.replace(F.lower("s_name"), F.lit("#"), F.lit("-")), F.lit(".example.com"))
    return s.join(place, "s_nationkey", "left").select(
        k.alias("seq"), F.concat("s_name", word).alias("name"),
        F.when(k % 50 == 7, "reuters.com").when(k % 50 == 9, "renews.biz").otherwise(domain).alias("domain"),
        "country_code", "region", F.when(k % 3 == 0, "fr").otherwise("en").alias("language"), F.lit("rss").alias("source_type"),
        F.when(k % 6 != 0, F.concat(F.lit("https://feeds.example.com/"), k.cast("string"))).alias("feed_url"),
        F.when(k % 4 == 0, "pending").otherwise("approved").alias("approval_status"), (k % 7 != 0).alias("active"),
        (F.lit(20) + k % 80).cast("int").alias("priority"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ingestion run per day and event type."""
    e = read(spark, sf_dir, "events").withColumn("at", _moment("ts"))
    grouped = e.groupBy(F.to_date("at").alias("day"), "event_type").agg(
        F.min("at").alias("started_at"), F.max("at").alias("completed_at"), F.count(F.lit(1)).alias("articles_fetched"),
        F.count_distinct("user_id").alias("articles_inserted"),
    )
    meta = F.concat(
        F.lit('{"sources":[{"source":"rss","count":'), F.col("articles_fetched").cast("string"), F.lit('},{"source":"guardian-'),
        "event_type", F.lit('","count":1}],"elapsed_seconds":"1.0"}'),
    )
    return grouped.select(
        F.concat_ws("-", F.date_format("day", "yyyyMMdd"), "event_type").alias("run_id"), F.col("event_type").alias("topic_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), "started_at", "completed_at",
        "articles_fetched", "articles_inserted", meta.alias("metadata"),
    )


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic per event type."""
    t = read(spark, sf_dir, "events").select(F.col("event_type").alias("topic_id")).distinct()
    return t.select(
        "topic_id", F.concat(F.lit("Topic "), "topic_id").alias("name"), (F.col("topic_id") != "signup").alias("is_active"),
        F.when(F.col("topic_id") < "f", 1).otherwise(2).cast("bigint").alias("user_id"),
    )


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return e.select("user_id", (F.col("event_id") % 1000).alias("article_id")).distinct()


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    return e.select("user_id", (F.col("event_id") % 1000).alias("article_id"), F.concat(F.lit("tag"), (F.col("event_id") % 7).cast("string")).alias("tag"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return e.select(
        "user_id", (F.col("event_id") % 1000).alias("article_id"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("content"),
        _moment("ts").alias("created_at"),
    )


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_notifications(read(spark, sf_dir, "events"))


def event_notifications(e: DataFrame) -> DataFrame:
    return e.filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("id"), "user_id", _moment("ts").alias("created_at"),
        F.when(F.col("event_id") % 2 == 0, _moment("ts")).alias("read_at"),
    )


def social_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as social posts: the first line is the title."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "conv_id", "turn", "role",
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"),
    )


def keywords(spark: SparkSession) -> DataFrame:
    rows = [(i, t, True, x, 0) for i, t, x in KEYWORDS]
    return literal_table(spark, "id int, text string, active boolean, expanded_terms array<string>, match_count bigint", rows)


def topic_rules(spark: SparkSession) -> DataFrame:
    return literal_table(spark, "topic_id int, name string, keywords array<string>, sources array<string>", TOPICS)


# --- landed documents derived from the given tables -------------------------
ITEMS_PER_BODY = 20


def _bodies(spark: SparkSession, sf_dir: str, item: Column, opening: str, closing: str) -> DataFrame:
    """Documents of one source packed into bodies of at most ITEMS_PER_BODY items.

    A source owns every 20th doc_id, so a run of 400 ids bounds each group.
    """
    a = articles_from_documents(spark, sf_dir)
    packed = a.select("source_id", "source_domain", F.floor(F.col("id") / (20 * ITEMS_PER_BODY)).alias("chunk"), F.struct("id", item.alias("x")).alias("i"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["x"]), "")
    return packed.groupBy("source_id", "source_domain", "chunk").agg(F.concat(F.lit(opening), body, F.lit(closing)).alias("body"))


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def _cdata(value: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), value, F.lit("]]>"))


def raw_feeds(spark: SparkSession, sf_dir: str, publisher: bool = False) -> DataFrame:
    """RSS bodies (even chunks) and Atom bodies (odd chunks). ``publisher`` appends a
    publisher to the titles and names it in ``<source>``, as search feeds do."""
    mail_date = F.concat(F.date_format("published_at", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    title, source = F.trim("title"), F.lit("")
    if publisher:
        name = F.when(F.col("id") % 3 == 0, "Reuters").when(F.col("id") % 3 == 1, "El País").otherwise(F.concat(F.lit("Paper "), F.col("source_name")))
        title = F.concat(title, F.lit(" - "), name)
        source = F.concat(F.lit('<source url="https://www.'), "source_domain", F.lit('">'), name, F.lit("</source>"))
    item = _tag("item", F.concat(
        _tag("title", _cdata(title)), _tag("link", F.col("url")), _tag("description", F.concat(F.lit("<b>about</b> "), F.col("id").cast("string"))),
        _tag("pubDate", mail_date), _tag("dc:creator", F.col("source_name")), _tag("guid", F.col("id").cast("string")), source))
    entry = _tag("entry", F.concat(
        _tag("title", _cdata(title)), F.lit('<link rel="alternate" href="'), F.col("url"), F.lit('"/>'),
        _tag("summary", F.concat(F.lit("about "), F.col("id").cast("string"))), _tag("published", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _tag("author", _tag("name", F.col("source_name"))), _tag("id", F.col("id").cast("string"))))
    rss = _bodies(spark, sf_dir, item, "<?xml version=\"1.0\"?><rss><channel>", "</channel></rss>")
    atom = _bodies(spark, sf_dir, entry, "<?xml version=\"1.0\"?><feed xmlns=\"http://www.w3.org/2005/Atom\">", "</feed>")
    both = rss if publisher else rss.filter("chunk % 2 = 0").unionByName(atom.filter("chunk % 2 = 1"))
    return both.select("source_id", "source_domain", "chunk", "body", F.lit(True).alias("http_ok"), F.lit(AS_OF).cast("timestamp").alias("fetched_at"))


def raw_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps of at most ITEMS_PER_BODY entries, and indexes over 20 sitemaps each."""
    entry = _tag("url", F.concat(
        _tag("loc", F.col("url")), _tag("lastmod", F.date_format("published_at", "yyyy-MM-dd")),
        F.when(F.col("id") % 2 == 0, _tag("news:title", _cdata(F.trim("title")))).otherwise("")))
    maps = _bodies(spark, sf_dir, entry, "<?xml version=\"1.0\"?><urlset>", "</urlset>")
    number = lambda c: F.lpad(F.col(c).cast("string"), 8, "0")
    url = F.concat(F.lit("https://"), "source_domain", F.lit("/sitemap-"), number("chunk"), F.lit(".xml"))
    maps = maps.select("chunk", F.col("source_domain").alias("domain"), url.alias("url"), "body")
    loc = F.struct("chunk", _tag("sitemap", _tag("loc", F.col("url"))).alias("x"))
    index = maps.groupBy("domain", F.floor(F.col("chunk") / 20).alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(loc)), lambda c: c["x"]), "").alias("locs"))
    index = index.select("domain", F.concat(F.lit("https://"), "domain", F.lit("/index-"), number("part"), F.lit(".xml")).alias("url"),
                         F.concat(F.lit("<?xml version=\"1.0\"?><sitemapindex>"), "locs", F.lit("</sitemapindex>")).alias("body"))
    return maps.drop("chunk").unionByName(index)


def annotated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages with a date, a canonical link or a feed announcement added to their head."""
    p = read(spark, sf_dir, "pages")
    i, day = F.col("page_id"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    head = (
        F.when(i % 4 == 0, F.concat(F.lit('<meta property="article:published_time" content="2024-01-'), day, F.lit('T10:00:00Z">')))
        .when(i % 4 == 1, F.concat(F.lit('<link rel="canonical" href="https://canonical.example.com/p/'), i.cast("string"), F.lit('/?utm_source=x">')))
        .when(i % 4 == 2, F.concat(F.lit('<script type="application/ld+json">{"datePublished": "2024-01-'), day, F.lit('"}</script>')))
        .otherwise('<link rel="alternate" type="application/rss+xml" href="/feed.xml">')
    )
    return p.withColumn("html", F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), head)))
