"""Feed bodies (RSS 2.0, Atom, aggregator search feeds) to candidate rows.

Each body is one row of a landed table; items come out with regular
expressions and ``explode``, so parsing is a narrow JVM-side projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mentionlake.functions import dates as D, text as X, urls as U
from mentionlake.operators.filters import is_blocked
from mentionlake.operators.joins import publisher_domain


def is_atom(body: Column) -> Column:
    return F.contains(body, F.lit("<feed")) & F.contains(body, F.lit("xmlns"))


def _blocks(body: Column, tag: str) -> Column:
    return F.regexp_extract_all(body, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def _coalesce_text(block: Column, *tags: str) -> Column:
    return F.coalesce(*[X.xml_text(block, t) for t in tags])


def feed_items(raw_feeds: DataFrame, max_chars: int | None = None) -> DataFrame:
    """One row per feed item with its position; ``raw_feeds``: source_id, body, http_ok.

    Items need a title and a link or guid. Bodies over ``max_chars``, if given, are skipped.
    """
    ok = F.coalesce(F.col("http_ok"), F.lit(True))
    if max_chars is not None:
        ok = ok & (F.length("body") <= max_chars)
    typed = raw_feeds.filter(ok).withColumn("atom", is_atom(F.col("body")))
    blocks = F.when(F.col("atom"), _blocks(F.col("body"), "entry")).otherwise(_blocks(F.col("body"), "item"))
    arrived = F.col("fetched_at") if "fetched_at" in raw_feeds.columns else F.lit(None).cast("timestamp")
    items = typed.select("source_id", arrived.alias("fetched_at"), "atom", F.posexplode(blocks).alias("ordinal", "block"))
    b, atom = F.col("block"), F.col("atom")
    pick = lambda if_atom, if_rss: F.when(atom, if_atom).otherwise(if_rss)
    parsed = items.select(
        "source_id", "fetched_at", "atom", "ordinal",
        X.xml_text(b, "title").alias("title"),
        pick(F.coalesce(X.xml_attr(b, "link", "href"), X.xml_text(b, "link")), X.xml_text(b, "link")).alias("link"),
        F.when(~atom, X.xml_attr(b, "source", "url")).alias("source_url"),
        pick(_coalesce_text(b, "summary", "content"), X.xml_text(b, "description")).alias("description"),
        F.when(~atom, _coalesce_text(b, "content:encoded", "content")).alias("content"),
        pick(_coalesce_text(b, "published", "updated"), _coalesce_text(b, "pubDate", "dc:date")).alias("pub_date"),
        pick(_coalesce_text(b, "name", "author"), _coalesce_text(b, "dc:creator", "author")).alias("author"),
        pick(X.xml_text(b, "id"), X.xml_text(b, "guid")).alias("guid"),
        F.when(~atom, F.coalesce(X.xml_attr(b, "media:content", "url"), X.xml_attr(b, "media:thumbnail", "url"))).alias("image_url"),
    )
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return parsed.filter(filled("title") & (filled("link") | filled("guid")))


def ingest_feeds(raw_feeds: DataFrame, sources: DataFrame, as_of, max_age_days: int = 7, strict_dates: bool = True) -> DataFrame:
    """Feed items of the last days as candidates with their source attributes.

    Undated items stay. An unreadable date stays NULL; with ``strict_dates=False``
    it becomes ``as_of``.
    """
    date = D.parse_date(F.col("pub_date"))
    items = feed_items(raw_feeds).withColumn("published_at", date)
    fresh = F.col("published_at").isNull() | (F.col("published_at") >= D.days_before(as_of, max_age_days))
    dim = sources.select(
        F.col("id").alias("source_id"), F.col("name").alias("src_name"), F.col("domain").alias("src_domain"),
        F.col("rss_url").alias("src_feed"), F.col("language").alias("src_language"), "country_code", "fetch_priority",
    )
    joined = items.filter(fresh).join(dim, "source_id", "left")
    feed_domain = F.coalesce("src_domain", U.domain_of(F.col("src_feed")))
    published = F.col("published_at") if strict_dates else F.coalesce("published_at", D.as_timestamp(as_of))
    return joined.select(
        "source_id", "fetched_at", "ordinal", "title", F.coalesce("link", F.lit("")).alias("url"), "description", "content", "author",
        published.alias("published_at"), X.first_non_empty(F.col("src_name"), F.col("src_domain")).alias("source_name"),
        feed_domain.alias("source_url"), F.coalesce(U.domain_of(F.col("link")), feed_domain).alias("source_domain"),
        "image_url", F.coalesce("src_language", F.lit("en")).alias("language"), F.lit("web").alias("media_type"),
        F.col("country_code").alias("country"), F.lit("rss").alias("ingestion_source"), F.lit("rss").alias("connector"),
        U.legacy_hash(F.coalesce("link", "guid")).alias("external_id"), "guid", "fetch_priority",
    )


def ingest_search_feed(raw_feeds: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Aggregator results: publisher from the title suffix, its domain from the name
    table first and the ``<source url>`` second. Results are trusted, not keyword-filtered."""
    items = feed_items(raw_feeds)
    headline, publisher = X.split_publisher(F.col("title"))
    by_name = publisher_domain(publisher, case_sensitive)
    domain = F.coalesce(by_name, U.domain_of(F.col("source_url")), F.lit("news.google.com"))
    return items.select(
        "source_id", "ordinal", headline.alias("title"), F.coalesce("link", F.lit("")).alias("url"), "description",
        publisher.alias("source_name"), domain.alias("source_domain"), D.parse_date(F.col("pub_date")).alias("published_at"),
        F.lit("rss").alias("ingestion_source"), U.legacy_hash(F.coalesce("link", "guid")).alias("external_id"),
        F.lit("search_feed").alias("discovery_method"),
    )


def discovery_items(raw_feeds: DataFrame, as_of, block: bool = True) -> DataFrame:
    """Discovery variant: canonical URL, plain-text snippet of 500 characters, date from
    the item or else from the URL, blocked hosts removed."""
    items = feed_items(raw_feeds).withColumn("link", F.coalesce("link", "guid"))
    out = items.select(
        "source_id", "ordinal", X.strip_markup(F.col("title")).alias("title"), U.canonical_url(F.col("link")).alias("url"),
        F.substring(X.strip_markup(F.coalesce("description", F.lit(""))), 1, 500).alias("snippet"),
        F.coalesce(D.parse_date(F.col("pub_date")), D.date_from_url(F.col("link"), as_of)).alias("published_at"),
        U.domain_of(F.col("link")).alias("source_domain"),
    )
    return out.filter(~is_blocked(F.col("url"))) if block else out
