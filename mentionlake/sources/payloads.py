"""API replies landed as JSON lines, normalised to one candidate schema.

``normalize_payload(raw, kind, as_of)`` takes one reply per row (column
``payload``), explodes its items and projects the common columns. Parsing uses
explicit schemas, so only the needed fields are materialised.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from mentionlake import constants as C
from mentionlake.functions import dates as D, text as X, urls as U
from mentionlake.operators.filters import era, is_blocked, major_flag

# The parts of each reply that are read.
SCHEMAS = {
    "perigon": """articles array<struct<title: string, url: string, description: string, summary: string, content: string,
        pubDate: string, addDate: string, imageUrl: string, language: string, authorsByline: string,
        authors: array<struct<name: string>>, source: struct<name: string, domain: string, country: string>>>""",
    "guardian": """response struct<results: array<struct<webUrl: string, webTitle: string, webPublicationDate: string,
        fields: struct<headline: string, trailText: string, bodyText: string, thumbnail: string, byline: string>>>>""",
    "gdelt": "articles array<struct<title: string, url: string, domain: string, seendate: string, language: string, sourcecountry: string>>",
    "newsapi": """articles array<struct<title: string, url: string, description: string, content: string, author: string,
        urlToImage: string, publishedAt: string, source: struct<name: string>>>""",
    "reddit": """data struct<children: array<struct<data: struct<title: string, permalink: string, selftext: string, subreddit: string,
        author: string, created_utc: double, thumbnail: string, score: int, num_comments: int>>>>""",
    "youtube": """items array<struct<id: struct<videoId: string>, snippet: struct<title: string, description: string,
        channelTitle: string, publishedAt: string,
        thumbnails: struct<medium: struct<url: string>, `default`: struct<url: string>>>>>""",
    "web_search": """data array<struct<url: string, title: string, description: string, publishedDate: string,
        metadata: struct<ogArticlePublishedTime: string, `article:published_time`: string, publishedTime: string,
        publishedDate: string, ogSiteName: string, language: string>>>""",
}
ITEMS = {
    "perigon": "articles", "guardian": "response.results", "gdelt": "articles", "newsapi": "articles",
    "reddit": "data.children.data", "youtube": "items", "web_search": "data",
}
COLUMNS = [
    "title", "url", "snippet", "description", "content", "author", "published_at", "source_name", "source_domain", "source_url",
    "language", "country", "image_url", "media_type", "source_category", "ingestion_source", "discovery_method", "external_id",
    "engagement_score", "comment_count",
]


def _text(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def _perigon(i: Callable[[str], Column], as_of) -> tuple[Column, dict]:
    domain = i("source.domain")
    return (i("title") != "") & (i("url") != "") & (domain != ""), {
        "title": i("title"), "url": i("url"), "description": F.coalesce(i("description"), i("summary")), "content": i("content"),
        "author": F.coalesce(i("authorsByline"), F.try_element_at(i("authors"), F.lit(1))["name"]),
        "published_at": F.coalesce(D.parse_date(F.coalesce(i("pubDate"), i("addDate"))), D.as_timestamp(as_of)),
        "source_name": F.coalesce(i("source.name"), domain), "source_domain": domain, "source_url": domain,
        "language": F.coalesce(i("language"), F.lit("en")), "country": i("source.country"), "image_url": i("imageUrl"),
    }


def _guardian(i, as_of):
    country = F.upper(F.coalesce(F.col("edition"), F.lit("uk")))
    return i("webUrl") != "", {
        "title": F.coalesce(i("fields.headline"), i("webTitle")), "url": i("webUrl"), "description": i("fields.trailText"),
        "content": i("fields.bodyText"), "author": i("fields.byline"), "published_at": D.parse_date(i("webPublicationDate")),
        "source_name": "The Guardian", "source_domain": "theguardian.com", "source_url": "theguardian.com", "language": "en",
        "country": F.when(country.isin("US", "AU"), country).otherwise("GB"), "image_url": i("fields.thumbnail"),
        "ingestion_source": F.concat(F.lit("guardian-"), F.coalesce(F.col("edition"), F.lit("uk"))),
    }


def _gdelt(i, as_of):
    return (i("title") != "") & (i("url") != ""), {
        "title": i("title"), "url": i("url"), "published_at": F.coalesce(D.compact_date(i("seendate")), D.as_timestamp(as_of)),
        "source_name": F.coalesce(i("domain"), F.lit("Unknown")), "source_domain": F.coalesce(U.domain_of(i("url")), i("domain"), F.lit("")),
        "source_url": F.coalesce(i("domain"), F.lit("")), "language": F.coalesce(i("language"), F.lit("en")), "country": i("sourcecountry"),
    }


def _newsapi(i, as_of):
    domain = F.coalesce(U.domain_of(i("url")), F.lit(""))
    return (i("title") != "") & (i("url") != "") & (i("title") != "[Removed]"), {
        "title": i("title"), "url": i("url"), "snippet": i("description"), "description": F.nullif(i("description"), F.lit("")),
        "content": i("content"), "author": i("author"), "image_url": i("urlToImage"),
        "published_at": F.coalesce(D.parse_date(i("publishedAt")), D.as_timestamp(as_of)),
        "source_name": X.first_non_empty(i("source.name"), domain), "source_domain": domain, "source_url": domain,
        "language": "en", "discovery_method": "newsapi",
    }


def _reddit(i, as_of):
    body = F.coalesce(i("selftext"), F.lit(""))
    short = F.concat(F.substring(body, 1, 300), F.when(F.length(body) > 300, "…").otherwise(""))
    return (i("title") != "") & (i("permalink") != ""), {
        "title": i("title"), "url": F.concat(F.lit("https://www.reddit.com"), i("permalink")),
        "description": F.when(body != "", short), "content": i("selftext"), "author": i("author"),
        "published_at": F.timestamp_seconds(i("created_utc")), "source_name": F.concat(F.lit("r/"), i("subreddit")),
        "source_domain": "reddit.com", "source_url": "reddit.com", "language": "en", "media_type": "social",
        "source_category": "social", "image_url": F.when(F.startswith(i("thumbnail"), F.lit("http")), i("thumbnail")),
        "engagement_score": F.coalesce(i("score"), F.lit(0)), "comment_count": F.coalesce(i("num_comments"), F.lit(0)),
    }


def _youtube(i, as_of):
    return (i("snippet.title") != "") & (i("id.videoId") != ""), {
        "title": i("snippet.title"), "url": F.concat(F.lit("https://www.youtube.com/watch?v="), i("id.videoId")),
        "description": F.substring(i("snippet.description"), 1, 300), "content": i("snippet.description"), "author": i("snippet.channelTitle"),
        "published_at": D.parse_date(i("snippet.publishedAt")), "source_name": F.coalesce(i("snippet.channelTitle"), F.lit("YouTube")),
        "source_domain": "youtube.com", "source_url": "youtube.com", "language": "en", "media_type": "video", "source_category": "social",
        "image_url": F.coalesce(i("snippet.thumbnails.medium.url"), i("snippet.thumbnails.default.url")),
        "engagement_score": F.lit(0),
    }


def _web_search(i, as_of):
    url = U.canonical_url(i("url"))
    stated = X.first_non_empty(
        i("metadata.ogArticlePublishedTime"), i("metadata.article:published_time"), i("metadata.publishedTime"),
        i("publishedDate"), i("metadata.publishedDate"),
    )
    domain = U.domain_of(url)
    return (i("url") != "") & ~is_blocked(url, hosts=C.BLOCKED_HOSTS_SEARCH), {
        "title": F.substring(F.coalesce(i("title"), F.lit("")), 1, 220), "url": url,
        "snippet": F.substring(F.coalesce(i("description"), F.lit("")), 1, 500), "description": i("description"),
        "published_at": F.coalesce(D.parse_date(stated), D.date_from_url(url, as_of)),
        "source_name": F.coalesce(i("metadata.ogSiteName"), domain), "source_domain": domain, "source_url": domain,
        "language": F.substring_index(i("metadata.language"), "-", 1), "discovery_method": "web_search",
    }


_KINDS = {
    "perigon": _perigon, "guardian": _guardian, "gdelt": _gdelt, "newsapi": _newsapi, "reddit": _reddit, "youtube": _youtube,
    "web_search": _web_search,
}


def normalize_payload(raw: DataFrame, kind: str, as_of) -> DataFrame:
    """Candidate rows of landed replies of one connector.

    ``raw``: payload (JSON text), plus ``edition`` (guardian) and ``query_keyword``
    (kept when present, as the fallback keyword of searches). Matching is a
    separate step: ``match_terms`` then, per connector, drop unmatched rows
    (newsapi, reddit) or ``with_fallback`` (youtube, web_search).
    """
    if kind == "guardian" and "edition" not in raw.columns:
        raw = raw.withColumn("edition", F.lit("uk"))
    extra = [c for c in ("query_keyword", "edition") if c in raw.columns]
    reply = F.from_json("payload", SCHEMAS[kind])
    items = raw.select(*extra, reply.alias("reply")).select(*extra, F.posexplode(f"reply.{ITEMS[kind]}").alias("ordinal", "item"))

    def field(path: str) -> Column:
        out = F.col("item")
        for part in path.split("."):
            out = out[part]
        return out

    keep, values = _KINDS[kind](field, as_of)
    defaults = {"media_type": "web", "source_category": "media", "ingestion_source": kind, "engagement_score": F.lit(None).cast("int"),
                "comment_count": F.lit(None).cast("int"), "published_at": F.lit(None).cast("timestamp")}
    merged = {**{c: None for c in COLUMNS}, **defaults, **values}
    cols = [(v if isinstance(v, Column) else F.lit(v).cast("string")).alias(c) for c, v in merged.items() if c != "external_id"]
    out = items.filter(F.coalesce(keep, F.lit(False))).select(*extra, "ordinal", *cols)
    return out.withColumns({
        "external_id": U.legacy_hash(F.col("url")), "is_major_outlet": major_flag(F.col("source_domain")),
        "articles_era": era(F.col("published_at"), as_of), "connector": F.lit(kind),
    })


def union_connectors(parts: dict[str, DataFrame], order: list[str] = C.CONNECTOR_ORDER) -> DataFrame:
    """Bag union in arrival order; ``connector_rank`` keeps that order for first-wins dedup."""
    names = [n for n in order if n in parts] + [n for n in parts if n not in order]
    out = None
    for rank, name in enumerate(names):
        part = parts[name].withColumns({"connector": F.lit(name), "connector_rank": F.lit(rank)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
