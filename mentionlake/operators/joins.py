"""Joins between articles, dimensions, runs and user data.

No side is hinted as broadcast unless its size has a bound: Catalyst and AQE
measure the dimension and either broadcast it or shuffle (splitting skewed
partitions), so a registry that outgrows memory still works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mentionlake import constants as C
from mentionlake.functions import dates as D, text as X, urls as U
from mentionlake.functions.scalars import count_if, literal_map
from mentionlake.operators.dedup import first_per_key

HOT_KEYS = 1000


def skewed_lookup(big: DataFrame, counts: DataFrame, key: str, size: str = "n") -> DataFrame:
    """Inner join of ``big`` with one row per key, safe for very frequent keys.

    The ``HOT_KEYS`` most frequent keys are looked up by broadcast (a bounded
    table); every other key then holds at most 1/HOT_KEYS of the rows and is
    shuffled normally.
    """
    hottest = F.broadcast(counts.orderBy(F.col(size).desc(), key).limit(HOT_KEYS))
    marked = big.join(hottest, key, "left")
    added = [c for c in counts.columns if c != key]
    hot = marked.filter(F.col(size).isNotNull())
    rest = marked.filter(F.col(size).isNull()).drop(*added).join(counts, key)
    return hot.unionByName(rest)


def with_source(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Embed the source as a struct; articles without one keep NULL."""
    dim = sources.select(F.col("id").alias("source_id"), F.struct("name", "region", "country_code").alias("source"))
    return articles.join(dim, "source_id", "left")


def resolve_source(cands: DataFrame, sources: DataFrame, tie: str = "max_priority") -> DataFrame:
    """Attach source_id by normalised domain. Several sources may share a domain:
    ``max_priority`` takes the highest priority, ``first``/``last`` the lowest/highest id."""
    order = {
        "max_priority": [F.col("fetch_priority").desc(), F.col("id").asc()],
        "first": [F.col("id").asc()],
        "last": [F.col("id").desc()],
    }[tie]
    dim = first_per_key(
        sources.filter(F.coalesce("active", F.lit(True)))
        .withColumn("__dom", U.normalize_domain(F.coalesce("domain", F.lit(""))))
        .filter("__dom <> ''"),
        ["__dom"], order,
    ).select("__dom", F.col("id").alias("source_id"))
    return (
        cands.drop("source_id").withColumn("__dom", U.normalize_domain("source_domain")).join(dim, "__dom", "left").drop("__dom")
    )


def exclude_known(cands: DataFrame, articles: DataFrame) -> DataFrame:
    """Candidates whose canonical URL is in no stored article (the whole table is consulted)."""
    known = articles.select(U.canonical_url(F.col("url")).alias("__canon")).distinct()
    return cands.withColumn("__canon", U.canonical_url(F.col("url"))).join(known, "__canon", "left_anti").drop("__canon")


def discover_domains(
    cands: DataFrame, sources: DataFrame, registry: DataFrame, order: str = "ordinal", hosts: list[str] | None = None
) -> DataFrame:
    """New publisher domains: not a source, not blocked, not registered yet."""
    blocked = C.BLOCKED_HOSTS_MAIN if hosts is None else hosts
    found = (
        cands.filter(F.col("source_domain").isNotNull())
        .select(U.normalize_domain("source_domain").alias("domain"), "source_name", order)
        .filter((F.col("domain") != "") & ~U.on_host_list(F.col("domain"), blocked))
        .groupBy("domain")
        .agg(F.min_by("source_name", order).alias("first_name"), F.count(F.lit(1)).alias("articles"))
    )
    known = (
        sources.select(U.normalize_domain("domain").alias("domain"))
        .unionByName(registry.select(U.normalize_domain("domain").alias("domain")))
        .filter(F.col("domain").isNotNull())
    )
    return found.join(known, "domain", "left_anti").select(
        "domain",
        X.first_non_empty(F.col("first_name"), F.col("domain")).alias("name"),
        "articles",
        F.lit("pending").alias("approval_status"),
        F.lit(True).alias("auto_discovered"),
        F.lit(False).alias("active"),
        F.lit(30).alias("priority"),
    )


def publisher_domain(name: Column, case_sensitive: bool = False, table: dict[str, str] = C.PUBLISHER_DOMAINS) -> Column:
    """Domain of a known publisher name from the fixed table, else NULL."""
    return F.try_element_at(literal_map(table), name if case_sensitive else F.lower(F.trim(name)))


def resolve_publisher(df: DataFrame, publishers: DataFrame | None = None, case_sensitive: bool = False) -> DataFrame:
    """Fill source_domain from the publisher name (fixed table, or a ``name, domain``
    dimension) and set the major-outlet flag from the result."""
    from mentionlake.operators.filters import major_flag

    if publishers is None:
        mapped = df.withColumn("__dom", publisher_domain(F.col("source_name"), case_sensitive))
    else:
        fold = (lambda c: c) if case_sensitive else F.lower
        dim = publishers.select(fold(F.col("name")).alias("__name"), F.col("domain").alias("__dom")).groupBy("__name").agg(F.min("__dom").alias("__dom"))
        mapped = df.withColumn("__name", fold(F.col("source_name"))).join(dim, "__name", "left").drop("__name")
    resolved = F.coalesce("__dom", "source_domain")
    return mapped.withColumn("source_domain", resolved).drop("__dom").withColumn(
        "is_major_outlet", major_flag(F.col("source_domain"))
    )


def with_annotations(df: DataFrame, bookmarks: DataFrame, tags: DataFrame, notes: DataFrame, uid) -> DataFrame:
    """One user's view: bookmark flag, number of tags and notes, latest note.

    The full lists stay in rows (``annotation_rows``), so an article with very
    many annotations never becomes one oversized value.
    """
    mine = lambda t: t.filter(F.col("user_id") == F.lit(uid))
    bm = mine(bookmarks).select(F.col("article_id").alias("id")).distinct().withColumn("is_bookmarked", F.lit(True))
    tg = mine(tags).groupBy(F.col("article_id").alias("id")).agg(F.count_distinct("tag").alias("tag_count"))
    nt = mine(notes).groupBy(F.col("article_id").alias("id")).agg(
        F.count(F.lit(1)).alias("note_count"), F.max_by("content", F.struct("created_at", "content")).alias("latest_note")
    )
    return df.join(bm, "id", "left").join(tg, "id", "left").join(nt, "id", "left").fillna(
        {"is_bookmarked": False, "tag_count": 0, "note_count": 0}
    )


def annotation_rows(tags: DataFrame, notes: DataFrame, uid) -> DataFrame:
    """All tags and notes of a user, one row each (tags unique per article)."""
    mine = lambda t: t.filter(F.col("user_id") == F.lit(uid))
    tag_rows = mine(tags).select("article_id", F.lit("tag").alias("kind"), F.col("tag").alias("value")).distinct()
    note_rows = mine(notes).select("article_id", F.lit("note").alias("kind"), F.col("content").alias("value"))
    return tag_rows.unionByName(note_rows)


def toggle_bookmarks(existing: DataFrame, toggles: DataFrame) -> DataFrame:
    """Apply toggles: a (user, article) pair stays when it was set an odd number of times."""
    pairs = existing.select("user_id", "article_id").distinct().unionByName(toggles.select("user_id", "article_id"))
    odd = F.count(F.lit(1)) % 2 == 1
    return pairs.groupBy("user_id", "article_id").agg(odd.alias("on")).filter("on").drop("on")


def saved_only(df: DataFrame, bookmarks: DataFrame, uid) -> DataFrame:
    mine = bookmarks.filter(F.col("user_id") == F.lit(uid)).select(F.col("article_id").alias("id"))
    return df.join(mine, "id", "left_semi")


def topic_alignment(df: DataFrame, k: int = 12) -> DataFrame:
    """Themes of owned posts with owned and earned counts; an empty theme list
    does not fall back to keywords, a missing one does."""
    themes = F.coalesce("key_themes", "matched_keywords")
    owned = F.col("source_category") == "owned"
    return (
        df.select(F.coalesce(owned, F.lit(False)).alias("owned"), F.explode(themes).alias("theme"))
        .groupBy("theme")
        .agg(count_if(F.col("owned")).alias("owned"), count_if(~F.col("owned")).alias("earned"))
        .filter(F.col("owned") > 0)
        .orderBy((F.col("owned") + F.col("earned")).desc(), "theme")
        .limit(k)
    )


def recent_runs(runs: DataFrame, topics: DataFrame, k: int = 5) -> DataFrame:
    """Latest runs with topic name and duration; the limit precedes the join."""
    newest = runs.orderBy(F.col("started_at").desc(), "run_id").limit(k)
    seconds = F.floor((F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1_000_000).cast("bigint")
    return newest.join(topics.select("topic_id", F.col("name").alias("topic_name")), "topic_id", "left").withColumn(
        "duration_seconds", seconds
    )


def topic_activity(topics: DataFrame, articles: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Active topics with their article count of the last days, in one aggregated join."""
    recent = (
        articles.filter(F.col("fetched_at") >= D.days_before(as_of, days))
        .groupBy("topic_id").agg(F.count(F.lit(1)).alias("articles_last_days"))
    )
    return topics.filter("is_active").join(recent, "topic_id", "left").fillna({"articles_last_days": 0})


def apply_retention(tables: dict[str, DataFrame], days: int, as_of) -> dict[str, DataFrame]:
    """Drop articles older than ``days`` and their child rows; undated articles stay.

    ``tables['articles']`` is keyed by id, every other table by article_id. The
    expired ids, normally the smaller side, are what the children are checked against.
    """
    old = F.coalesce(F.col("published_at") < D.days_before(as_of, days), F.lit(False))
    articles = tables["articles"]
    expired = articles.filter(old).select(F.col("id").alias("article_id"))
    out = {"articles": articles.filter(~old)}
    for name, child in tables.items():
        if name != "articles":
            out[name] = child.join(expired, "article_id", "left_anti")
    return out


def merge_expansions(keywords: DataFrame, proposals: DataFrame, force: bool = False) -> DataFrame:
    """Store proposed terms: trimmed, lower-cased, distinct, longer than one
    character and different from the keyword; only where none exist unless forced."""
    props = proposals.select(F.lower("keyword").alias("__kw"), F.col("terms").alias("__terms")).groupBy("__kw").agg(F.min("__terms").alias("__terms"))
    cleaned = F.array_distinct(F.transform("__terms", lambda t: F.lower(F.trim(t))))
    cleaned = F.filter(cleaned, lambda t: (F.length(t) > 1) & (t != F.lower("text")))
    empty = F.size(F.coalesce("expanded_terms", F.array().cast("array<string>"))) == 0
    take = F.col("__terms").isNotNull() & (F.size("__terms") > 0) & (F.lit(force) | empty)
    return (
        keywords.withColumn("__kw", F.lower("text")).join(props, "__kw", "left")
        .withColumn("expanded_terms", F.when(take, cleaned).otherwise(F.col("expanded_terms")))
        .drop("__kw", "__terms")
    )


def new_suggestions(suggestions: DataFrame, keywords: DataFrame) -> DataFrame:
    """Suggestions that equal no existing keyword, ignoring case."""
    have = keywords.select(F.lower("text").alias("__kw")).distinct()
    return suggestions.withColumn("__kw", F.lower("keyword")).join(have, "__kw", "left_anti").drop("__kw")
