"""End-to-end acquisition jobs built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mentionlake.operators import aggregates as A, dedup, enrich, filters, joins, matching, similarity
from mentionlake.sources import feeds


def scheduled_ingest(raw_feeds: DataFrame, sources: DataFrame, topics: DataFrame, known: DataFrame | None, as_of) -> DataFrame:
    """Landed feed bodies to new, routed, de-duplicated articles.

    Parse, keep fresh items in an allowed language, route to topics, keep the
    first arrival per URL, drop stored URLs. Dedup and exclusion shuffle on the
    URL; everything before them is narrow apart from the source dimension.
    """
    cands = feeds.ingest_feeds(raw_feeds, sources, as_of)
    place = [F.col(c).cast("string") for c in ("source_id", "fetched_at", "ordinal", "guid", "url")]
    cands = cands.withColumn("id", F.sha2(F.concat_ws("\x01", *place), 256))
    routed = matching.route_topics(filters.filter_language(cands), topics)
    flagged = filters.flag_major(routed).withColumn("articles_era", filters.era(F.col("published_at"), as_of))
    order = [F.col(c).asc() for c in ("source_id", "fetched_at", "ordinal", "guid", "topic_id")]
    first = dedup.dedup_first(flagged, order)
    return first if known is None else joins.exclude_known(first, known)


def discovery(cands: DataFrame, pages: DataFrame, terms: DataFrame, sources: DataFrame, known: DataFrame, as_of) -> DataFrame:
    """All discovery stages as one job: block, dedup, exclude known, match title and
    URL, match bodies of the rest, resolve sources."""
    order = [F.col("ordinal").asc(), F.col("url").asc()]
    unique = dedup.dedup_canonical(cands, order, known)
    text = F.concat_ws(" ", "title", "snippet", "url")
    matched = matching.match_terms(unique, terms, how="normalized", text=text)
    hit = F.size("matched_keywords") > 0
    direct = matched.filter(hit).withColumn("matched_via", F.lit("title_snippet"))
    body = matching.match_bodies(matched.filter(~hit).drop("matched_keywords"), pages, terms)
    both = direct.unionByName(body, allowMissingColumns=True)
    return joins.resolve_source(filters.filter_recent(both, 30, as_of), sources)


def enrich_batch(articles: DataFrame, scores: DataFrame, as_of) -> DataFrame:
    """Scores, then near-duplicate flags, for the articles still to be enriched."""
    pending = articles.filter(~F.coalesce("is_enriched", F.lit(False)) & ~F.coalesce("is_duplicate", F.lit(False)))
    scored = enrich.merge_scores(pending, scores)
    flags = similarity.near_duplicates(articles.filter(~F.coalesce("is_duplicate", F.lit(False))), as_of)
    return similarity.mark_duplicates(scored, flags).withColumn("is_enriched", F.lit(True))


def insight_period(articles: DataFrame, sources: DataFrame, days: int, as_of, keywords=()) -> DataFrame:
    """Non-duplicate articles of the period with their source, as the insight screens use them."""
    shown = articles.filter(F.col("is_duplicate") == F.lit(False))
    return filters.filter_keywords(A.in_period(joins.with_source(shown, sources), days, as_of), list(keywords))
