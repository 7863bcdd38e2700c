"""Exact de-duplication. Each rule keeps one row per key through a group-limited
window: tasks cut every key to one row before the shuffle, so a key that holds
a third of all rows costs no more than any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from mentionlake.functions import text as X, urls as U


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") == 1).drop("__rank")


def ranked_top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= k)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return ranked_top(df, keys, order, k, "__rank").drop("__rank")


def dedup_first(df: DataFrame, order: Sequence[Column], key: str = "url") -> DataFrame:
    """First arrival per raw URL; empty URLs are dropped."""
    return first_per_key(df.filter(F.coalesce(F.col(key), F.lit("")) != ""), [key], order)


def topic_bridge(routed: DataFrame, key: str = "url") -> DataFrame:
    """Every topic an article was routed to, kept beside the de-duplicated fact; of several keyword
    lists of one topic the first in order stays."""
    return routed.groupBy(key, "topic_id").agg(F.min("matched_keywords").alias("matched_keywords"))


def dedup_canonical(
    df: DataFrame, order: Sequence[Column], known: DataFrame | None = None, block: bool = True
) -> DataFrame:
    """First row per canonical URL after the block filter and the known-URL exclusion.

    Adds ``canonical_url``. The dedup window and the anti-join share one hash
    partitioning of that column.
    """
    from mentionlake.operators.filters import filter_blocked

    rows = filter_blocked(df) if block else df
    first = first_per_key(rows.withColumn("canonical_url", U.canonical_url(F.col("url"))), ["canonical_url"], order)
    if known is None:
        return first
    seen = known.select(U.canonical_url(F.col("url")).alias("canonical_url")).distinct()
    return first.join(seen, "canonical_url", "left_anti")


def dedup_title(df: DataFrame, order: Sequence[Column], n: int = 80) -> DataFrame:
    """First row per leading ``n`` characters of the normalised title."""
    keyed = df.withColumn("__title_key", F.substring(X.normalized(F.coalesce("title", F.lit(""))), 1, n))
    return first_per_key(keyed, ["__title_key"], order).drop("__title_key")


def dedup_topic(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = ("topic_id", "external_id")) -> DataFrame:
    """First row per topic and external id (add ingestion_source for the stored key)."""
    return first_per_key(df, list(keys), order)


def purge_exact(articles: DataFrame) -> DataFrame:
    """Same URL but for trailing slashes and same title: the smallest id stays.
    Rows without URL or title are never duplicates of each other."""
    keyed = articles.withColumn("__url", F.regexp_replace("url", "/+$", ""))
    complete = F.col("url").isNotNull() & F.col("title").isNotNull()
    first = first_per_key(keyed.filter(complete), ["__url", "title"], [F.col("id").asc()])
    return first.unionByName(keyed.filter(~complete)).drop("__url")
