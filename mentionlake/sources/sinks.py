"""Sinks: insert-ignore, upsert-merge, CSV export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from mentionlake.functions import dates as D, text as X
from mentionlake.operators.dedup import first_per_key
from mentionlake.session import path_exists
from mentionlake.sources.buckets import bucket_of


#: Folders per day of an insert-ignore table.
KEY_BUCKETS = 8
BUCKET_COLUMN = "key_bucket_of_"


def new_rows(existing: DataFrame | None, new: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Rows to append: the first of the batch per key whose key is not stored yet.

    Stored keys are first cut down to those of the batch. Catalyst broadcasts a batch that it
    knows to be small, so the stored keys are filtered where they are read and only known keys
    meet the batch; a larger batch is joined by one shuffle, which both joins share.
    """
    first = first_per_key(new.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != ""), [key], order)
    if existing is None:
        return first
    known = existing.select(key).join(first.select(key), key, "left_semi")
    return first.join(known, key, "left_anti")


def upsert_ignore(
    target: str, new: DataFrame, key: str = "url", order: Sequence[Column] | None = None, time_column: str = "published_at", buckets: int = KEY_BUCKETS
) -> int:
    """Append unseen rows to the Parquet table at ``target``, partitioned by day and bucket of the key; returns their number.

    A stored row is never changed. Only the buckets that the batch's keys fall into are searched
    for them, and of these only the key column; a table written without buckets is searched whole
    and goes on without. The name of the folder column tells the number of buckets; it is fixed by the
    first batch. The number of rows comes from the write itself (an observed metric), not from a second count.
    """
    spark = new.sparkSession
    existing = spark.read.parquet(target) if path_exists(spark, target) else None
    column = f"{BUCKET_COLUMN}{buckets}" if existing is None else next((c for c in existing.columns if c.startswith(BUCKET_COLUMN)), None)
    new = new.persist()
    try:
        place = {column: bucket_of(key, int(column.removeprefix(BUCKET_COLUMN)))} if column else {}
        if existing is not None and column:
            # At most as many numbers as there are buckets reach the driver.
            touched = [r[0] for r in new.select(place[column]).distinct().collect()]
            existing = existing.filter(F.col(column).isin(touched))
        rows = new_rows(existing, new, key, order or [F.col(key).asc()])
        seen = Observation()
        # Rebalancing gives few files per folder and splits a day that is much larger than the rest.
        folders = ["day", *place]
        dated = rows.withColumns({"day": F.to_date(time_column)} | place).hint("rebalance", *folders)
        dated.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(*folders).parquet(target)
        return seen.get["n"]
    finally:
        new.unpersist()


def upsert_merge(target: DataFrame, new: DataFrame, keys: Sequence[str], update_cols: Sequence[str]) -> DataFrame:
    """Snapshot after an upsert: ``update_cols`` come from ``new`` where the key is
    present, other columns are kept; unknown keys are inserted. ``new`` holds one row per key."""
    incoming = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in new.columns if c not in keys], F.lit(True).alias("__hit"))
    merged = target.join(incoming, list(keys), "full_outer")
    out = []
    for c in target.columns:
        if c in keys or c not in new.columns:
            out.append(F.col(c))
        elif c in update_cols:
            out.append(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.coalesce(F.col(c), F.col(f"__{c}")).alias(c))
    return merged.select(*out)


def apply_updates(target: DataFrame, batch: DataFrame, key: str = "id", order: Sequence[Column] | None = None) -> DataFrame:
    """Overwrite rows of known keys with the latest row of the batch; unknown keys are ignored."""
    newest = first_per_key(batch, [key], order or [F.col(key).asc()])
    known = newest.join(target.select(key), key, "left_semi")
    return upsert_merge(target, known, [key], [c for c in batch.columns if c != key])


# Column sets of the three exports.
EXPORT_LAYOUTS = {
    "analytics": ["Title", "Source", "Country", "Language", "Date", "Sentiment", "Relevance", "Keywords", "URL"],
    "mentions": ["Title", "Source", "Domain", "Country", "Language", "Date", "Sentiment", "Keywords", "URL"],
    "archive": ["Title", "Source", "Date", "Sentiment", "Keywords", "URL"],
}


def export_rows(df: DataFrame, layout: str = "analytics") -> DataFrame:
    """Text columns of an export layout; missing values are empty."""
    optional = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    columns = {
        "Title": F.col("title"),
        "Source": X.first_non_empty(F.col("source.name"), F.col("source_name")),
        "Domain": F.coalesce(optional("source_url"), optional("source_domain")),
        "Country": F.col("source.country_code"),
        "Language": F.col("language"),
        "Date": D.day_text(F.col("published_at")),
        "Sentiment": F.col("sentiment"),
        "Relevance": optional("relevance_label"),
        "Keywords": F.array_join(F.coalesce("matched_keywords", F.array().cast("array<string>")), "; "),
        "URL": F.col("url"),
    }
    return df.select(*[F.coalesce(columns[c], F.lit("")).alias(c) for c in EXPORT_LAYOUTS[layout]])


def export_csv(df: DataFrame, path: str, layout: str = "analytics") -> None:
    """Write part files with every field quoted and quotes doubled."""
    export_rows(df, layout).write.mode("overwrite").option("header", True).option("quoteAll", True).option(
        "escape", '"'
    ).option("emptyValue", "").csv(path)
