"""Publisher registry: priority rules and synchronisation of feed sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mentionlake import constants as C
from mentionlake.functions.scalars import literal_strings
from mentionlake.operators.dedup import first_per_key

# Words of the older keyword rule, highest priority first, as
# (priority, words tested on the name, words tested on the domain).
KEYWORD_RULES = [
    (100, ["press"], ["press"]),
    (90, ["wire", "newswire"], ["wire"]),
    (80, ["tech", "digital"], ["tech"]),
    (70, ["nordic", "scandi", "finland", "sweden", "norway", "denmark", "iceland"], ["nordic", "scandi"]),
    (60, ["europe", "eu "], ["europe", "euronews"]),
    (50, ["energy", "renew", "solar", "wind", "power", "grid", "hydrogen"], ["energy", "renew"]),
]
NORDIC_TLDS = [".fi", ".se", ".no", ".dk", ".is"]
TOPICAL_NAME_WORDS = ["energy", "renew", "ocean", "wave", "tidal", "marine", "hydrogen"]


def _any(value: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.coalesce(F.contains(F.lower(value), F.lit(w)), F.lit(False))
    return hit


def source_priority(name: Column, domain: Column, region: Column | None = None, rules: str = "curated") -> Column:
    """Fetch priority. ``curated``: outlet lists, then topical words. ``keyword``: older word rules."""
    if rules == "curated":
        topical = _any(name, TOPICAL_NAME_WORDS) | _any(domain, ["energy"])
        return F.when(F.array_contains(literal_strings(C.PRIORITY_MAJOR), domain), 100).when(domain.isin(C.PRIORITY_INDUSTRY), 90).when(topical, 50).otherwise(30)
    out = None
    for value, names, domains in KEYWORD_RULES:
        hit = _any(name, names) | _any(domain, domains)
        if value == 70:
            for tld in NORDIC_TLDS:
                hit = hit | F.coalesce(F.endswith(F.lower(domain), F.lit(tld)), F.lit(False))
        if value == 60 and region is not None:
            hit = hit | _any(region, ["europe"])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(30)


def sync_registry(changes: DataFrame, sources: DataFrame) -> DataFrame:
    """New state of ``sources`` after a batch of registry changes.

    ``changes``: registry columns plus ``old_status`` and ``seq``. An approved
    domain upserts the source with its feed URL; a domain that leaves approval
    deactivates all its sources. Per domain and feed the last change counts.
    """
    feed = F.coalesce("feed_url", F.concat(F.lit("https://"), "domain", F.lit("/rss")))
    newest = first_per_key(changes, ["domain"], [F.col("seq").desc()])
    approved = first_per_key(
        newest.filter("approval_status = 'approved'").withColumn("rss_url", feed), ["rss_url"], [F.col("seq").desc()]
    ).select(
        "rss_url",
        F.col("name").alias("n_name"), F.col("domain").alias("n_domain"),
        F.coalesce("source_type", F.lit("rss")).alias("n_source_type"),
        F.coalesce("country_code", F.lit("US")).alias("n_country_code"),
        F.coalesce("region", F.lit("global")).alias("n_region"),
        F.coalesce("language", F.lit("en")).alias("n_language"),
        source_priority(F.col("name"), F.col("domain")).alias("n_fetch_priority"),
        F.lit(True).alias("n_hit"),
    )
    left_approval = newest.filter("approval_status <> 'approved' AND old_status = 'approved'").select(
        "domain", F.lit(True).alias("gone")
    )
    merged = sources.join(approved, "rss_url", "full_outer")
    take = lambda c: F.when(F.col("n_hit"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    upserted = merged.select(
        F.coalesce("id", F.sha2("rss_url", 256)).alias("id"), "rss_url",
        *[take(c) for c in ("name", "domain", "source_type", "country_code", "region", "language", "fetch_priority")],
        F.when(F.col("n_hit"), F.lit(True)).otherwise(F.col("active")).alias("active"),
        F.when(F.col("n_hit"), F.lit("approved")).otherwise(F.col("approval_status")).alias("approval_status"),
        F.coalesce("health_status", F.lit("healthy")).alias("health_status"),
        F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"),
    )
    return upserted.join(left_approval, "domain", "left").withColumn("active", F.col("active") & F.col("gone").isNull()).drop("gone")
