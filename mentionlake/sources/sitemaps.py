"""Sitemaps, news sitemaps and robots.txt."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mentionlake.functions import dates as D, text as X, urls as U
from mentionlake.operators.dedup import ranked_top, top_per_key

# Caps by tier as (items per domain, sitemaps per domain, children
# per index, items per child, items per sitemap), for the two harvest variants.
ALL = 2**31 - 1  # no cap
CAPS_LAST = {"tier1": (200, 6, 5, 50, 60), "other": (100, 4, 3, 50, 60)}
CAPS_FIRST = {"tier1": (120, 4, 3, 40, 50), "other": (60, 2, 1, 20, 25)}
TIER1_PRIORITY = 70
GUESSED_PATHS = ["/sitemap.xml", "/news-sitemap.xml", "/sitemap_index.xml"]


def sitemap_locations(domains: DataFrame, robots: DataFrame) -> DataFrame:
    """Ordered sitemap locations per domain: registered, from robots.txt, guessed.

    ``domains``: domain, sitemap_url; ``robots``: domain, body.
    """
    lines = F.split("body", r"\r?\n")
    listed = F.filter(
        F.transform(lines, lambda l: F.trim(F.regexp_extract(l, r"(?i)^Sitemap:\s*(.+)$", 1))), lambda l: l != ""
    )
    found = domains.join(robots.select("domain", listed.alias("listed")), "domain", "left")
    guesses = F.array(*[F.concat(F.lit("https://"), "domain", F.lit(p)) for p in GUESSED_PATHS])
    empty = F.array().cast("array<string>")
    registered = F.filter(F.array(F.trim(F.coalesce("sitemap_url", F.lit("")))), lambda u: u != "")
    all_urls = F.array_distinct(F.concat(registered, F.coalesce("listed", empty), guesses))
    return found.select("domain", F.posexplode(all_urls).alias("position", "url"))


def sitemap_children(raw: DataFrame) -> DataFrame:
    """(domain, url, child position, child URL, children) of sitemap index bodies."""
    blocks = F.regexp_extract_all("body", F.lit(r"(?is)<sitemap>(.*?)</sitemap>"), F.lit(1))
    locs = F.filter(F.transform(blocks, lambda b: X.xml_tag(b, "loc")), lambda u: u != "")
    return (
        raw.filter(F.col("body").rlike("(?i)<sitemapindex")).withColumn("locs", locs)
        .select("domain", "url", F.size("locs").alias("children"), F.posexplode("locs").alias("child", "child_url"))
    )


def sitemap_items(raw: DataFrame, as_of, url_dates: bool = True, keep_tags: bool = False) -> DataFrame:
    """One row per ``<url>`` entry with a location, with its position and the entry count."""
    blocks = F.regexp_extract_all("body", F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1))
    kept = F.filter(blocks, lambda b: X.xml_tag(b, "loc") != "")
    keep = [c for c in raw.columns if c not in ("domain", "url", "body")]
    rows = raw.filter(F.col("body").rlike("(?i)<urlset")).withColumn("blocks", kept).select(
        *keep, "domain", "url", F.size("blocks").alias("entries"), F.posexplode("blocks").alias("entry", "block")
    )
    b, loc = F.col("block"), X.xml_tag(F.col("block"), "loc")
    title = X.first_non_empty(X.xml_tag(b, "news:title"), U.title_from_slug(loc))
    written = D.parse_date(X.first_non_empty(X.xml_tag(b, "news:publication_date"), X.xml_tag(b, "lastmod")))
    snippet = F.substring(X.strip_markup(X.xml_tag(b, "news:keywords")), 1, 500) if keep_tags else F.lit("")
    return rows.select(
        *keep, "domain", F.col("url").alias("sitemap_url"), "entries", "entry", F.substring(X.strip_markup(title), 1, 220).alias("title"),
        loc.alias("raw_url"), U.canonical_url(loc).alias("url"), snippet.alias("snippet"),
        (F.coalesce(written, D.date_from_url(loc, as_of)) if url_dates else written).alias("published_at"),
        U.normalize_domain("domain").alias("source_domain"),
    )


def ingest_sitemaps(raw: DataFrame, domains: DataFrame, as_of, keep: str = "last", caps: dict | None = None) -> DataFrame:
    """Two-level sitemap harvest: all of it, or with ``caps`` (``CAPS_LAST``, ``CAPS_FIRST``) a part per tier.

    ``raw``: domain, url, body of every landed sitemap; ``domains``: domain,
    priority and, optionally, name. ``keep='last'`` takes the last children and
    entries, ``'first'`` the first ones. The caps are a product rule (how much of
    a site one run looks at), applied by position.
    """
    if caps is None:
        caps = dict.fromkeys(("tier1", "other"), (ALL,) * 5)
    tiered = domains.withColumn("tier", F.when(F.coalesce("priority", F.lit(0)) >= TIER1_PRIORITY, "tier1").otherwise("other"))
    cap = lambda i: F.when(F.col("tier") == "tier1", caps["tier1"][i]).otherwise(caps["other"][i])
    bodies = raw.join(tiered.select("domain", "tier"), "domain")
    position = [F.col("position" if "position" in raw.columns else "url").asc()]
    children = sitemap_children(raw)
    tops = bodies.join(children.select("domain", F.col("child_url").alias("url")), ["domain", "url"], "left_anti")
    ranked = [ranked_top(tops.filter(F.col("tier") == t), ["domain"], position, caps[t][1]) for t in caps]
    chosen = ranked[0].unionByName(ranked[1])

    wanted = children.join(chosen.select("domain", "url", "tier", "rank"), ["domain", "url"])
    wanted = wanted.filter(F.col("child") >= F.col("children") - cap(2) if keep == "last" else F.col("child") < cap(2))
    roles = wanted.select("domain", F.col("child_url").alias("url"), "tier", "rank", "child", cap(3).alias("take")).unionByName(
        chosen.select("domain", "url", "tier", "rank", F.lit(0).alias("child"), cap(4).alias("take"))
    )
    parsed = sitemap_items(raw.select("domain", "url", "body").join(roles, ["domain", "url"]), as_of)
    items = parsed.filter(F.col("entry") >= F.col("entries") - F.col("take") if keep == "last" else F.col("entry") < F.col("take"))
    order = [F.col("rank").asc(), F.col("child").asc(), F.col("entry").asc()]
    limits = {name: values[0] for name, values in caps.items()}
    parts = [top_per_key(items.filter(F.col("tier") == name), ["domain"], order, n) for name, n in limits.items()]
    return parts[0].unionByName(parts[1]).drop("entries", "tier", "rank", "child", "take")
