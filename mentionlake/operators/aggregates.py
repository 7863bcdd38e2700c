"""The numbers on the screens: counts, trends, shares and rankings.

Every operator is one pass with conditional aggregation: partial counts are
combined on the map side, so hot groups shuffle one row per task. Period
predicates are plain comparisons on ``published_at`` and reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mentionlake import constants as C
from mentionlake.functions import dates as D, text as X, urls as U
from mentionlake.functions.scalars import count_if, literal_table, percent, round_half_up, trend_dir, trend_pct

_TS = "published_at"


def current(as_of, days: int) -> Column:
    return F.col(_TS) >= D.days_before(as_of, days)


def previous(as_of, days: int) -> Column:
    return (F.col(_TS) >= D.days_before(as_of, 2 * days)) & (F.col(_TS) < D.days_before(as_of, days))


def in_period(df: DataFrame, days: int, as_of) -> DataFrame:
    """Articles of the last ``days`` days; undated ones are never in a period."""
    return df.filter(current(as_of, days))


def in_two_periods(df: DataFrame, days: int, as_of) -> DataFrame:
    return df.filter(F.col(_TS) >= D.days_before(as_of, 2 * days))


def source_label(fallback: str = "source_url", source_name: Column | None = None) -> Column:
    """First non-empty of embedded source name, stored name and ``fallback`` column."""
    embedded = F.col("source.name") if source_name is None else source_name
    return F.coalesce(X.first_non_empty(embedded, F.col("source_name"), F.col(fallback)), F.lit("Unknown"))


def mentions(text: Column, terms: list[str]) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(text, F.lit(t))
    return hit


def day_spine(df: DataFrame, days: int, as_of) -> DataFrame:
    """One row per day of the last ``days`` days, ending on the day of ``as_of``."""
    end = F.to_date(D.as_timestamp(as_of))
    return df.sparkSession.range(1, numPartitions=1).select(
        F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day")
    )


def headline_counts(articles: DataFrame, as_of) -> DataFrame:
    ts = F.col(_TS)
    return articles.agg(
        count_if(ts >= D.days_before(as_of, 1)).alias("today"),
        count_if(ts >= D.days_before(as_of, 7)).alias("week"),
        F.count(F.lit(1)).alias("total"),
        count_if(ts < D.days_before(as_of, 30)).alias("archive"),
    )


def period_kpis(articles: DataFrame, days: int, as_of, brand: list[str]) -> DataFrame:
    """Total, positive share, unique sources and brand mentions, with trends."""
    cur, prev = current(as_of, days), previous(as_of, days)
    text = X.joined_lower(F.col("title"), F.col("description"))
    named = mentions(text, [b.lower() for b in brand])
    positive = F.col("sentiment") == "positive"
    base = in_two_periods(articles, days, as_of).agg(
        count_if(cur).alias("total"), count_if(prev).alias("prev_total"),
        count_if(cur & positive).alias("positive"), count_if(prev & positive).alias("prev_positive"),
        F.count_distinct(F.when(cur, source_label())).alias("unique_sources"),
        count_if(cur & named).alias("brand"), count_if(prev & named).alias("prev_brand"),
    )
    c = F.col
    return base.select(
        "total", trend_pct(c("total"), c("prev_total")).alias("total_pct"), trend_dir(c("total"), c("prev_total")).alias("total_dir"),
        percent(c("positive"), c("total")).alias("positive_share"),
        trend_pct(c("positive"), c("prev_positive")).alias("positive_pct"),
        trend_dir(c("positive"), c("prev_positive")).alias("positive_dir"),
        "unique_sources", "brand",
        trend_pct(c("brand"), c("prev_brand")).alias("brand_pct"), trend_dir(c("brand"), c("prev_brand")).alias("brand_dir"),
    )


def sentiment_split(df: DataFrame) -> DataFrame:
    """Counts of positive, negative and everything else as neutral."""
    label = F.when(F.col("sentiment").isin("positive", "negative"), F.col("sentiment")).otherwise("neutral")
    return df.groupBy(label.alias("sentiment")).agg(F.count(F.lit(1)).alias("articles"))


def daily_volume(articles: DataFrame, days: int, as_of) -> DataFrame:
    """Zero-filled daily totals by sentiment. A missing sentiment counts in the total only."""
    s = F.col("sentiment")
    counts = in_period(articles, days, as_of).groupBy(F.to_date(_TS).alias("day")).agg(
        F.count(F.lit(1)).alias("total"),
        *[count_if(s == name).alias(name) for name in ("positive", "neutral", "negative")],
    )
    return day_spine(articles, days, as_of).join(counts, "day", "left").fillna(0)


def top_sources(df: DataFrame, k: int = 10, fallback: str = "source_url") -> DataFrame:
    return (
        df.groupBy(source_label(fallback).alias("name")).agg(F.count(F.lit(1)).alias("articles"))
        .orderBy(F.col("articles").desc(), "name").limit(k)
    )


def top_countries(df: DataFrame, k: int = 10) -> DataFrame:
    country = F.coalesce(F.nullif(F.col("source.country_code"), F.lit("")), F.lit("Unknown"))
    return df.groupBy(country.alias("country")).agg(F.count(F.lit(1)).alias("articles")).orderBy(F.col("articles").desc(), "country").limit(k)


def geo_markers(df: DataFrame, coords: dict[str, tuple[float, float]] = C.COUNTRY_COORDS) -> DataFrame:
    """Article count and marker radius per country with known coordinates.

    The coordinate table is a code constant, hence the broadcast.
    """
    rows = [(cc, float(x), float(y)) for cc, (x, y) in coords.items()]
    table = literal_table(df.sparkSession, "country string, longitude double, latitude double", rows)
    counts = df.groupBy(F.col("source.country_code").alias("country")).agg(F.count(F.lit(1)).alias("articles"))
    located = counts.join(F.broadcast(table), "country")
    largest = located.select(F.greatest(F.max("articles"), F.lit(1))).scalar()
    return located.withColumn("radius", F.lit(4.0) + F.lit(10.0) * F.col("articles") / largest)


def top_authors(df: DataFrame, k: int = 8) -> DataFrame:
    author = X.first_non_empty(F.col("author"), F.col("author_name"))
    return (
        df.select(author.alias("author")).filter(F.length("author") > 2).groupBy("author")
        .agg(F.count(F.lit(1)).alias("articles")).orderBy(F.col("articles").desc(), "author").limit(k)
    )


def keyword_share(df: DataFrame, k: int = 10) -> DataFrame:
    """Top keywords with their share of all keyword hits."""
    hits = df.select(F.explode("matched_keywords").alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("hits"))
    # The total is summed from the counts, whose exchange both uses share: one scan.
    total = hits.select(F.coalesce(F.sum("hits"), F.lit(0))).scalar()
    return (
        hits.orderBy(F.col("hits").desc(), "keyword").limit(k)
        .withColumn("share", percent(F.col("hits"), total))
    )


def share_of_voice(articles: DataFrame, entities: dict[str, list[str]], days: int, as_of) -> DataFrame:
    """Mentions per entity in this and the previous period, with share and trend.

    All entities and both periods are counted in one aggregation over one scan;
    an article may count for several entities.
    """
    cur, prev = current(as_of, days), previous(as_of, days)
    text = X.joined_lower(F.col("title"), F.col("description"))
    scoped = in_two_periods(articles, days, as_of).select(
        cur.alias("cur"), prev.alias("prev"),
        *[mentions(text, [t.lower() for t in terms]).alias(f"e{i}") for i, terms in enumerate(entities.values())],
    )
    aggs = []
    for i in range(len(entities)):
        aggs += [count_if(F.col("cur") & F.col(f"e{i}")).alias(f"n{i}"), count_if(F.col("prev") & F.col(f"e{i}")).alias(f"p{i}")]
    one = scoped.agg(*aggs)
    total = F.lit(0).cast("bigint")
    for i in range(len(entities)):
        total = total + F.col(f"n{i}")
    rows = [
        F.struct(F.lit(name).alias("entity"), F.col(f"n{i}").alias("mentions"), F.col(f"p{i}").alias("prev_mentions"), total.alias("all"))
        for i, name in enumerate(entities)
    ]
    m, p = F.col("mentions"), F.col("prev_mentions")
    return one.select(F.inline(F.array(*rows))).select(
        "entity", "mentions", "prev_mentions", percent(m, F.col("all")).alias("share"),
        trend_pct(m, p).alias("trend_pct"), trend_dir(m, p).alias("trend_dir"),
    ).orderBy(m.desc(), "entity")


def sov_daily(articles: DataFrame, entities: dict[str, list[str]], days: int, as_of) -> DataFrame:
    """Daily mentions, one column per entity, over the last ``days`` days."""
    text = X.joined_lower(F.col("title"), F.col("description"))
    counts = in_period(articles, days, as_of).groupBy(F.to_date(_TS).alias("day")).agg(
        *[count_if(mentions(text, [t.lower() for t in terms])).alias(name) for name, terms in entities.items()]
    )
    return day_spine(articles, days, as_of).join(counts, "day", "left").fillna(0)


def source_quality(df: DataFrame, k: int = 10, compat: bool = False) -> DataFrame:
    """Positive rate and quality tier of the top sources. ``compat``: the
    ``Unknown`` bucket always shows a rate of 0."""
    pos = count_if(F.col("sentiment") == "positive")
    grouped = df.groupBy(source_label().alias("name")).agg(F.count(F.lit(1)).alias("articles"), pos.alias("pos"))
    rate = F.col("pos") / F.col("articles")
    if compat:
        rate = F.when(F.col("name") == "Unknown", F.lit(0.0)).otherwise(rate)
    tier = F.when(rate > 0.5, "High").when(rate > 0.25, "Medium").otherwise("Low")
    return grouped.orderBy(F.col("articles").desc(), "name").limit(k).select(
        "name", "articles", round_half_up(rate * 100).alias("positive_rate"), tier.alias("tier")
    )


def owned_kpis(articles: DataFrame, days: int, as_of) -> DataFrame:
    cur, prev = current(as_of, days), previous(as_of, days)
    owned = F.coalesce(F.col("source_category") == "owned", F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(cur & owned, F.coalesce(F.col(c), F.lit(0))).cast("bigint")), F.lit(0)).alias(c)
    base = in_two_periods(articles, days, as_of).agg(
        count_if(cur & owned).alias("posts"), count_if(prev & owned).alias("prev_posts"), count_if(cur & ~owned).alias("earned"),
        total("impressions"), total("engagement_score"), total("clicks"),
    )
    p, q = F.col("posts"), F.col("prev_posts")
    return base.withColumns({"posts_pct": trend_pct(p, q), "posts_dir": trend_dir(p, q)})


def owned_calendar(articles: DataFrame, days: int, as_of) -> DataFrame:
    owned = F.coalesce(F.col("source_category") == "owned", F.lit(False))
    counts = in_period(articles, days, as_of).groupBy(F.to_date(_TS).alias("day")).agg(
        count_if(owned).alias("owned"), count_if(~owned).alias("earned")
    )
    return day_spine(articles, days, as_of).join(counts, "day", "left").fillna(0)


def pipeline_health(articles: DataFrame, runs: DataFrame, topics: DataFrame, registry: DataFrame, as_of) -> DataFrame:
    """One row of pipeline counters; each table is aggregated once."""
    day_ago = D.days_before(as_of, 1)
    routed = F.col("topic_id").isNotNull()
    run_stats = runs.agg(
        F.max(F.when(F.col("status") == "success", F.col("completed_at"))).alias("last_success"),
        count_if((F.col("status") == "failed") & (F.col("started_at") >= day_ago)).alias("failed"),
    )
    return articles.agg(
        count_if(routed).alias("total_articles"), count_if(routed & (F.col("fetched_at") >= day_ago)).alias("last_24h")
    ).select(
        "total_articles", "last_24h",
        run_stats.select("last_success").scalar().alias("last_success"),
        topics.agg(count_if(F.col("is_active"))).scalar().alias("active_topics"),
        run_stats.select("failed").scalar().alias("failed_runs_24h"),
        registry.agg(count_if(F.col("feed_url").isNotNull() & F.col("active"))).scalar().alias("rss_feeds"),
    )


def api_usage(runs: DataFrame, as_of, metadata_ddl: str | None = None) -> DataFrame:
    """Calls per connector over 30 days from the run metadata, plus the run total.

    Rows and the total come from one pass: each run contributes its calls and
    one ``_total_runs`` row.
    """
    from mentionlake.schemas import RUN_METADATA_DDL

    meta = F.from_json("metadata", metadata_ddl or RUN_METADATA_DDL)
    calls = F.transform(F.coalesce(meta["sources"], F.array()), lambda s: F.substring_index(F.coalesce(s["source"], F.lit("")), "-", 1))
    names = F.concat(calls, F.array(F.lit("_total_runs")))
    return (
        runs.filter(F.col("started_at") >= D.days_before(as_of, 30)).select(F.explode(names).alias("api"))
        .groupBy("api").agg(F.count(F.lit(1)).alias("calls"))
    )


def update_match_counts(keywords: DataFrame, inserted: DataFrame) -> DataFrame:
    """Add the number of newly inserted articles that matched each keyword."""
    from mentionlake.operators.matching import keyword_totals

    hits = keyword_totals(inserted).select(F.col("keyword").alias("text"), F.col("n").alias("__n"))
    return keywords.join(hits, "text", "left").withColumn("match_count", F.col("match_count") + F.coalesce("__n", F.lit(0))).drop("__n")


def run_summary(cands: DataFrame, inserted: DataFrame) -> DataFrame:
    """Per connector: fetched, inserted and their difference as duplicates."""
    fetched = cands.select(F.col("ingestion_source").alias("connector"), F.lit(1).alias("f"), F.lit(0).alias("i"))
    kept = inserted.select(F.col("ingestion_source").alias("connector"), F.lit(0).alias("f"), F.lit(1).alias("i"))
    return fetched.unionByName(kept).groupBy("connector").agg(
        F.sum("f").alias("fetched"), F.sum("i").alias("inserted"), (F.sum("f") - F.sum("i")).alias("duplicate")
    )


def update_health(sources: DataFrame, outcomes: DataFrame, error_at: int = 20, degraded_at: int = 1) -> DataFrame:
    """Apply the outcome of the latest fetch per source to its health; of equal dates a success counts.

    ``outcomes``: source_id, ok, at. ``degraded_at=5`` is the discovery variant,
    which leaves the status alone below five failures.
    """
    last = outcomes.groupBy("source_id").agg(F.max(F.struct("at", "ok")).alias("last")).select("source_id", "last.ok", "last.at")
    joined = sources.join(last.withColumnRenamed("source_id", "id"), "id", "left")
    failures = F.when(F.col("ok"), F.lit(0)).when(~F.col("ok"), F.col("consecutive_failures") + 1).otherwise(F.col("consecutive_failures"))
    status = (
        F.when(F.col("ok"), "healthy")
        .when(~F.col("ok") & (failures >= error_at), "error")
        .when(~F.col("ok") & (failures >= degraded_at), "degraded")
        .otherwise(F.col("health_status"))
    )
    return joined.select(
        *[c for c in sources.columns if c not in ("consecutive_failures", "health_status", "last_success_at")],
        failures.cast("int").alias("consecutive_failures"), status.alias("health_status"),
        F.when(F.col("ok"), F.col("at")).otherwise(F.col("last_success_at")).alias("last_success_at"),
    )


def coverage_audit(
    cands: DataFrame, known: DataFrame, outlets: DataFrame | None = None, bodies: DataFrame | None = None,
    inserted: DataFrame | None = None, attempts: DataFrame | None = None,
) -> DataFrame:
    """Per outlet (by default the curated list): distinct candidates, already known (skipped), matched by
    title or body, inserted, methods tried, and methods that found something with their count of finds.

    ``cands``: source_domain, url, discovery_method, matched_keywords. ``bodies``: url, body_keywords of
    scanned pages. ``inserted``: url. ``attempts``: domain, method; methods with finds count as tried.
    Finds are counted before candidates with one canonical URL become one.
    """
    from mentionlake.operators.dedup import first_per_key

    if outlets is None:
        outlets = literal_table(cands.sparkSession, "domain string, name string, region string", C.AUDIT_OUTLETS)

    rows = cands.withColumn("domain", U.normalize_domain("source_domain")).withColumn("canon", U.canonical_url(F.col("url")))
    unique = first_per_key(rows, ["domain", "canon"], [F.col("url").asc(), F.col("discovery_method").asc()])
    seen = known.select(U.canonical_url(F.col("url")).alias("canon")).distinct().withColumn("seen", F.lit(True))
    flagged = unique.join(seen, "canon", "left")
    def marks(urls: DataFrame | None, name: str) -> DataFrame:
        """``flagged`` with whether a row's canonical URL is among ``urls``."""
        if urls is None:
            return flagged.withColumn(name, F.lit(False))
        found = urls.select(U.canonical_url(F.col("url")).alias("canon")).distinct().withColumn(name, F.lit(True))
        return flagged.join(found, "canon", "left").withColumn(name, F.coalesce(name, F.lit(False)))

    flagged = marks(None if bodies is None else bodies.filter(F.size("body_keywords") > 0), "by_body")
    flagged = marks(inserted, "stored")
    matched = (F.size(F.coalesce("matched_keywords", F.array().cast("array<string>"))) > 0) | F.col("by_body")
    fresh = F.col("seen").isNull()
    stats = flagged.groupBy("domain").agg(
        F.count(F.lit(1)).alias("candidates"), count_if(~fresh).alias("skipped"), count_if(fresh & matched).alias("matched"),
        count_if(fresh & matched & F.col("stored")).alias("inserted"),
    )
    finds = rows.groupBy("domain", F.col("discovery_method").alias("method")).agg(F.count(F.lit(1)).alias("n"))
    tried = finds if attempts is None else attempts.select("domain", "method").distinct().join(finds, ["domain", "method"], "full")
    # A handful of methods per outlet.
    methods = tried.groupBy("domain").agg(
        F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods_tried"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("n") > 0, F.concat("method", F.lit("("), F.col("n").cast("string"), F.lit(")"))))), ",").alias("methods_succeeded"),
    )
    return outlets.join(stats, "domain", "left").join(methods, "domain", "left").fillna(
        {"candidates": 0, "skipped": 0, "matched": 0, "inserted": 0, "methods_tried": "", "methods_succeeded": ""}
    )


def discovery_funnel(cands: DataFrame) -> DataFrame:
    """Per stage and in total (stage NULL): raw, strong, body-scanned, accepted, inserted."""
    return cands.rollup("stage").agg(
        F.count(F.lit(1)).alias("raw"),
        count_if(F.col("strength") == "strong").alias("strong"),
        count_if(F.col("matched_via") == "body_scan").alias("body_scanned"),
        count_if(F.col("matched_via") == "ai_classified").alias("classified"),
        count_if(F.col("inserted")).alias("inserted"),
    )


def facets(df: DataFrame) -> DataFrame:
    """Distinct (facet, value) rows for source, country, keyword and language, in one pass."""
    s = lambda name, col: F.struct(F.lit(name).alias("facet"), col.alias("value"))
    fixed = F.array(
        s("source", X.first_non_empty(F.col("source_name"), F.col("source.name"))),
        s("country", X.first_non_empty(F.col("country"), F.col("source.country_code"))),
        s("language", F.col("language")),
    )
    keywords = F.transform(F.coalesce("matched_keywords", F.array().cast("array<string>")), lambda k: s("keyword", k))
    return df.select(F.inline(F.concat(fixed, keywords))).filter(F.coalesce("value", F.lit("")) != "").distinct()


def archive_trend(df: DataFrame, k: int = 60) -> DataFrame:
    """Counts of the last ``k`` days that have articles (no zero fill), oldest first."""
    days = df.filter(F.col(_TS).isNotNull()).groupBy(F.to_date(_TS).alias("day")).agg(F.count(F.lit(1)).alias("articles"))
    return days.orderBy(F.col("day").desc()).limit(k).orderBy("day")


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(count_if(F.col("read_at").isNull()).alias("unread"))


def sources_by_region(df: DataFrame) -> DataFrame:
    """Registry rows with the size of their region's group, ready to be shown grouped.

    Rows rather than one list per region: a region may hold most of the registry.
    """
    sizes = df.groupBy("region").agg(F.count(F.lit(1)).alias("region_sources"))
    return df.join(sizes, "region")


def top_stories(df: DataFrame, k: int = 20) -> DataFrame:
    """Highly relevant or major-outlet articles by score, then date, with rank.

    The limit is a top-k per task; the rank is numbered on the ``k`` survivors.
    """
    from pyspark.sql import Window

    picked = (F.col("relevance_label") == "high") | F.col("is_major_outlet")
    order = [F.coalesce("relevance_score", F.lit(0.5)).desc(), F.col(_TS).desc(), F.col("id").asc()]
    best = df.filter(picked).orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
