"""Row predicates and projections over the article and registry tables.

Everything here is a narrow, JVM-side expression: no shuffle, and the plain
comparisons reach the Parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from mentionlake import constants as C
from mentionlake.functions import dates as D, text as X, urls as U
from mentionlake.functions.scalars import literal_map, literal_strings, lower_array
from mentionlake.operators.dedup import first_per_key


def language_code(language: Column) -> Column:
    """Primary language subtag; missing means English."""
    return F.lower(F.substring_index(F.coalesce(F.nullif(language, F.lit("")), F.lit("en")), "-", 1))


def filter_language(df: DataFrame, allowed: Sequence[str] = C.ALLOWED_LANGUAGES) -> DataFrame:
    return df.filter(language_code(F.col("language")).isin(list(allowed)))


def is_blocked(
    url: Column, domain: Column | None = None, hosts: list[str] | None = None, paths: list[str] | None = None, whole_url: bool = False
) -> Column:
    """Blocked host (or sub-domain) or blocked path; an unparseable URL is not blocked.

    ``whole_url`` looks for the path patterns anywhere in the URL.
    """
    hosts = C.BLOCKED_HOSTS_MAIN if hosts is None else hosts
    paths = C.BLOCKED_PATHS if paths is None else paths
    hit = U.on_host_list(U.host(url), hosts)
    if domain is not None:
        hit = hit | U.on_host_list(U.normalize_domain(domain), hosts)
    if paths:
        hit = hit | F.coalesce((url if whole_url else U.path(url)).rlike("(?i)" + "|".join(paths)), F.lit(False))
    return hit


#: Hosts, path patterns and place of the patterns, by the job that applies them.
BLOCK_VARIANTS = {
    "main": (C.BLOCKED_HOSTS_MAIN, C.BLOCKED_PATHS, False),
    "model": (C.BLOCKED_HOSTS_MODEL, C.BLOCKED_PATHS_MODEL, True),
    "backfill": (C.BLOCKED_HOSTS_BACKFILL, [], False),
}


def filter_blocked(df: DataFrame, hosts: list[str] | None = None, paths: list[str] | None = None, variant: str | None = None) -> DataFrame:
    """Rows that are not blocked, by own lists or by a named variant."""
    domain = F.col("source_domain") if "source_domain" in df.columns else None
    if variant is not None:
        hosts, paths, whole_url = BLOCK_VARIANTS[variant]
        return df.filter(~is_blocked(F.col("url"), domain, hosts, paths, whole_url))
    return df.filter(~is_blocked(F.col("url"), domain, hosts, paths))


def filter_recent(df: DataFrame, days: int, as_of, keep_null: bool = True) -> DataFrame:
    """Rows at most ``days`` old; undated rows stay unless ``keep_null`` is False."""
    fresh = F.col("published_at") >= D.days_before(as_of, days)
    return df.filter(F.col("published_at").isNull() | fresh if keep_null else fresh)


def era(ts: Column, as_of) -> Column:
    """live up to 7 days, recent up to 30, archive beyond or undated."""
    age = D.age_days(ts, as_of)
    return F.when(age <= 7, "live").when(age <= 30, "recent").otherwise("archive")


def filter_era(df: DataFrame, wanted: str, as_of) -> DataFrame:
    """Screen filter: half-open day ranges, undated rows hidden."""
    ts, week, month = F.col("published_at"), D.days_before(as_of, 7), D.days_before(as_of, 30)
    ranges = {"live": ts >= week, "recent": (ts >= month) & (ts < week), "archive": ts < month}
    return df.filter(ranges[wanted]) if wanted in ranges else df


def visible(df: DataFrame, null_label: str = "keep") -> DataFrame:
    """Neither duplicate nor noise. ``null_label='drop'`` gives the server's
    three-valued reading, in which an unlabelled row is not shown."""
    label = F.col("relevance_label")
    shown = label != "noise"
    if null_label == "keep":
        shown = F.coalesce(shown, F.lit(True))
    return df.filter(~F.coalesce(F.col("is_duplicate"), F.lit(False)) & shown)


def filter_relevance(df: DataFrame, tier: str) -> DataFrame:
    """'high', 'medium' or 'all'; rows not enriched yet always pass, noise never does."""
    label = F.coalesce(F.col("relevance_label"), F.lit(""))
    pending = ~F.coalesce(F.col("is_enriched"), F.lit(False))
    keep = {"high": (label == "high") | pending, "medium": label.isin("high", "medium") | pending}.get(tier, F.lit(True))
    return df.filter(keep & (label != "noise"))


def major_flag(domain: Column, outlets: list[str] = C.MAJOR_OUTLETS, mode: str = "host_suffix") -> Column:
    """Outlet test by host or sub-domain; ``mode='substring'`` repeats the looser legacy test."""
    if mode == "substring":
        return U.contains_any(domain, outlets)
    return U.on_host_list(F.lower(domain), outlets)


def flag_major(df: DataFrame, outlets: list[str] = C.MAJOR_OUTLETS, mode: str = "host_suffix") -> DataFrame:
    return df.withColumn("is_major_outlet", major_flag(F.col("source_domain"), outlets, mode))


def flag_paywalled(
    df: DataFrame, domains: list[str] = C.PAYWALLED_DOMAINS, mode: str = "host_suffix", column: str = "source_url"
) -> DataFrame:
    value = F.lower(F.col(column))
    if mode == "substring":
        return df.withColumn("is_paywalled", U.contains_any(value, domains))
    return df.withColumn("is_paywalled", U.on_host_list(U.normalize_domain(value), domains))


def quick_search(df: DataFrame, q: str, cols: Sequence[str] = ("title", "description")) -> DataFrame:
    """Case-insensitive substring over any of ``cols``; an empty query keeps all rows."""
    if not q:
        return df
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q.lower())), F.lit(False))
    return df.filter(hit)


def _term_hit(text: Column, term: dict, compat: bool) -> Column:
    value = term["value"].lower()
    if term.get("exact") and not compat:
        literal = value.replace(r"\E", r"\E\\E\Q")
        return text.rlike(rf"(?<![A-Za-z0-9_])\Q{literal}\E(?![A-Za-z0-9_])")
    return F.contains(text, F.lit(value))


def search_condition(query: dict, as_of, compat: bool = False) -> Column:
    """Compile a stored search into one boolean Column.

    Default: every AND term, at least one OR term (if any), no NOT term; an
    exact term matches as a whole phrase; languages and explicit dates apply.
    ``compat``: OR behaves as AND, exact changes nothing, languages and explicit
    dates are ignored.
    """
    text = X.joined_lower(F.col("title"), F.col("description"), F.concat_ws(" ", F.col("matched_keywords")))
    cond = F.lit(True)
    either = []
    for term in query.get("terms") or []:
        hit = _term_hit(text, term, compat)
        if term["operator"] == "NOT":
            cond = cond & ~hit
        elif term["operator"] == "OR" and not compat:
            either.append(hit)
        else:
            cond = cond & hit
    if either:
        any_of = either[0]
        for hit in either[1:]:
            any_of = any_of | hit
        cond = cond & any_of
    facets = [
        ("sources", X.first_non_empty(F.col("source.name"), F.col("source_name"))),
        ("countries", F.col("source.country_code")),
        ("sentiments", F.col("sentiment")),
    ]
    if not compat:
        facets.append(("languages", F.col("language")))
    for key, column in facets:
        if query.get(key):
            cond = cond & F.coalesce(column, F.lit("")).isin(list(query[key]))
    if query.get("dateRange", "all") != "all":
        cond = cond & date_range_condition(F.col("published_at"), query["dateRange"], as_of)
    if not compat:
        cond = cond & between_dates(F.col("published_at"), query.get("dateFrom"), query.get("dateTo"))
    return cond


def search(df: DataFrame, query: dict, as_of, compat: bool = False) -> DataFrame:
    """Boolean faceted search over articles that carry the ``source`` struct of ``with_source``."""
    return df.filter(search_condition(query, as_of, compat))


def date_range_condition(ts: Column, name: str, as_of) -> Column:
    """Rolling ranges in days (1d, 7d, 30d) or calendar months (3m, 6m, 1y)."""
    now = D.as_timestamp(as_of)
    if name in ("1d", "7d", "30d"):
        return ts >= D.days_before(as_of, int(name[:-1]))
    months = {"3m": 3, "6m": 6, "1y": 12}.get(name)
    if months is None:
        return ts.isNotNull()
    return ts >= now - F.make_ym_interval(F.lit(0), F.lit(months))


def between_dates(ts: Column, date_from: str | None, date_to: str | None) -> Column:
    """Inclusive day range; the last day counts up to 23:59:59."""
    cond = F.lit(True)
    if date_from:
        cond = cond & (ts >= F.lit(date_from).cast("timestamp"))
    if date_to:
        cond = cond & (ts <= F.lit(f"{date_to} 23:59:59").cast("timestamp"))
    return cond


def keyword_condition(keywords: Sequence[str]) -> Column:
    wanted = literal_strings(sorted({k.lower() for k in keywords}))
    return F.coalesce(F.arrays_overlap(lower_array(F.col("matched_keywords")), wanted), F.lit(False))


def filter_keywords(df: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Any matched keyword equals any selected one, ignoring case; no selection keeps all."""
    return df.filter(keyword_condition(keywords)) if keywords else df


def favourites(df: DataFrame, keywords: Sequence[str], k: int = 10) -> DataFrame:
    """Latest ``k`` articles tagged with, or mentioning, a favourite keyword."""
    text = X.joined_lower(F.col("title"), F.col("description"))
    hit = keyword_condition(keywords) | U.contains_any(text, [x.lower() for x in keywords])
    return df.filter(hit).orderBy(F.col("published_at").desc_nulls_first(), "id").limit(k)


def eligible_sources(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Feeds that may be fetched, highest priority first; all of them unless ``limit`` is given."""
    out = df.filter(
        F.col("active")
        & (F.col("approval_status") == "approved")
        & F.col("rss_url").isNotNull()
        & (F.col("consecutive_failures") < 30)
        & F.col("health_status").isin("healthy", "degraded")
    ).orderBy(F.col("fetch_priority").desc(), "id")
    return out.limit(limit) if limit else out


def tier(df: DataFrame, low: int | None = None, high: int | None = None, column: str = "priority") -> DataFrame:
    """Priority band [low, high)."""
    if low is not None:
        df = df.filter(F.col(column) >= low)
    return df.filter(F.col(column) < high) if high is not None else df


def _phrase_hit(text: Column, phrases: Sequence[str]) -> Column:
    return text.rlike("|".join(re.escape(p) for p in phrases))


def is_off_topic(
    title: Column, keep: Sequence[str] = C.ON_TOPIC_PHRASES, drop: Sequence[str] = C.OFF_TOPIC_PHRASES
) -> Column:
    low = F.lower(title)
    return F.coalesce(~_phrase_hit(low, keep) & _phrase_hit(low, drop), F.lit(False))


def purge_off_topic(
    df: DataFrame, keep: Sequence[str] = C.ON_TOPIC_PHRASES, drop: Sequence[str] = C.OFF_TOPIC_PHRASES
) -> DataFrame:
    """Remove rows whose title has an off-topic phrase and no on-topic one."""
    return df.filter(~is_off_topic(F.col("title"), keep, drop))


def clean_terms(keywords: DataFrame) -> DataFrame:
    """Keep expanded terms made of ASCII letters, digits and simple punctuation; a list with a
    Chinese character anywhere is emptied."""
    foreign = F.exists("expanded_terms", lambda t: t.rlike("[\u4e00-\u9fff]"))
    plain = F.filter(F.col("expanded_terms"), lambda t: t.rlike(r"^[a-zA-Z0-9 \-/.,()]+$"))
    return keywords.withColumn("expanded_terms", F.when(foreign, F.array().cast("array<string>")).otherwise(plain))


def scope_to_user(df: DataFrame, uid) -> DataFrame:
    return df.filter(F.col("user_id") == F.lit(uid))


def scope_runs(runs: DataFrame, topics: DataFrame, uid) -> DataFrame:
    """Runs whose topic belongs to the user."""
    return runs.join(scope_to_user(topics, uid).select("topic_id"), "topic_id", "left_semi")


def filter_registry(df: DataFrame, region="all", country=None, language=None, q="", search_cols=("name", "domain")) -> DataFrame:
    if region != "all":
        df = df.filter(F.col("region") == region)
    if country:
        df = df.filter(F.col("country_code") == country)
    if language:
        df = df.filter(F.col("language") == language)
    return quick_search(df, q, search_cols)


def repair_articles(df: DataFrame, aggregator: str = "news.google.com") -> DataFrame:
    """All data repairs as one projection: tag-like snippets, stray entities,
    missing domains, publisher from the title suffix, suffix removal, major flag."""
    comma_list = (F.col("discovery_method") == "sitemap") & F.col("snippet").rlike("(?s),.*,.*,") & (F.length("snippet") < 200)
    snippet = F.when(F.coalesce(comma_list, F.lit(False)), F.lit(None)).otherwise(F.col("snippet"))
    title = F.replace(F.col("title"), F.lit("&#160;"), F.lit(" "))
    bare = F.regexp_replace(F.regexp_replace(F.col("url"), r"^https?://(www\.)?", ""), "(?s)/.*$", "")
    domain = F.coalesce(F.nullif(F.col("source_domain"), F.lit("")), bare)

    suffix = r"(?s)^(.*) - ([^-]+)$"
    from_title = F.trim(F.regexp_extract(title, suffix, 2))
    headline = F.trim(F.regexp_extract(title, suffix, 1))
    aggregated = (domain == aggregator) & title.rlike(suffix)
    unnamed = F.coalesce(F.col("source_name"), F.lit("")).isin("", aggregator, "Google News")
    name = F.when(aggregated & unnamed, from_title).otherwise(F.col("source_name"))

    fixes = literal_map({n: d for n, d, _ in C.AGGREGATOR_FIXES})
    majors = literal_map({n: m for n, _, m in C.AGGREGATOR_FIXES})
    fixed_domain = F.when(domain == aggregator, F.coalesce(F.try_element_at(fixes, name), domain)).otherwise(domain)
    major = F.coalesce(
        F.when(domain == aggregator, F.try_element_at(majors, name)),
        F.when(F.array_contains(literal_strings(C.MAJOR_OUTLETS), fixed_domain), F.lit(True)),
        F.col("is_major_outlet"),
    )
    exact_suffix = (fixed_domain == aggregator) & (title == F.concat(headline, F.lit(" - "), from_title))
    return df.select(
        *[c for c in df.columns if c not in ("title", "snippet", "source_domain", "source_name", "is_major_outlet")],
        F.when(exact_suffix, headline).otherwise(title).alias("title"),
        F.replace(snippet, F.lit("&#160;"), F.lit(" ")).alias("snippet"),
        fixed_domain.alias("source_domain"),
        name.alias("source_name"),
        major.alias("is_major_outlet"),
    )


def split_strength(cands: DataFrame) -> DataFrame:
    """'strong' when title or snippet matched, 'weak' when only the search query did."""
    strong = (F.col("matched_via") == "title_snippet") & (F.size("matched_keywords") > 0)
    return cands.withColumn("strength", F.when(F.coalesce(strong, F.lit(False)), "strong").otherwise("weak"))


def promote_by_body(split: DataFrame, bodies: DataFrame) -> DataFrame:
    """Weak rows whose body matched become strong and gain the body's keywords;
    a weak row sharing a strong row's canonical URL is dropped.

    ``bodies``: url, canonical_url, body_keywords (output of ``match_bodies``).
    """
    body = bodies.select("url", F.col("canonical_url").alias("body_canonical"), "body_keywords")
    # A page crawled several times gives its keywords once.
    body = first_per_key(body, ["url"], [F.col("body_canonical").asc_nulls_last(), F.col("body_keywords").asc_nulls_last()])
    joined = split.join(body, "url", "left")
    found = (F.col("strength") == "weak") & (F.size(F.coalesce("body_keywords", F.array().cast("array<string>"))) > 0)
    out = joined.select(
        *[c for c in split.columns if c not in ("strength", "matched_via", "matched_keywords", "canonical_url")],
        F.coalesce(F.when(F.col("strength") == "weak", F.col("body_canonical")), F.col("canonical_url")).alias("canonical_url"),
        F.when(found, F.array_union("matched_keywords", "body_keywords")).otherwise(F.col("matched_keywords")).alias("matched_keywords"),
        F.when(found, "body_scan").otherwise(F.col("matched_via")).alias("matched_via"),
        F.when(found, "strong").otherwise(F.col("strength")).alias("strength"),
    )
    strong = out.filter(F.col("strength") == "strong")
    still_weak = out.filter(F.col("strength") == "weak").join(strong.select("canonical_url"), "canonical_url", "left_anti")
    return strong.unionByName(still_weak)


def accept(df: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Scored rows that are relevant and reach the threshold."""
    return df.filter(F.col("relevant") & (F.col("relevance_score") >= threshold))


def order_feed(df: DataFrame) -> DataFrame:
    """Enriched rows first, then newest; id breaks ties."""
    enriched = F.coalesce(F.col("is_enriched"), F.lit(False))
    return df.orderBy(enriched.desc(), F.coalesce("published_at", "fetched_at").desc(), "id")


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """One page (0-based) of an ordered DataFrame, with the number of pages."""
    total = df.select(F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias("pages"))
    return df.offset(number * size).limit(size).withColumn("total_pages", total.scalar())


def latest(df: DataFrame, k: int, by: Sequence[Column], partition: Sequence[str] = ()) -> DataFrame:
    """Newest ``k`` rows, overall or per partition.

    Per partition this plans as a group-limited window: each task keeps ``k``
    rows per key before the shuffle, so a hot key is harmless.
    """
    if not partition:
        return df.orderBy(*by).limit(k)
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(*by))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)
