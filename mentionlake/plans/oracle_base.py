"""The table mappings of ``sources.tables`` in SQL, as named common table expressions.

They are written independently of the DataFrame code so that the two sides check
each other.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

CTES = {
    "src": """
      SELECT s.id, s.name, s.name || '.example.com' AS domain, 'https://' || s.name || '.example.com/rss' AS rss_url,
             n.n_name AS country_code, r.r_name AS region,
             CASE WHEN s.id % 7 = 0 THEN 'approved' WHEN s.id % 6 = 5 THEN 'pending' ELSE 'approved' END AS approval_status,
             s.id % 5 <> 4 AS active,
             CASE WHEN s.id % 4 = 0 THEN 'degraded' WHEN s.id % 9 = 8 THEN 'error' ELSE 'healthy' END AS health_status,
             s.id % 13 AS consecutive_failures, 30 + (s.id % 8) * 10 AS fetch_priority
      FROM (SELECT DISTINCT source AS name, CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS id FROM documents) s
      LEFT JOIN nation n ON n.n_nationkey = s.id % 25
      LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "ev0": """
      SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events""",
    "ev": """
      SELECT event_id AS id, ts AS published_at, ts AS fetched_at, user_id % 25 AS source_id, user_id,
             CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative'
                  WHEN event_type = 'view' THEN 'neutral' END AS sentiment,
             CASE WHEN k % 3 = 0 AND k % 5 <> k % 12 THEN ['kw' || (k % 12), 'kw' || (k % 5)] ELSE ['kw' || (k % 12)] END AS matched_keywords,
             CASE WHEN user_id % 10 = 0 THEN 'owned' WHEN user_id % 10 = 1 THEN 'social' ELSE 'media' END AS source_category,
             CAST(floor(value * 100) AS BIGINT) AS impressions, CAST(floor(value) AS BIGINT) AS clicks,
             CASE WHEN k % 4 <> 0 THEN CAST(k AS BIGINT) END AS engagement_score,
             CASE WHEN event_id % 11 <> 0 THEN event_id % 13 = 0 END AS is_duplicate,
             'Author ' || (user_id % 40) AS author_name, CASE WHEN event_id % 6 = 0 THEN '' END AS author,
             CASE WHEN user_id % 9 = 0 THEN '' ELSE 'feed-' || (user_id % 7) END AS source_name,
             event_type AS topic_id, 'Event ' || event_type || ' by user ' || user_id AS title
      FROM ev0""",
    "doc": """
      SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title, d.text AS description,
             'https://' || d.source || '.example.com/' || d.lang || '/' || (d.n_chars % 500)
               || CASE WHEN d.doc_id % 2 = 0 THEN '?utm_source=feed' ELSE '' END AS url,
             d.lang AS language, d.source AS source_name, CAST(regexp_extract(d.source, '([0-9]+)$', 1) AS BIGINT) AS source_id,
             d.source || '.example.com' AS source_domain,
             TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(d.doc_id % 60 AS INTEGER)) - to_hours(d.doc_id % 24) AS published_at,
             TIMESTAMP '2024-01-31 01:00:00' - to_days(CAST(d.doc_id % 60 AS INTEGER)) - to_hours(d.doc_id % 24) AS fetched_at,
             CASE WHEN quality = 1 AND toxic = 0 THEN 'high' WHEN quality = 1 AND toxic = 1 THEN 'medium'
                  WHEN quality = 0 AND toxic = 0 THEN 'low' WHEN quality = 0 AND toxic = 1 THEN 'noise' END AS relevance_label,
             CASE WHEN quality = 1 AND toxic = 0 THEN 0.9::DOUBLE WHEN quality = 1 AND toxic = 1 THEN 0.6::DOUBLE
                  WHEN quality = 0 AND toxic = 0 THEN 0.3::DOUBLE WHEN quality = 0 AND toxic = 1 THEN 0.1::DOUBLE END AS relevance_score,
             CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' WHEN quality IS NOT NULL THEN 'neutral' END AS sentiment,
             quality IS NOT NULL AS is_enriched,
             CAST(regexp_extract(d.source, '([0-9]+)$', 1) AS BIGINT) % 10 = 0 AS is_major_outlet,
             CASE WHEN d.doc_id % 11 <> 0 THEN d.doc_id % 13 = 0 END AS is_duplicate,
             ['kw' || (d.doc_id % 12)] AS matched_keywords,
             CASE WHEN d.doc_id % 5 = 0 THEN CAST([] AS VARCHAR[]) WHEN quality = 1 AND toxic = 0 THEN ['th' || (d.doc_id % 7)] END AS key_themes,
             CASE CAST(regexp_extract(d.source, '([0-9]+)$', 1) AS BIGINT) % 10 WHEN 3 THEN 'owned' WHEN 7 THEN 'social' ELSE 'media' END AS source_category,
             d.doc_id % 6 AS topic_id,
             CASE d.doc_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'gdelt' ELSE 'newsapi' END AS connector,
             30 + (CAST(regexp_extract(d.source, '([0-9]+)$', 1) AS BIGINT) % 8) * 10 AS fetch_priority
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "docs": """
      SELECT doc.*, src.name AS s_name, src.country_code, src.region FROM doc LEFT JOIN src ON src.id = doc.source_id""",
    "evs": """
      SELECT ev.*, src.name AS s_name, src.country_code, src.region FROM ev LEFT JOIN src ON src.id = ev.source_id""",
    "pg": """
      SELECT page_id AS id, page_id AS ordinal, url, html, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
             regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS source_domain,
             CASE page_id % 4 WHEN 0 THEN 'sitemaps' WHEN 1 THEN 'tier2' WHEN 2 THEN 'sources' ELSE 'firecrawl' END AS stage,
             regexp_extract(url, '^(https?://[^/?#]+)', 1)
               || CASE WHEN regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') = '' THEN '/'
                       ELSE regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') END
               || CASE WHEN len(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'),
                        lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','oc','ref','fbclid','gclid'))) > 0
                       THEN '?' || array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'),
                        lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','oc','ref','fbclid','gclid')), '&')
                       ELSE '' END AS canon
      FROM pages""",
    "reg": """
      SELECT s.s_suppkey AS seq,
             s.s_name || CASE s.s_suppkey % 10 WHEN 0 THEN ' Energy' WHEN 3 THEN ' Press' WHEN 6 THEN ' Tech' ELSE '' END AS name,
             CASE WHEN s.s_suppkey % 50 = 7 THEN 'reuters.com' WHEN s.s_suppkey % 50 = 9 THEN 'renews.biz'
                  ELSE replace(lower(s.s_name), '#', '-') || '.example.com' END AS domain,
             n.n_name AS country_code, r.r_name AS region, CASE WHEN s.s_suppkey % 3 = 0 THEN 'fr' ELSE 'en' END AS language,
             CASE WHEN s.s_suppkey % 6 <> 0 THEN 'https://feeds.example.com/' || s.s_suppkey END AS feed_url,
             CASE WHEN s.s_suppkey % 4 = 0 THEN 'pending' ELSE 'approved' END AS approval_status,
             s.s_suppkey % 7 <> 0 AS active, 20 + s.s_suppkey % 80 AS priority
      FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "runs": """
      SELECT strftime(CAST(ts AS DATE), '%Y%m%d') || '-' || event_type AS run_id, event_type AS topic_id,
             CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
             min(ts) AS started_at, max(ts) AS completed_at, count(*) AS articles_fetched, count(DISTINCT user_id) AS articles_inserted
      FROM events GROUP BY CAST(ts AS DATE), event_type""",
    "topics": """
      SELECT DISTINCT event_type AS topic_id, 'Topic ' || event_type AS name, event_type <> 'signup' AS is_active,
             CASE WHEN event_type < 'f' THEN 1 ELSE 2 END AS user_id
      FROM events""",
}
NEEDS = {"ev": ["ev0"], "docs": ["doc", "src"], "evs": ["ev0", "ev", "src"]}


def sql(tables: str, body: str, **extra: str) -> str:
    """``body`` preceded by the named mappings (and extra CTEs) it reads."""
    names: list[str] = []
    for t in tables.split():
        for n in [*NEEDS.get(t, []), t]:
            if n not in names:
                names.append(n)
    parts = [f"{n} AS ({CTES[n]})" for n in names] + [f"{n} AS ({b})" for n, b in extra.items()]
    return (("WITH " + ",\n".join(parts) + "\n") if parts else "") + body


def trend(cur: str, prev: str) -> tuple[str, str]:
    """(absolute percentage, direction) expressions for two counts."""
    pct = f"(CASE WHEN {prev} = 0 THEN 0 ELSE CAST(floor(({cur} - {prev})::DOUBLE / {prev} * 100 + 0.5::DOUBLE) AS BIGINT) END)"
    return f"abs({pct})", f"CASE WHEN {pct} > 0 THEN 'up' WHEN {pct} < 0 THEN 'down' ELSE 'flat' END"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST(floor({part}::DOUBLE / {whole} * 100 + 0.5::DOUBLE) AS BIGINT) ELSE 0 END"
