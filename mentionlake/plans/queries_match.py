"""Queries over keyword matching, de-duplication, clustering and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from mentionlake.functions.scalars import count_if, literal_table
from mentionlake.functions import text as X
from mentionlake.operators import dedup, enrich, filters, joins, matching, similarity
from mentionlake.operators import aggregates as A
from mentionlake.plans import ingest
from mentionlake.plans.oracle_base import AS_OF as SQL_NOW, sql
from mentionlake.sources import pages as P, tables as T

NOW = T.AS_OF
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


TERM_ROWS = [(kw, t) for _, kw, xs in T.KEYWORDS for t in [kw, *xs]]
_TERMS = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}')" for k, t in TERM_ROWS) + ") v(keyword, term)"
_WORD_RE = "'(^|[^A-Za-z0-9_])' || term || '($|[^A-Za-z0-9_])'"
_NORM = "trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _strip(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, char in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " ")):
        out = f"regexp_replace({out}, '(?i)&{name};', '{char}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def _normal(x: str) -> str:
    return _NORM.format(x=_strip(x))


def terms(s):
    return matching.term_table(T.keywords(s))


# --- matching -----------------------------------------------------------------
_M1 = f"""SELECT id, array_to_string(list_sort(list(DISTINCT keyword)), '|') AS keywords FROM doc JOIN terms
  ON contains(lower(title || ' ' || description), term) AND regexp_matches(lower(title || ' ' || description), {_WORD_RE})
  WHERE length(term) >= 4 GROUP BY id"""


def _matched(df, key="id"):
    return df.filter(F.size("matched_keywords") > 0).select(key, F.array_join("matched_keywords", "|").alias("keywords"))


@query("match_word", sql("doc", _M1, terms=_TERMS))
def match_word(s, d):
    return _matched(matching.match_terms(T.articles_from_documents(s, d), terms(s), how="word"))


@query("match_word_joined", sql("doc", _M1, terms=_TERMS))
def match_word_joined(s, d):
    """The same through the equi-join plan that large dictionaries use."""
    return _matched(matching.match_terms(T.articles_from_documents(s, d), terms(s), how="word", max_inline=0))


_BENCH = "SELECT DISTINCT w AS keyword, w AS term FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS w FROM benchmark) WHERE length(w) >= 4"


@query("match_corpus_dictionary", sql("", """SELECT keyword, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS w
  FROM documents) JOIN terms ON terms.term = w GROUP BY 1""", terms=_BENCH))
def match_corpus_dictionary(s, d):
    """A dictionary taken from a table (all words of ``benchmark``), larger than the inline limit."""
    words = T.read(s, d, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z0-9_]+")).alias("term")).distinct()
    table = words.filter(F.length("term") >= 4).select(F.col("term").alias("keyword"), "term")
    docs = T.read(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return matching.keyword_totals(matching.match_terms(docs, table, how="word", text=F.col("text"), max_inline=100))


_M2 = """SELECT id, array_to_string(list_sort(list(DISTINCT keyword)), '|') AS keywords FROM hay JOIN terms ON contains(hay.n, terms.term) GROUP BY id"""
_HAY2 = f"SELECT id, {_normal(chr(34) + 't' + chr(34))} AS n FROM (SELECT id, title || '  ' || url AS t FROM pg)"


@query("match_normalized", sql("pg", _M2, terms=_TERMS, hay=_HAY2))
def match_normalized(s, d):
    text = F.concat_ws(" ", "title", "snippet", "url")
    return _matched(matching.match_terms(T.candidates_from_pages(s, d), terms(s), how="normalized", text=text))


@query("match_normalized_joined", sql("pg", _M2, terms=_TERMS, hay=_HAY2))
def match_normalized_joined(s, d):
    text = F.concat_ws(" ", "title", "snippet", "url")
    return _matched(matching.match_terms(T.candidates_from_pages(s, d), terms(s), how="normalized", text=text, max_inline=0))


_M3 = """SELECT id, array_to_string(list_sort(list(DISTINCT keyword)), '|') AS keywords FROM (SELECT conv_id || '-' || turn AS id,
  lower(split_part(text, chr(10), 1) || ' ' || text) AS n FROM conversations) hay JOIN terms ON contains(hay.n, terms.term) GROUP BY id"""


@query("social_mentions", sql("", _M3, terms=_TERMS))
def social_mentions(s, d):
    return _matched(matching.match_terms(T.social_posts(s, d), terms(s), how="substring"))


@query("social_mentions_joined", sql("", _M3, terms=_TERMS))
def social_mentions_joined(s, d):
    return _matched(matching.match_terms(T.social_posts(s, d), terms(s), how="substring", max_inline=0))


_BROAD = ["anti", "euxou", "ierre"]
_TOPICS = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, [{', '.join(repr(k) for k in ks)}], [{', '.join(repr(x) for x in src)}])" for i, _, ks, src in T.TOPICS) + ") v(topic_id, keywords, sources)"


@query("route_topics", sql("doc", """SELECT id, CAST(topic_id AS VARCHAR) AS topic_id, CASE WHEN len(kws) > 0 THEN 'exact' ELSE 'broad' END AS route,
  array_to_string(list_sort(kws), '|') AS keywords FROM m
  WHERE len(kws) > 0 OR (fetch_priority >= 80 AND (""" + " OR ".join(f"contains(txt, '{b}')" for b in _BROAD) + "))", topics=_TOPICS,
  m="""SELECT doc.id, topics.topic_id, fetch_priority, lower(title || ' ' || description) AS txt, list_filter(keywords,
    lambda k: regexp_matches(lower(title || ' ' || description), '(^|[^A-Za-z0-9_])' || k || '($|[^A-Za-z0-9_])')) AS kws
    FROM doc JOIN topics ON list_contains(sources, connector)"""))
def route_topics(s, d):
    out = matching.route_topics(T.articles_from_documents(s, d), T.topic_rules(s), _BROAD)
    return out.select("id", "topic_id", "route", F.array_join("matched_keywords", "|").alias("keywords"))


def _readable_sql(h: str) -> str:
    out = f"CASE WHEN regexp_matches({h}, '(?is)<body[^>]*>.*?</body>') THEN regexp_extract({h}, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE {h} END"
    for tag in P.CHROME:
        out = f"regexp_replace({out}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '(?i)&[a-z#0-9]+;', ' ', 'g'), '\\s+', ' ', 'g'))"


READABLE = _readable_sql("html")
_BODY = f"SELECT id, url, {READABLE} AS body FROM pg"
_BODY_MATCH = f"""SELECT b.id, array_to_string(list_sort(list(DISTINCT keyword)), '|') AS keywords FROM (SELECT id, {_NORM.format(x='body')} AS n FROM b) b
  JOIN terms ON contains(b.n, terms.term) GROUP BY b.id"""


@query("match_bodies", sql("pg", "SELECT id, keywords, 'body_scan' AS matched_via FROM bm WHERE id NOT IN (SELECT id FROM t)", terms=_TERMS, b=_BODY, bm=_BODY_MATCH,
  hay=_HAY2, t=_M2))
def match_bodies(s, d):
    cands = T.candidates_from_pages(s, d)
    text = F.concat_ws(" ", "title", "snippet", "url")
    left = matching.match_terms(cands, terms(s), how="normalized", text=text).filter(F.size("matched_keywords") == 0).drop("matched_keywords")
    out = matching.match_bodies(left, P.extract_pages(T.read(s, d, "pages"), NOW), terms(s))
    return out.select("id", F.array_join("matched_keywords", "|").alias("keywords"), "matched_via")


@query("fallback_keyword", sql("pg", "SELECT pg.id, coalesce(t.keywords, 'general') AS keywords FROM pg LEFT JOIN t USING (id)", terms=_TERMS, hay=_HAY2, t=_M2))
def fallback_keyword(s, d):
    text = F.concat_ws(" ", "title", "snippet", "url")
    m = matching.match_terms(T.candidates_from_pages(s, d), terms(s), how="normalized", text=text)
    return matching.with_fallback(m, F.lit("general")).select("id", F.array_join("matched_keywords", "|").alias("keywords"))


_SPLIT = """SELECT pg.id, pg.canon, t.keywords IS NOT NULL AS strong, t.keywords AS tk, bm.keywords AS bk FROM pg LEFT JOIN t USING (id) LEFT JOIN bm USING (id)"""


def _split(s, d):
    from mentionlake.functions.urls import canonical_url

    cands = T.candidates_from_pages(s, d).withColumn("canonical_url", canonical_url(F.col("url")))
    text = F.concat_ws(" ", "title", "snippet", "url")
    m = matching.match_terms(cands, terms(s), how="normalized", text=text)
    hit = F.size("matched_keywords") > 0
    m = m.withColumn("matched_via", F.when(hit, "title_snippet").otherwise("search_query"))
    return filters.split_strength(matching.with_fallback(m, F.lit("query")))


def _bodies(s, d):
    page = P.extract_pages(T.read(s, d, "pages"), NOW).select("url", "canonical_url", "body_text")
    return matching.match_terms(page, terms(s), how="normalized", text=F.col("body_text"), key="url", out="body_keywords")


@query("promote_by_body", sql("pg", """SELECT id, CASE WHEN strong OR bk IS NOT NULL THEN 'strong' ELSE 'weak' END AS strength,
  CASE WHEN strong THEN 'title_snippet' WHEN bk IS NOT NULL THEN 'body_scan' ELSE 'search_query' END AS matched_via,
  CASE WHEN strong THEN tk WHEN bk IS NOT NULL THEN 'query|' || bk ELSE 'query' END AS keywords FROM s
  WHERE strong OR bk IS NOT NULL OR canon NOT IN (SELECT canon FROM s WHERE strong OR bk IS NOT NULL)""",
  terms=_TERMS, hay=_HAY2, t=_M2, b=_BODY, bm=_BODY_MATCH, s=_SPLIT))
def promote_by_body(s, d):
    out = filters.promote_by_body(_split(s, d), _bodies(s, d))
    return out.select("id", "strength", "matched_via", F.array_join("matched_keywords", "|").alias("keywords"))


@query("discovery_funnel", sql("pg", """SELECT stage, count(*) AS raw, count(*) FILTER (strong OR bk IS NOT NULL) AS strong, count(*) FILTER (NOT strong AND bk IS NOT NULL) AS body_scanned,
  0 AS classified, count(*) FILTER (rn = 1 AND (strong OR bk IS NOT NULL)) AS inserted FROM (SELECT s.*, pg.stage, row_number() OVER (PARTITION BY s.canon ORDER BY s.id) AS rn
  FROM s JOIN pg USING (id) WHERE strong OR bk IS NOT NULL OR s.canon NOT IN (SELECT canon FROM s WHERE strong OR bk IS NOT NULL)) GROUP BY ROLLUP (stage)""",
  terms=_TERMS, hay=_HAY2, t=_M2, b=_BODY, bm=_BODY_MATCH, s=_SPLIT))
def discovery_funnel(s, d):
    promoted = filters.promote_by_body(_split(s, d), _bodies(s, d))
    first = dedup.first_per_key(promoted, ["canonical_url"], [F.col("id").asc()]).select("id", F.lit(True).alias("first"))
    rows = promoted.join(first, "id", "left").withColumn("inserted", F.coalesce("first", F.lit(False)) & (F.col("strength") == "strong"))
    return A.discovery_funnel(rows)


_AUD = """SELECT id, source_domain AS domain, canon, stage, id IN (SELECT id FROM t) AS hit, canon IN (SELECT canon FROM pg WHERE contains(url, '/fr/')) AS seen,
  canon IN (SELECT canon FROM pg WHERE id % 5 = 2) AS body, canon IN (SELECT canon FROM pg WHERE id % 3 = 0) AS stored,
  row_number() OVER (PARTITION BY source_domain, canon ORDER BY url, stage) AS rn FROM pg"""


@query("coverage_audit", sql("pg", """SELECT o.domain, count(rn) AS candidates, count(*) FILTER (seen) AS skipped, count(*) FILTER (NOT seen AND (hit OR body)) AS matched,
  count(*) FILTER (NOT seen AND (hit OR body) AND stored) AS inserted,
  coalesce((SELECT string_agg(DISTINCT m, ',' ORDER BY m) FROM (SELECT source_domain AS d, stage AS m FROM pg UNION ALL SELECT 'bbc.com', 'feed') x WHERE x.d = o.domain), '') AS methods_tried,
  coalesce((SELECT string_agg(stage || '(' || n || ')', ',' ORDER BY stage || '(' || n || ')') FROM (SELECT source_domain AS d, stage, count(*) AS n FROM pg GROUP BY 1, 2) x WHERE x.d = o.domain), '') AS methods_succeeded
  FROM (SELECT DISTINCT source_domain AS domain FROM pg UNION ALL SELECT 'bbc.com') o
  LEFT JOIN (SELECT * FROM a WHERE rn = 1) a USING (domain) GROUP BY 1""", terms=_TERMS, hay=_HAY2, t=_M2, a=_AUD))
def coverage_audit(s, d):
    text = F.concat_ws(" ", "title", "snippet", "url")
    cands = matching.match_terms(T.candidates_from_pages(s, d), terms(s), how="normalized", text=text)
    known = T.read(s, d, "pages").filter(F.contains("url", F.lit("/fr/"))).select("url")
    outlets = cands.select(F.col("source_domain").alias("domain")).distinct().unionByName(literal_table(s, "domain string", [("bbc.com",)]))
    scanned = cands.filter("id % 5 = 2").select("url", F.array(F.lit("kw")).alias("body_keywords"))
    tried = literal_table(s, "domain string, method string", [("bbc.com", "feed")])
    return A.coverage_audit(cands, known, outlets, scanned, cands.filter("id % 3 = 0").select("url"), tried)


# --- source resolution -----------------------------------------------------------
_PGSRC = "SELECT source_domain AS domain, min(id) AS lo, max(id) AS hi FROM pg WHERE contains(url, '/en/') GROUP BY 1"


@query("resolve_source", sql("pg", "SELECT pg.id, p.lo AS first_id, p.hi AS last_id FROM pg LEFT JOIN p ON p.domain = pg.source_domain", p=_PGSRC))
def resolve_source(s, d):
    cands = T.candidates_from_pages(s, d)
    src = cands.filter(F.contains("url", F.lit("/en/"))).select("id", F.concat(F.lit("https://www."), "source_domain", F.lit("/x")).alias("domain"), F.lit(True).alias("active"), F.lit(30).alias("fetch_priority"))
    first = joins.resolve_source(cands, src, "first").select("id", F.col("source_id").alias("first_id"))
    last = joins.resolve_source(cands, src, "last").select("id", F.col("source_id").alias("last_id"))
    return first.join(last, "id")


@query("exclude_known", sql("pg", "SELECT id FROM pg WHERE canon NOT IN (SELECT canon FROM pg WHERE contains(url, 'utm_source'))"))
def exclude_known(s, d):
    cands = T.candidates_from_pages(s, d)
    return joins.exclude_known(cands, cands.filter(F.contains("url", F.lit("utm_source")))).select("id")


@query("discover_domains", sql("pg", """SELECT source_domain AS domain, arg_min('Site ' || source_domain, ordinal) AS name, count(*) AS articles, 'pending' AS approval_status, 30 AS priority
  FROM pg WHERE source_domain NOT LIKE '%.example.org' AND source_domain NOT LIKE 'blog.%' GROUP BY 1"""))
def discover_domains(s, d):
    cands = T.candidates_from_pages(s, d)
    known = cands.filter(F.startswith("source_domain", F.lit("blog."))).select(F.col("source_domain").alias("domain"))
    out = joins.discover_domains(cands, known, known, hosts=["example.org"])
    return out.select("domain", "name", "articles", "approval_status", "priority")


@query("resolve_publisher", sql("doc", """SELECT id, CASE id % 4 WHEN 0 THEN 'reuters.com' WHEN 1 THEN 'elpais.com' ELSE source_domain END AS source_domain, id % 4 < 2 AS is_major_outlet FROM doc"""))
def resolve_publisher(s, d):
    a = T.articles_from_documents(s, d)
    name = F.when(F.col("id") % 4 == 0, "REUTERS").when(F.col("id") % 4 == 1, "El País").otherwise(F.col("source_name"))
    return joins.resolve_publisher(a.withColumn("source_name", name)).select("id", "source_domain", "is_major_outlet")


# --- exact de-duplication -----------------------------------------------------------
@query("dedup_first", sql("doc", "SELECT min(id) AS id, url FROM doc GROUP BY url"))
def dedup_first(s, d):
    return dedup.dedup_first(T.articles_from_documents(s, d), [F.col("id").asc()]).select("id", "url")


@query("topic_bridge", sql("doc", "SELECT DISTINCT url, topic_id FROM doc"))
def topic_bridge(s, d):
    return dedup.topic_bridge(T.articles_from_documents(s, d)).select("url", "topic_id")


@query("dedup_canonical", sql("pg", """SELECT min(id) AS id, canon AS canonical_url FROM pg WHERE NOT regexp_matches(canon, '/(live|video)/')
  GROUP BY canon HAVING canon NOT IN (SELECT canon FROM pg WHERE contains(url, '/es/'))"""))
def dedup_canonical(s, d):
    cands = T.candidates_from_pages(s, d)
    known = cands.filter(F.contains("url", F.lit("/es/")))
    return dedup.dedup_canonical(cands, [F.col("id").asc()], known).select("id", "canonical_url")


@query("dedup_title", sql("pg", f"SELECT min(id) AS id FROM (SELECT id, substr({_normal('title')}, 1, 80) AS k FROM pg) GROUP BY k"))
def dedup_title(s, d):
    return dedup.dedup_title(T.candidates_from_pages(s, d), [F.col("id").asc()]).select("id")


@query("dedup_topic", sql("doc", "SELECT min(id) AS id, topic_id, source_name FROM doc GROUP BY topic_id, source_name"))
def dedup_topic(s, d):
    return dedup.dedup_topic(T.articles_from_documents(s, d), [F.col("id").asc()], ["topic_id", "source_name"]).select("id", "topic_id", "source_name")


@query("purge_exact", sql("doc", "SELECT min(id) AS id FROM (SELECT id, title, rtrim(CASE WHEN id % 2 = 1 THEN url || '/' ELSE replace(url, '?utm_source=feed', '') END, '/') AS u FROM doc) GROUP BY u, title"))
def purge_exact(s, d):
    a = T.articles_from_documents(s, d)
    url = F.when(F.col("id") % 2 == 1, F.concat("url", F.lit("/"))).otherwise(F.replace("url", F.lit("?utm_source=feed"), F.lit("")))
    return dedup.purge_exact(a.withColumn("url", url)).select("id")


# --- near duplicates and clusters -----------------------------------------------------
_WORDS = """SELECT id, published_at, fetched_at, list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g')), '\\s+'),
  lambda w: length(w) > 3)) AS ws FROM doc"""
_PAIRS = """SELECT a.id AS a, b.id AS b, a.published_at AS pa, b.published_at AS pb FROM w a JOIN w b ON a.id <> b.id AND len(a.ws) > 0 AND len(b.ws) > 0
  AND len(list_intersect(a.ws, b.ws))::DOUBLE / greatest(len(a.ws), len(b.ws)) > {t}"""


@query("near_duplicates", sql("doc", """SELECT w.id, count(p.b) > 0 AS is_duplicate, arg_min(p.b, (p.pb, p.b)) AS duplicate_of
  FROM w LEFT JOIN (SELECT * FROM p WHERE (pb, b) < (pa, a)) p ON p.a = w.id GROUP BY w.id""", w=_WORDS, p=_PAIRS.format(t="0.65")))
def near_duplicates(s, d):
    return similarity.near_duplicates(T.articles_from_documents(s, d), NOW, window_days=None)


@query("near_duplicates_week", sql("doc", """SELECT w.id, count(p.b) > 0 AS is_duplicate FROM w LEFT JOIN (SELECT * FROM p WHERE pb <= pa) p ON p.a = w.id GROUP BY w.id""",
  w=_WORDS + f" WHERE published_at >= {SQL_NOW} - INTERVAL 7 DAY", p=_PAIRS.format(t="0.65")))
def near_duplicates_week(s, d):
    """The date-only tie rule on the last week: equal-dated twins flag each other."""
    return similarity.near_duplicates(T.articles_from_documents(s, d), NOW, window_days=7, compat=True).select("id", "is_duplicate")


@query("story_clusters", sql("doc", """SELECT id, c AS story_cluster_id FROM (SELECT w.id, min(r.b) AS c FROM w JOIN r ON r.a = w.id GROUP BY w.id)""",
  w=_WORDS + f" WHERE fetched_at >= {SQL_NOW} - INTERVAL 7 DAY", p=_PAIRS.format(t="0.5"),
  r="SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b").replace("WITH doc AS", "WITH RECURSIVE doc AS"))
def story_clusters(s, d):
    return similarity.cluster_stories(T.articles_from_documents(s, d), NOW, window_days=7)


@query("enrich_batch", sql("doc", f"""SELECT n.id, n.is_duplicate, CASE WHEN quality IS NULL THEN 'medium' WHEN quality = 1 THEN 'high' ELSE 'low' END AS relevance_label
  FROM (SELECT w.id, count(p.b) > 0 AS is_duplicate FROM w LEFT JOIN (SELECT * FROM p WHERE (pb, b) < (pa, a)) p ON p.a = w.id GROUP BY w.id) n
  LEFT JOIN labels l ON l.doc_id = n.id WHERE n.id IN (SELECT id FROM doc WHERE NOT is_enriched)""",
  w=_WORDS + f" WHERE published_at >= {SQL_NOW} - INTERVAL 7 DAY AND NOT coalesce(is_duplicate, false)", p=_PAIRS.format(t="0.65")))
def enrich_batch(s, d):
    scores = T.read(s, d, "labels").select(
        F.col("doc_id").alias("id"), F.lit(0.9).alias("relevance_score"), F.when(F.col("quality") == 1, "high").otherwise("low").alias("relevance_label"),
        F.lit("").alias("relevance_reason"), F.lit("neutral").alias("sentiment"), F.lit(0.0).alias("sentiment_score"),
    )
    a = filters.filter_recent(T.articles_from_documents(s, d), 7, NOW)
    return ingest.enrich_batch(a, scores, NOW).select("id", "is_duplicate", "relevance_label")


# --- corpus statistics ------------------------------------------------------------------
_TERMS_OF = """SELECT DISTINCT id, term FROM (SELECT id, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM
  (SELECT id, list_filter(string_split(""" + _NORM.format(x="{x}") + """, ' '), lambda w: length(w) > 3) AS ws FROM doc))"""


@query("suggest_keywords", sql("doc", """SELECT keyword, in_matched, in_other, ((in_matched + 1) * ((SELECT count(*) FROM m WHERE NOT hit) + 2))::DOUBLE /
  ((in_other + 1) * ((SELECT count(*) FROM m WHERE hit) + 2)) AS odds FROM c WHERE in_matched >= 5 AND keyword NOT IN (SELECT lower(keyword) FROM terms WHERE keyword = term)
  ORDER BY odds DESC, in_matched DESC, keyword LIMIT 8""", terms=_TERMS,
  m=f"SELECT id, bool_or(coalesce(regexp_matches(lower(title || ' ' || description), {_WORD_RE}), false)) AS hit FROM doc CROSS JOIN terms GROUP BY id",
  t=_TERMS_OF.replace("{x}", "title || ' ' || description"), c="SELECT term AS keyword, count(*) FILTER (hit) AS in_matched, count(*) FILTER (NOT hit) AS in_other FROM t JOIN m USING (id) GROUP BY 1"))
def suggest_keywords(s, d):
    m = matching.match_terms(T.articles_from_documents(s, d), terms(s), how="word")
    return enrich.suggest_keywords(m, T.keywords(s), text=F.concat_ws(" ", "title", "description"))


@query("propose_expansions", sql("doc", """SELECT keyword, term, n_both, lift FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY lift DESC, n_both DESC, term) AS rn FROM (
  SELECT keyword, term, n_both, (n_both * (SELECT count(*) FROM doc))::DOUBLE / (n_term * n_keyword) AS lift FROM (
    SELECT keyword, term, count(*) AS n_both FROM t JOIN m USING (id) GROUP BY 1, 2) JOIN (SELECT term, count(*) AS n_term FROM t GROUP BY 1) USING (term)
    JOIN (SELECT keyword, count(*) AS n_keyword FROM m GROUP BY 1) USING (keyword) WHERE n_both >= 3 AND term <> keyword)) WHERE rn <= 10""", terms=_TERMS,
  m=f"SELECT DISTINCT id, keyword FROM doc JOIN terms ON regexp_matches(lower(title || ' ' || description), {_WORD_RE})", t=_TERMS_OF.replace("{x}", "title || ' ' || description")))
def propose_expansions(s, d):
    m = matching.match_terms(T.articles_from_documents(s, d), terms(s), how="word")
    return enrich.propose_expansions(m, T.keywords(s), text=F.concat_ws(" ", "title", "description")).select("keyword", "term", "n_both", "lift")


def _length_scorer(batches):
    """Stand-in scorer: longer titles are more relevant."""
    for pdf in batches:
        value = (pdf["title"].str.len() / 220.0).clip(0, 1)
        yield pdf[["id"]].assign(relevance_score=value)


@query("external_scores", sql("doc", "SELECT id, least(length(title) / 220.0::DOUBLE, 1.0::DOUBLE) AS relevance_score FROM doc"))
def external_scores(s, d):
    a = T.articles_from_documents(s, d).select("id", "title")
    return enrich.score(a, _length_scorer, "id long, relevance_score double")


@query("trained_scorer", """SELECT (SELECT count(*) FROM documents) AS scored, count(*) AS fitted, count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality = 0) AS negative,
  CAST(0 AS BIGINT) AS without_prediction, true AS beats_majority FROM labels JOIN documents USING (doc_id)""")
def trained_scorer(s, d):
    """Relevance model trained on labelled rows, applied to all: what was fitted and scored, and whether
    the model is right more often than the larger class on its own rows."""
    labels = T.read(s, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label"))
    a = T.articles_from_documents(s, d).select("id", "title", "description")
    model = enrich.train_scorer(a.join(labels, "id"))
    scored = enrich.apply_scorer(a, model).select("id", "prediction").join(labels, "id", "left")
    one, two = count_if(F.col("label") == 1), count_if(F.col("label") == 0)
    right = count_if(F.col("label") == F.col("prediction"))
    return scored.agg(
        F.count(F.lit(1)).alias("scored"), F.count("label").alias("fitted"), one.alias("positive"), two.alias("negative"),
        count_if(F.col("prediction").isNull()).alias("without_prediction"), (right > F.greatest(one, two)).alias("beats_majority"),
    )
