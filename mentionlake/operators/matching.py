"""Keyword matching: three named strategies, two physical plans each.

Strategies: ``word`` (whole phrase, ASCII word boundaries), ``normalized``
(substring of normalised text) and ``substring`` (substring of lower-cased text).

Plans: a dictionary of at most ``MAX_INLINE_TERMS`` rows is compiled into the
projection (no shuffle, one pass). A larger one goes through equi-joins on whole
phrases (``phrases.py``): only phrases that may match leave the scan, no text is
shuffled for it, and no plan holds a nested-loop join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mentionlake import constants as C
from mentionlake.functions import text as X
from mentionlake.functions.scalars import literal_strings, literal_table, sql_literal
from mentionlake.operators.dedup import first_per_key
from mentionlake.operators.phrases import substring_pairs, word_pairs
from mentionlake.session import bounded_rows

MAX_INLINE_TERMS = 1000
_OPEN, _SHUT = "\x02", "\x03"


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an expensive column that later filters and projections must not expand again.

    A one-element generator is a barrier for predicate pushdown and projection
    merging, and still runs inside the same stage.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _marked(text: Column) -> Column:
    """Every ASCII word run enclosed in markers. A phrase occurs between word
    boundaries exactly when its marked form is a substring of the marked text, so
    phrase matching needs no regular expression per term."""
    return F.regexp_replace(text, "[a-z0-9_]+", f"{_OPEN}$0{_SHUT}")


def _needle(term: Column, how: str) -> Column:
    if how == "word":
        return _marked(F.lower(term))
    return X.normalized_plain(term) if how == "normalized" else F.lower(term)


def _pattern(needle: Column, how: str) -> Column:
    """Extra check for a phrase whose first or last character is no ASCII word
    character: the markers cannot express that boundary."""
    if how != "word":
        return F.lit("")
    inner = needle.rlike(rf"(?s)^{_OPEN}.*{_SHUT}\z")
    return F.when(inner, "").otherwise(F.concat(F.lit(f"(?<!{_SHUT})"), X.quoted(needle), F.lit(f"(?!{_OPEN})")))


def _usable(term: Column, needle: Column, how: str, any_term: bool = False) -> Column:
    if how == "word" and not any_term:
        return (F.length(term) >= 4) & ~F.lower(term).isin(C.BLOCKED_SHORT_TERMS)
    return F.length(F.trim(needle)) > 0


def _hay(df: DataFrame, text: Column | None, how: str) -> Column:
    value = text if text is not None else F.concat_ws(" ", "title", "description")
    if how == "normalized":
        return X.normalized(value)
    return _marked(F.lower(value)) if how == "word" else F.lower(value)


def _hit(hay: Column, entry: Column, how: str) -> Column:
    found = (F.length(hay) >= F.length(entry["needle"])) & F.contains(hay, entry["needle"])
    return found & ((entry["pattern"] == "") | F.rlike(hay, entry["pattern"])) if how == "word" else found


def _keywords_of(hay: Column, entries: Column, how: str) -> Column:
    hits = F.filter(entries, lambda e: _hit(hay, e, how))
    return F.array_sort(F.array_distinct(F.transform(hits, lambda e: e["keyword"])))


def prepared_terms(terms: DataFrame, how: str, any_term: bool = False) -> DataFrame:
    """(keyword, needle, pattern) of the usable terms."""
    needle = _needle(F.col("term"), how)
    return (
        terms.filter(_usable(F.col("term"), needle, how, any_term))
        .select("keyword", needle.alias("needle"), _pattern(needle, how).alias("pattern"))
    )


def match_terms(
    df: DataFrame,
    terms: DataFrame,
    how: str = "word",
    text: Column | None = None,
    key: str = "id",
    out: str = "matched_keywords",
    max_inline: int = MAX_INLINE_TERMS,
    any_term: bool = False,
) -> DataFrame:
    """Add the sorted array of keywords whose term occurs in the text.

    ``terms``: keyword, term. ``any_term`` lets short and blocked words take part in ``word`` matching. The result depends on a row's own text only: in the joined plan rows are
    told apart by ``key`` and the digest of the text, so keys may repeat or be null; the columns of ``df`` that
    the caller goes on to use, the text among them if it is wanted, are then joined on those two.
    """
    prepared = prepared_terms(terms, how, any_term)
    rows = bounded_rows(prepared, max_inline)
    base = compute_once(df, "__hay", F.coalesce(_hay(df, text, how), F.lit("")))
    if rows is not None:
        rows = list(dict.fromkeys(rows))
        entries = _constant_entries(rows) if rows else None
        found = _keywords_of(F.col("__hay"), entries, how) if rows else literal_strings([])
        return compute_once(base.drop(out), out, found).drop("__hay")
    value = F.coalesce(text if text is not None else F.concat_ws(" ", "title", "description"), F.lit(""))
    named = df.withColumn("__digest", F.unhex(F.md5(value)))
    slim = named.select(F.col(key).alias("__key"), "__digest", F.lower(value).alias("__hay") if how == "word" else _hay(df, text, how).alias("__hay"))
    slim = slim.withColumn("__hay", F.coalesce("__hay", F.lit("")))
    usable = _usable(F.col("term"), _needle(F.col("term"), how), how, any_term)
    plain = F.lower("term") if how == "word" else _needle(F.col("term"), how)
    phrases = terms.filter(usable).select("keyword", plain.alias("phrase"))
    pairs = (word_pairs if how == "word" else substring_pairs)(slim, phrases, ["__key", "__digest"], "__hay")
    grouped = pairs.groupBy("__key", F.col("__digest").alias("__of")).agg(F.array_sort(F.collect_set("keyword")).alias("__found"))
    joined = named.drop(out).join(grouped, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__digest") == F.col("__of")), "left")
    return joined.withColumn(out, F.coalesce("__found", literal_strings([]))).drop("__key", "__digest", "__of", "__found")


def _constant_entries(rows) -> Column:
    texts = ([sql_literal(v) for v in (r.keyword, r.needle, r.pattern)] for r in rows)
    return F.expr("array(" + ", ".join(f"named_struct('keyword', {k}, 'needle', {n}, 'pattern', {p})" for k, n, p in texts) + ")")


def term_table(keywords: DataFrame, company: str | None = None, compat: bool = False) -> DataFrame:
    """Search terms with their owning keyword: the keywords themselves, their
    expansions, and the company name unless it is the default.

    A term shared by several keywords keeps every owner; ``compat`` keeps the
    last one (highest id), and lets it take over a keyword of the same text.
    """
    active = keywords.filter(F.coalesce(F.col("active"), F.lit(True)))
    own = active.select(F.trim("text").alias("term"), F.col("text").alias("keyword"), F.lit(0).alias("rank"), "id")
    expanded = active.select(
        F.explode("expanded_terms").alias("raw"), F.col("text").alias("keyword"), "id"
    ).select(F.lower(F.trim("raw")).alias("term"), "keyword", F.lit(1).alias("rank"), "id")
    table = own.unionByName(expanded)
    if company and company != "My Company":
        one = literal_table(keywords.sparkSession, "term string, keyword string", [(company.strip(), company.strip())])
        table = table.unionByName(one.withColumns({"rank": F.lit(0), "id": F.lit(None)}), allowMissingColumns=True)
    table = table.filter(F.length("term") > 0)
    if compat:
        owner = F.max_by("keyword", F.struct("rank", "id"))
        return table.groupBy(F.lower("term").alias("term")).agg(owner.alias("keyword"))
    return table.select("term", "keyword").distinct()


def expand_terms(keywords: DataFrame, synonyms: dict[str, list[str]] = C.SYNONYMS) -> DataFrame:
    """(keyword, term): the keyword, plus synonyms of every key it equals or contains."""
    low = F.lower("keyword")
    extra = literal_strings([])
    for head, words in synonyms.items():
        extra = F.array_union(extra, F.when(F.contains(low, F.lit(head)), literal_strings(words)).otherwise(literal_strings([])))
    terms = F.array_union(F.array("keyword"), extra)
    kept = F.filter(terms, lambda t: ~t.isin(C.BLOCKED_SHORT_TERMS))
    return keywords.select("keyword", F.explode(kept).alias("term"))


def route_topics(
    cands: DataFrame, topics: DataFrame, broad_terms: list[str] = C.BROAD_TERMS, min_priority: int = 80, key: str = "id"
) -> DataFrame:
    """One row per (article, topic): exact routes by expanded terms, broad routes
    from high-priority sources that mention a broad term and have no exact hit.

    ``cands``: key, title, description, connector, fetch_priority.
    ``topics``: topic_id, keywords, sources. ``matched_keywords`` lists the
    topic's own keywords found in the text.
    """
    active = topics.select(F.col("topic_id").cast("string").alias("topic_id"), "keywords", "sources")
    words = active.select("topic_id", F.explode("keywords").alias("keyword"))
    terms = expand_terms(words.select("keyword").distinct())
    owned = words.join(terms, "keyword").select("topic_id", "keyword", "term")
    tag = F.concat_ws("\x01", "topic_id", F.when(F.col("term") == F.col("keyword"), "1").otherwise("0"), "keyword")
    tagged = match_terms(cands, owned.select(tag.alias("keyword"), "term"), how="word", key=key, out="__tags")
    parts = F.transform("__tags", lambda t: F.split(t, "\x01"))
    hits = tagged.drop("topic_id", "route", "sources").withColumn("__hits", parts).withColumn(
        "__exact", F.array_distinct(F.transform("__hits", lambda p: p[0]))
    )
    text = X.joined_lower(F.col("title"), F.col("description"))
    mentions = F.exists(literal_strings(broad_terms), lambda b: F.contains(text, b))
    # A matched row asks for its exact topics by id and, if it may be routed broadly, for all topics of its connector.
    exact = F.transform("__exact", lambda t: F.struct(F.lit("exact").alias("route"), F.concat(F.lit("t:"), t).alias("ask")))
    broad = F.array(F.struct(F.lit("broad").alias("route"), F.concat(F.lit("c:"), "connector").alias("ask")))
    may = (F.coalesce("fetch_priority", F.lit(0)) >= min_priority) & mentions
    asked = hits.select("*", F.inline(F.concat(exact, F.when(may, broad).otherwise(F.filter(broad, lambda b: F.lit(False))))))
    asks = F.concat(F.array(F.concat(F.lit("t:"), "topic_id")), F.transform(F.array_distinct("sources"), lambda c: F.concat(F.lit("c:"), c)))
    answers = active.select("topic_id", "sources", F.explode(asks).alias("ask"))
    fits = F.when(F.col("route") == "exact", F.array_contains("sources", F.col("connector"))).otherwise(~F.array_contains("__exact", F.col("topic_id")))
    out = asked.join(answers, "ask").filter(fits)
    own = F.transform(
        F.filter("__hits", lambda p: (p[0] == F.col("topic_id")) & (p[1] == "1")), lambda p: p[2]
    )
    keep = [c for c in cands.columns if c not in ("matched_keywords", "topic_id", "route", "sources")]
    return out.select(*keep, "topic_id", "route", F.array_sort(F.array_distinct(own)).alias("matched_keywords"))


def match_bodies(unmatched: DataFrame, pages: DataFrame, terms: DataFrame) -> DataFrame:
    """Second chance for unmatched items: match the whole body of their page.

    ``pages``: url, body_text, lang, published_at (output of ``extract_pages``). A
    page crawled several times counts once: its earliest crawl, of equal dates the one of smallest digest.
    """
    crawled = pages.select("url", "body_text", F.col("lang").alias("body_lang"), F.col("published_at").alias("body_date"))
    # Bodies are matched where they are read; only their keywords and digest are shuffled.
    found = match_terms(crawled, terms, how="normalized", text=F.col("body_text"), key="url", out="body_keywords")
    found = found.select("url", "body_lang", "body_date", "body_keywords", F.md5("body_text").alias("__digest"))
    first = first_per_key(found, ["url"], [F.col("body_date").asc_nulls_last(), F.col("__digest").asc()])
    bodies = first.filter(F.size("body_keywords") > 0).drop("__digest")
    return unmatched.join(bodies, "url").select(
        *[c for c in unmatched.columns if c not in ("matched_keywords", "matched_via", "language", "published_at")],
        F.col("body_keywords").alias("matched_keywords"),
        F.lit("body_scan").alias("matched_via"),
        F.col("body_lang").alias("language"),
        F.coalesce("published_at", "body_date").alias("published_at"),
    )


def with_fallback(df: DataFrame, fallback: Column, column: str = "matched_keywords") -> DataFrame:
    """Use ``fallback`` as the only keyword where nothing matched."""
    found = F.coalesce(F.size(column) > 0, F.lit(False))
    return df.withColumn(column, F.when(found, F.col(column)).otherwise(F.array(fallback)))


def keyword_totals(matched: DataFrame) -> DataFrame:
    """Articles per keyword."""
    return matched.select(F.explode("matched_keywords").alias("keyword")).groupBy("keyword").agg(
        F.count(F.lit(1)).alias("n")
    )
