"""Stored queries as data: saved searches, alert rules, keyword groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mentionlake import schemas
from mentionlake.functions import dates as D, text as X
from mentionlake.functions.scalars import lower_array
from mentionlake.operators.matching import match_terms
from mentionlake.session import stored

MAX_RULES = 1000


def _any_or_open(wanted: Column, value: Column) -> Column:
    """An empty or missing list accepts anything."""
    return (F.size(F.coalesce(wanted, F.array().cast("array<string>"))) == 0) | F.coalesce(
        F.array_contains(wanted, value), F.lit(False)
    )


def _prefixed(prefix: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(prefix), v))


def _search_view(articles: DataFrame, keep: Sequence[Column] = ()) -> DataFrame:
    text = X.joined_lower(F.col("title"), F.col("description"), F.concat_ws(" ", F.col("matched_keywords")))
    return articles.select(
        "id", text.alias("text"), "published_at",
        F.coalesce(X.first_non_empty(F.col("source.name"), F.col("source_name")), F.lit("")).alias("src"),
        F.coalesce("source.country_code", F.lit("")).alias("cc"),
        F.coalesce("sentiment", F.lit("")).alias("sent"),
        F.coalesce("language", F.lit("")).alias("lang"), F.struct(F.lit(0).alias("__"), *keep).alias("kept"),
    )


def _dates_accept(q: Column, ts: Column, as_of) -> Column:
    now = D.as_timestamp(as_of)
    name = F.coalesce(q["dateRange"], F.lit("all"))
    cutoff = (
        F.when(name == "1d", D.days_before(as_of, 1)).when(name == "7d", D.days_before(as_of, 7)).when(name == "30d", D.days_before(as_of, 30))
        .when(name == "3m", now - F.make_ym_interval(F.lit(0), F.lit(3)))
        .when(name == "6m", now - F.make_ym_interval(F.lit(0), F.lit(6)))
        .when(name == "1y", now - F.make_ym_interval(F.lit(0), F.lit(12)))
    )
    fresh = (name == "all") | F.coalesce(ts >= cutoff, ts.isNotNull() & cutoff.isNull(), F.lit(False))
    start = q["dateFrom"].isNull() | F.coalesce(ts >= q["dateFrom"].try_cast("timestamp"), F.lit(False))
    end = q["dateTo"].isNull() | F.coalesce(ts <= F.concat(q["dateTo"], F.lit(" 23:59:59")).try_cast("timestamp"), F.lit(False))
    return fresh & start & end


#: Facets of a search, the most selective kind first, with the article column each asks for.
_FACETS = (("sources", "src"), ("languages", "lang"), ("countries", "cc"), ("sentiments", "sent"))


def filed_searches(searches: DataFrame, search_id: str = "search_id", query: str = "query") -> DataFrame:
    """(search_id, q, plain, either, needs_either, without, anchor): stored searches filed under what an accepted article must have.

    Terms are tags: ``x:`` and the lower-case value of an exact term, ``s:`` of another. An anchor is the longest required
    term, else each of the alternatives, else each value of one facet; a search without any is filed under
    ``a:``. Searches that no article can satisfy (a null term required or excluded, a blank one excluded) are left out.
    """
    empty = F.array().cast("array<string>")
    rows = searches.select(F.col(search_id).alias("search_id"), F.from_json(F.coalesce(F.col(query), F.lit("")), schemas.SEARCH_QUERY_DDL).alias("q"))
    rows = rows.filter("search_id is not null").distinct()
    terms = F.coalesce(F.col("q.terms"), F.array())
    # A missing or unknown operator is AND, as in the search of one query.
    op = lambda t: F.when(t["operator"].isin("OR", "NOT"), t["operator"]).otherwise("AND")
    of = lambda kind: F.filter(terms, lambda t: op(t) == kind)
    blank = lambda t: F.coalesce(F.trim(t["value"]) == "", F.lit(False))
    tag = lambda t: F.concat(F.when(F.coalesce(t["exact"], F.lit(False)), "x:").otherwise("s:"), F.lower(t["value"]))
    tags = lambda kind: F.array_distinct(F.transform(F.filter(of(kind), lambda t: t["value"].isNotNull() & ~blank(t)), tag))
    missing = lambda kind: F.exists(of(kind), lambda t: t["value"].isNull())
    rows = rows.withColumns({
        "plain": tags("AND"), "either": tags("OR"), "without": tags("NOT"),
        "needs_either": (F.size(of("OR")) > 0) & ~F.exists(of("OR"), blank),
        "dead": missing("AND") | missing("NOT") | F.exists(of("NOT"), blank),
    }).filter(~F.col("dead") & (~F.col("needs_either") | (F.size("either") > 0))).drop("dead")
    longest = F.element_at(F.array_sort(F.transform("plain", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 1)["t"]
    anchors = F.when(F.size("plain") > 0, F.array(longest)).when(F.col("needs_either"), F.col("either"))
    for facet, column in _FACETS:
        wanted = F.coalesce(F.col(f"q.{facet}"), empty)
        anchors = anchors.when(F.size(wanted) > 0, _prefixed(f"{column}:", F.array_distinct(wanted)))
    return rows.withColumn("anchor", F.explode(anchors.otherwise(F.array(F.lit("a:")))))


def run_saved_searches(articles: DataFrame, searches: DataFrame, as_of, chunk: int = MAX_RULES, keep: Sequence[Column] = ()) -> DataFrame:
    """(search_id, id, and what ``keep`` takes from the article) hits of every stored search, any number of them, in one matching of the articles.

    ``searches``: search_id, query (JSON text). A reverse index: the terms of all searches are one dictionary, matched once per
    article (up to ``chunk`` terms inside the scan, more through the phrase index); every search is filed under
    one thing an accepted article must have, articles look their own terms and facets up there by an equi-join,
    and only the searches met are tested. From the matching on rows hold term names and facets, no text. A blank term accepts
    every text.
    """
    filed = filed_searches(searches)
    words = filed.select(F.explode(F.array_distinct(F.concat("plain", "either", "without"))).alias("keyword")).distinct()
    words = words.select("keyword", F.expr("substring(keyword, 3)").alias("term"))
    view = _search_view(articles, keep)
    view = match_terms(view, words.filter("keyword like 's:%'"), how="substring", text=F.col("text"), out="loose", max_inline=chunk)
    view = match_terms(view, words.filter("keyword like 'x:%'"), how="word", text=F.col("text"), out="strict", max_inline=chunk, any_term=True)
    own = F.array(*[F.concat(F.lit(f"{column}:"), column) for _, column in _FACETS], F.lit("a:"))
    probes = view.select("id", "kept", "published_at", *[c for _, c in _FACETS], F.concat("loose", "strict").alias("hits")).select("*", F.explode(F.concat("hits", own)).alias("anchor"))
    q = F.col("q")
    accepted = F.forall("plain", lambda t: F.array_contains("hits", t)) & ~F.arrays_overlap("without", "hits") & _dates_accept(q, F.col("published_at"), as_of)
    accepted = accepted & (~F.col("needs_either") | F.arrays_overlap("either", "hits"))
    for facet, column in _FACETS:
        accepted = accepted & _any_or_open(q[facet], F.col(column))
    # A search filed under several alternatives counts where the article's first of them meets it.
    by_either = F.col("needs_either") & (F.size("plain") == 0)
    first = F.try_element_at(F.array_sort(F.array_intersect("either", "hits")), F.lit(1))
    return probes.join(filed, "anchor").filter(accepted & (~by_either | (F.col("anchor") == first))).select("search_id", "id", "kept.*").drop("__")


def alert_condition(c: Column) -> Column:
    """AND over facets, OR inside a facet, an empty facet accepts anything."""
    keywords = F.coalesce(c["keywords"], F.array().cast("array<string>"))
    tagged = F.coalesce(F.arrays_overlap(lower_array(F.col("matched_keywords")), lower_array(keywords)), F.lit(False))
    return (
        ((F.size(keywords) == 0) | tagged)
        & _any_or_open(c["sentiments"], F.coalesce("sentiment", F.lit("")))
        & _any_or_open(c["sources"], F.coalesce("source_name", F.lit("")))
        & _any_or_open(c["countries"], F.coalesce("country", F.lit("")))
    )


def _rule_anchors(c: Column) -> Column:
    """Join keys of a rule: the values of its most selective non-empty facet."""
    filled = lambda name: F.size(F.coalesce(c[name], F.array().cast("array<string>"))) > 0
    return (
        F.when(filled("keywords"), _prefixed("k:", F.array_distinct(lower_array(c["keywords"]))))
        .when(filled("sources"), _prefixed("s:", F.array_distinct(c["sources"])))
        .when(filled("countries"), _prefixed("c:", F.array_distinct(c["countries"])))
        .when(filled("sentiments"), _prefixed("t:", F.array_distinct(c["sentiments"])))
        .otherwise(F.array(F.lit("a:")))
    )


#: A rule table up to these sizes is a decision table that Catalyst lets every task hold whole.
DECISION_ROWS = 10_000
DECISION_CHARS = 8_000_000
#: Pieces of an anchor in a larger table: facets of few values meet very many articles, keywords fewer.
FACET_PIECES = 64
KEYWORD_PIECES = 8


def _pieces() -> Column:
    return F.when(F.startswith("anchor", F.lit("k:")), KEYWORD_PIECES).otherwise(FACET_PIECES)


def fits_in_a_task(anchors: DataFrame, rows: int = DECISION_ROWS, chars: int = DECISION_CHARS) -> bool:
    """Whether a table of anchored rules is small in rows and text; reads at most ``rows + 1`` of them."""
    sizes = anchors.select(F.length(F.to_json("c")).alias("n")).limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return sizes[0] <= rows and sizes[1] <= chars


def evaluate_alerts(articles: DataFrame, rules: DataFrame, decision_rows: int = DECISION_ROWS) -> DataFrame:
    """(rule_id, rule_type, schedule, id, at) for every active rule that accepts an article.

    Works on batch and streaming articles; ``media`` rules see everything that is
    not social. Article and rule meet on category and one facet value (an
    equi-join), so an article is not paired with rules that cannot accept it. A
    rule reached through several keywords is kept for the first of them only.

    The anchored rules are written once: what they were made from, a scan of a large table perhaps, would make Catalyst
    take a few rules for a large table and deal the articles by an anchor that very many share. A rule table of checked size
    is joined as it is read back: below Catalyst's own limit for a
    broadcast, so articles stay where they are. A larger one is joined on (category, anchor, piece): the articles of an anchor
    are dealt to pieces by their id and its rules stand in every piece, so that an
    anchor that every article has ("all rules") is spread over many tasks.
    """
    empty = F.array().cast("array<string>")
    parsed = rules.filter("active").select(
        "rule_id", "rule_type", F.col("digest_schedule").alias("schedule"), F.col("alert_category").alias("category"),
        F.from_json("conditions", schemas.ALERT_CONDITIONS_DDL).alias("c"),
    ).select("*", F.explode(_rule_anchors(F.col("c"))).alias("anchor"))
    parsed = stored(parsed, "alert-rules")
    category = F.when(F.col("source_category") == "social", "social").otherwise("media")
    words = F.array_distinct(lower_array(F.coalesce("matched_keywords", empty)))
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    own = F.array(*[F.concat(F.lit(p), text(n)) for p, n in (("s:", "source_name"), ("c:", "country"), ("t:", "sentiment"))], F.lit("a:"))
    keyed = articles.withColumn("category", category).select("*", F.explode(F.concat(_prefixed("k:", words), own)).alias("anchor"))
    if fits_in_a_task(parsed, decision_rows):
        met = keyed.join(parsed, ["category", "anchor"])
    else:
        dealt = keyed.withColumn("piece", F.pmod(F.xxhash64("id"), _pieces()).cast("int"))
        # Catalyst does not count the copies of a rule: a merge join keeps it from broadcasting them.
        met = dealt.join(parsed.withColumn("piece", F.explode(F.sequence(F.lit(0), _pieces() - 1))).hint("merge"), ["category", "anchor", "piece"])
    shared = F.array_sort(F.array_intersect(words, lower_array(F.coalesce(F.col("c.keywords"), empty))))
    once = ~F.startswith("anchor", F.lit("k:")) | (F.col("anchor") == F.concat(F.lit("k:"), F.try_element_at(shared, F.lit(1))))
    return met.filter(once & alert_condition(F.col("c"))).select("rule_id", "rule_type", "schedule", "id", F.col("published_at").alias("at"))


# Digest schedules as window lengths.
DIGEST_WINDOWS = {"morning": "12 hours", "evening": "12 hours", "daily": "1 day", "weekly": "7 days"}


def digest(alerts: DataFrame, schedule: str) -> DataFrame:
    """Alerts of one schedule counted per rule and tumbling window."""
    return (
        alerts.filter((F.col("rule_type") == "digest") & (F.col("schedule") == schedule))
        .groupBy(F.window("at", DIGEST_WINDOWS[schedule]).alias("w"), "rule_id")
        .agg(F.count(F.lit(1)).alias("alerts"))
        .select("rule_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "alerts")
    )


def group_share(articles: DataFrame, keywords: DataFrame, groups: DataFrame) -> DataFrame:
    """Keyword hits rolled up to keyword groups."""
    members = groups.select("group_id", F.col("name").alias("group_name"), F.explode(F.array_distinct("keyword_ids")).alias("id"))
    named = members.join(keywords.select("id", F.col("text").alias("keyword")), "id")
    hits = articles.select(F.explode("matched_keywords").alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("hits"))
    return named.join(hits, "keyword", "left").groupBy("group_id", "group_name").agg(
        F.count(F.lit(1)).alias("keywords"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits")
    )
