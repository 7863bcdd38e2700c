"""Merging scores and enrichments, and corpus-based stand-ins for model calls.

``suggest_keywords`` and ``propose_expansions`` are statistical replacements for
text that an external language model used to write; scores of such a model come
in through ``score``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window, functions as F

from mentionlake import schemas
from mentionlake.functions import text as X
from mentionlake.operators import terms
from mentionlake.operators.joins import new_suggestions
from mentionlake.session import stored

# What an unscored article receives, by merge variant.
BY_ID_DEFAULTS = {
    "relevance_score": 0.5, "relevance_label": "medium", "relevance_reason": "Unscored — matched keyword filter",
    "sentiment": "neutral", "sentiment_score": 0.0,
}
BY_INDEX_DEFAULTS = {
    "sentiment": "neutral", "sentiment_score": 0.5, "importance": "medium", "confidence": 0.5,
    "matched_reason": "", "primary_entity": "", "ai_summary": "",
}


def merge_scores(articles: DataFrame, scores: DataFrame, keys=("id",), defaults: dict | None = None) -> DataFrame:
    """Overwrite the score columns from ``scores``; rows without a score get the defaults.

    ``keys=('batch', 'index')`` merges by position inside a batch. A key scored
    twice is an input error the caller removes with ``first_per_key``.
    """
    defaults = BY_ID_DEFAULTS if defaults is None else defaults
    names = list(defaults) + (["key_themes"] if "key_themes" in scores.columns else [])
    hit = scores.select(*keys, *[F.col(n).alias(f"__{n}") for n in names], F.lit(True).alias("__hit"))
    merged = articles.join(hit, list(keys), "left")
    values = {n: F.when(F.col("__hit"), F.col(f"__{n}")).otherwise(F.lit(d)) for n, d in defaults.items()}
    if "key_themes" in names:
        values["key_themes"] = F.coalesce("__key_themes", F.array().cast("array<string>"))
    return merged.withColumns(values).drop("__hit", *[f"__{n}" for n in names])


def pending_enrichment(articles: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Articles without a cached enrichment."""
    return articles.join(enrichments.select(F.col("article_id").alias("id")), "id", "left_anti")


def apply_enrichment(articles: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Author fields are taken over only where the enrichment names an author."""
    cols = ["author_name", "author_email", "author_url"]
    named = enrichments.filter(F.coalesce("author_name", F.lit("")) != "").select(
        F.col("article_id").alias("id"), *[F.col(c).alias(f"__{c}") for c in cols], F.lit(True).alias("__hit")
    )
    merged = articles.join(named, "id", "left")
    out = {}
    for c in cols:
        current = F.col(c) if c in articles.columns else F.lit(None).cast("string")
        out[c] = F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(current)
    return merged.withColumns(out).drop("__hit", *[f"__{c}" for c in cols])


def score(df: DataFrame, scorer: Callable[[Iterator], Iterator], schema: str = schemas.SCORE_DDL) -> DataFrame:
    """Run any batch scorer (Iterator of pandas frames to the same) on the executors."""
    return df.mapInPandas(scorer, schema)


def parse_score_reply(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Scores from a reply that holds a JSON array, possibly inside a code fence.
    A reply without a readable array contributes nothing."""
    body = F.regexp_replace(column, "```(json)?\n?", "")
    array = F.regexp_extract(body, r"(?s)(\[.*\])", 1)
    parsed = F.from_json(array, f"array<struct<{schemas.SCORE_DDL}>>")
    return replies.select(F.inline(parsed))


def train_scorer(labelled: DataFrame, label: str = "label", features: int = 1 << 14):
    """TF-IDF and logistic regression on title and description; returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="tfidf", minDocFreq=2),
        LogisticRegression(featuresCol="tfidf", labelCol=label, maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(_with_text(labelled))


def apply_scorer(df: DataFrame, model) -> DataFrame:
    """Add the predicted class and drop the intermediate columns."""
    return model.transform(_with_text(df)).drop("text", "words", "tf", "tfidf", "rawPrediction", "probability")


def _with_text(df: DataFrame) -> DataFrame:
    return df.withColumn("text", X.joined_lower(F.col("title"), F.col("description")))


def suggest_keywords(articles: DataFrame, keywords: DataFrame, text=None, k: int = 8, min_support: int = 5) -> DataFrame:
    """Terms over-represented in matched articles, ranked by smoothed odds, minus existing keywords.

    ``articles``: title, matched_keywords; terms come from the column ``text``, the title unless given. The articles are
    matched once; one count of term keys gives the terms and, under the key 0, both corpus sizes. Only terms that
    reach the k-th place, ties included, are named.
    """
    matched = F.size(F.coalesce("matched_keywords", F.array().cast("array<string>"))) > 0
    hit, miss = F.lit("hit"), F.lit("miss")
    texts = articles.select(X.normalized_plain(F.col("title") if text is None else text).alias("text"), F.array(F.when(matched, hit).otherwise(miss)).alias("labels"))
    of = lambda label: F.sum(F.when(F.col("label") == F.xxhash64(label), F.col("n")).otherwise(0))
    counts = terms.label_counts(texts).groupBy("term").agg(of(hit).alias("in_matched"), of(miss).alias("in_other"))
    counts = stored(counts.filter((F.col("in_matched") >= min_support) | (F.col("term") == 0)), "term-counts")
    sizes = counts.filter("term = 0").first()
    in_all, other = (sizes.in_matched, sizes.in_other) if sizes else (0, 0)
    odds = ((F.col("in_matched") + 1) * F.lit(other + 2)) / ((F.col("in_other") + 1) * F.lit(in_all + 2))
    known = keywords.select(terms.keys_of(F.lower("text")).alias("term")).distinct()
    ranked = counts.filter("term <> 0").join(known, "term", "left_anti").withColumn("odds", odds)
    last = ranked.orderBy(F.col("odds").desc(), F.col("in_matched").desc()).limit(k).agg(F.min(F.struct("odds", "in_matched")).alias("x")).first().x
    reach = F.lit(False) if last is None else F.struct("odds", "in_matched") >= F.struct(F.lit(last.odds).alias("odds"), F.lit(last.in_matched).alias("in_matched"))
    best = stored(ranked.filter(reach), "best-terms")
    found = best.join(terms.named(texts, best), "term").select(F.col("name").alias("keyword"), "in_matched", "in_other", "odds")
    return new_suggestions(found, keywords).orderBy(F.col("odds").desc(), F.col("in_matched").desc(), "keyword").limit(k)


def propose_expansions(
    articles: DataFrame, keywords: DataFrame, text=None, k: int = 10, min_support: int = 3
) -> DataFrame:
    """Terms that co-occur with a keyword more than chance (lift), best ``k`` per keyword.

    One matching and one count of (keyword, term) keys: articles also count under no keyword and under no term, so the same
    count holds pairs, terms, keywords and the total. Only terms that reach a keyword's k-th place, ties included, are named.
    """
    from mentionlake.operators.dedup import top_per_key

    texts = articles.select(X.normalized_plain(F.col("title") if text is None else text).alias("text"), F.col("matched_keywords").alias("labels"))
    counts = terms.label_counts(texts).groupBy("label", "term").agg(F.sum("n").alias("n"))
    counts = stored(counts.filter((F.col("n") >= min_support) | (F.col("label") == terms.ALL) & (F.col("term") == 0)), "pair-counts")
    total = counts.filter((F.col("label") == terms.ALL) & (F.col("term") == 0)).first()
    by_term = counts.filter((F.col("label") == terms.ALL) & (F.col("term") != 0)).select("term", F.col("n").alias("n_term"))
    by_keyword = counts.filter((F.col("label") != terms.ALL) & (F.col("term") == 0)).select("label", F.col("n").alias("n_keyword"))
    known = keywords.filter("text <> ''").select(F.col("text").alias("keyword"), F.xxhash64("text").alias("label"), terms.keys_of(F.lower("text")).alias("itself"))
    known = stored(known.join(by_keyword, "label"), "known-keywords")
    scored = (
        counts.filter((F.col("label") != terms.ALL) & (F.col("term") != 0)).withColumnRenamed("n", "n_both").join(known, "label").join(by_term, "term")
        .filter(~F.col("term").eqNullSafe(F.col("itself")))
        .withColumn("lift", (F.col("n_both") * F.lit(total.n if total else 0)) / (F.col("n_term") * F.col("n_keyword")))
    )
    order = [F.col("lift").desc(), F.col("n_both").desc()]
    place = F.rank().over(Window.partitionBy("keyword").orderBy(*order))
    best = stored(scored.withColumn("place", place).filter(F.col("place") <= k).select("keyword", F.col("term").alias("key"), "n_both", "n_term", "n_keyword", "lift"), "best-pairs")
    names = terms.named(texts, best.select(F.col("key").alias("term"))).select(F.col("term").alias("key"), F.col("name").alias("term"))
    found = best.join(names, "key").filter(F.col("term") != F.lower("keyword"))
    return top_per_key(found.select("keyword", "term", "n_both", "n_term", "n_keyword", "lift"), ["keyword"], [*order, F.col("term").asc()], k)
