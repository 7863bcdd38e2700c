"""Exports of owned channels (CSV) to owned articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mentionlake import constants as C
from mentionlake.functions import dates as D, text as X
from mentionlake.operators.dedup import first_per_key, top_per_key

HEADER_SEARCH_LINES = 10


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line: quotes removed, doubled quotes undone, trimmed."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(?:\s*"[^"]*(?:""[^"]*)*"\s*|[^,]*)'), F.lit(0))
    bare = F.transform(raw, lambda f: F.trim(F.substring(f, 2, 1_000_000_000)))
    return F.transform(
        bare,
        lambda f: F.when(f.rlike('(?s)^".*"$'), F.trim(F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"')))).otherwise(f),
    )


def snake(name: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_"), "_+", "_")
    return F.regexp_replace(out, "^_|_$", "")


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """Non-empty lines with file and a sortable position. Large files stay splittable."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"), F.regexp_replace("value", r"\r$", "").alias("line"),
    )
    return lines.filter(F.trim("line") != "")


def owned_rows(lines: DataFrame) -> DataFrame:
    """Data lines with the header of their file; the header is the first of the first
    ten lines in which at least two columns carry a metric word, else the first line."""
    order = [F.col("block").asc(), F.col("line_id").asc()]
    head = top_per_key(lines, ["file"], order, HEADER_SEARCH_LINES).withColumn(
        "header", F.transform(csv_fields(F.col("line")), lambda f: snake(f))
    )
    known = F.filter("header", lambda h: h.rlike("|".join(C.METRIC_HEADERS)))
    header = first_per_key(head.withColumn("fits", F.size(known) >= 2), ["file"], [F.col("fits").desc(), *order])
    header = header.select("file", F.struct("block", "line_id").alias("at"), "header")
    return lines.join(header, "file").filter(F.struct("block", "line_id") > F.col("at")).select(
        "file", "line_id", "header", csv_fields(F.col("line")).alias("values")
    )


def _value(*names: str) -> Column:
    """First non-empty value among the named columns; '' when there is none."""
    zipped = F.arrays_zip(F.col("header").alias("h"), F.col("values").alias("v"))

    def one(name: str) -> Column:
        return F.try_element_at(F.filter(zipped, lambda z: z["h"] == name), F.lit(-1))["v"]

    return F.coalesce(X.first_non_empty(*[one(n) for n in names]), F.lit(""))


def _number(*names: str) -> Column:
    """The leading whole number of a cell; 0 where there is none or it is beyond 64 bits."""
    digits = F.regexp_extract(_value(*names), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def owned_articles(rows: DataFrame) -> DataFrame:
    """Daily aggregate rows or per-post rows as owned articles; rows without a
    readable date, or without title and link, are dropped."""
    stated = _value("date", "posted_on", "published_date", "created_date")
    aggregate = F.exists("header", lambda h: F.contains(h, F.lit("impressions_total")) | F.contains(h, F.lit("impressions_organic")))
    both = lambda name: _number(f"{name}_total", f"{name}_organic")
    typed = rows.select(
        aggregate.alias("daily"), stated.alias("stated"), D.parse_date(stated).alias("published_at"),
        F.substring(stated, 1, 10).alias("label"),
        _value("post_title", "title", "content", "update", "post").alias("text"), _value("post_link").alias("post_link"),
        _value("post_link", "url", "link").alias("link"), _value("description", "content").alias("body"),
        both("impressions").alias("d_impressions"), both("clicks").alias("d_clicks"), both("reposts").alias("d_shares"),
        both("reactions").alias("d_engagement"), both("comments").alias("d_comments"),
        _number("impressions", "views").alias("p_impressions"), _number("clicks").alias("p_clicks"),
        _number("reposts", "shares").alias("p_shares"), _number("likes", "reactions").alias("p_engagement"),
        _number("comments").alias("p_comments"),
    )
    usable = F.col("published_at").isNotNull() & (F.col("daily") | (F.col("text") != "") | (F.col("post_link") != ""))
    daily_text = F.concat(
        F.lit("Impressions: "), "d_impressions", F.lit(", Clicks: "), "d_clicks", F.lit(", Reactions: "), "d_engagement",
        F.lit(", Comments: "), "d_comments", F.lit(", Reposts: "), "d_shares",
    )
    pick = lambda daily, post: F.when(F.col("daily"), daily).otherwise(post)
    derived_id = F.concat(F.lit("linkedin-post-"), F.substring(F.sha2(F.concat_ws("\x01", "text", "stated"), 256), 1, 16))
    return typed.filter(usable).select(
        pick(F.concat(F.lit("LinkedIn Daily Metrics — "), "label"), X.first_non_empty(F.substring("text", 1, 500), F.lit("LinkedIn Post"))).alias("title"),
        pick(F.concat(F.lit("linkedin-daily-"), "label"), X.first_non_empty(F.col("link"), derived_id)).alias("url"),
        pick(daily_text, F.substring(F.coalesce(X.first_non_empty(F.col("body"), F.col("text")), F.lit("")), 1, 1000)).alias("description"),
        F.lit("LinkedIn").alias("source_name"), F.lit("linkedin.com").alias("source_url"), F.lit("owned").alias("source_category"),
        F.lit("social").alias("media_type"), F.lit("linkedin-csv").alias("ingestion_source"), "published_at", F.lit("en").alias("language"),
        *[pick(F.col(f"d_{a}"), F.col(f"p_{a}")).alias(b) for a, b in (
            ("impressions", "impressions"), ("clicks", "clicks"), ("shares", "shares"), ("engagement", "engagement_score"), ("comments", "comment_count"))],
        F.array().cast("array<string>").alias("matched_keywords"), F.lit(False).alias("is_duplicate"),
    )


def import_owned_csv(spark: SparkSession, paths) -> DataFrame:
    return owned_articles(owned_rows(read_lines(spark, paths)))
