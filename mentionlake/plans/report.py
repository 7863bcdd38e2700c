"""The summary report and report templates: one aggregation for all sections of all templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mentionlake.functions import text as X
from mentionlake.functions.scalars import literal_strings, percent
from mentionlake.operators import aggregates as A
from mentionlake.operators.dedup import ranked_top
from mentionlake.operators.saved import run_saved_searches
from mentionlake.session import materialize

SENTIMENTS = ("positive", "neutral", "negative")
SOURCES, STORIES = 8, 10


def _facts(entities: dict[str, list[str]]) -> list[Column]:
    """What the report needs of an article: the (section, label) pairs it counts for, and what a story shows."""
    item = lambda section, label: F.struct(F.lit(section).alias("section"), label.alias("label"))
    name = F.coalesce(X.first_non_empty(F.col("source_name"), F.col("source_url")), F.lit(""))
    text = X.joined_lower(F.col("title"), F.col("description"))
    voices = [F.when(A.mentions(text, [t.lower() for t in terms]), item("voice", F.lit(entity))) for entity, terms in entities.items()]
    feeling = F.when(F.col("sentiment").isin(*SENTIMENTS), item("sentiment", F.col("sentiment")))
    items = F.array(item("total", F.lit("")), item("name", name), item("source", A.source_label()), feeling, *voices)
    picked = F.coalesce((F.col("relevance_label") == "high") | F.col("is_major_outlet"), F.lit(False))
    story = F.when(picked, F.struct(F.coalesce("relevance_score", F.lit(0.5)).alias("score"), "published_at", F.col("id").alias("story_id"), "title", "url"))
    return [F.array_compact(items).alias("items"), story.alias("story")]


def _reports(rows: DataFrame, templates: DataFrame, entities: dict[str, list[str]]) -> DataFrame:
    """(template_id, section, rank, label, value). ``rows``: template_id, items, story; ``templates``: the ids to report on."""
    counted = rows.select("template_id", F.explode("items").alias("i")).groupBy("template_id", "i.section", "i.label").agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "report-counts")
    of = lambda section, value: F.coalesce(F.sum(F.when(F.col("section") == section, value)), F.lit(0))
    feelings = [F.coalesce(F.sum(F.when((F.col("section") == "sentiment") & (F.col("label") == v), F.col("n"))), F.lit(0)).alias(v) for v in SENTIMENTS]
    totals = counted.groupBy("template_id").agg(of("total", F.col("n")).alias("Total mentions"), of("name", F.lit(1)).alias("Unique sources"), *feelings)
    lines = [("summary", "Total mentions"), ("summary", "Unique sources"), *[("sentiment", v) for v in SENTIMENTS]]
    stats = F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(i).alias("rank"), F.lit(c).alias("label"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("string").alias("value"))
        for i, (section, c) in enumerate(lines, start=1)
    ])
    head = templates.join(totals, "template_id", "left").select("template_id", F.inline(stats))

    named = templates.select("template_id", F.explode(literal_strings(list(entities))).alias("label"))
    voices = counted.filter("section = 'voice'").select("template_id", "label", "n")
    voice = named.join(voices, ["template_id", "label"], "left").select("template_id", "label", F.coalesce("n", F.lit(0)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy("template_id"))
    place = F.row_number().over(Window.partitionBy("template_id").orderBy(F.col("n").desc(), "label"))
    said = F.concat_ws(" ", F.col("n").cast("string"), F.concat(F.lit("("), percent(F.col("n"), F.col("whole")).cast("string"), F.lit("%)")))
    voice = voice.withColumn("whole", whole).select("template_id", F.lit("share_of_voice").alias("section"), place.alias("rank"), "label", said.alias("value"))

    sources = ranked_top(counted.filter("section = 'source'"), ["template_id"], [F.col("n").desc(), F.col("label").asc()], SOURCES, "rank")
    sources = sources.select("template_id", F.lit("top_sources").alias("section"), "rank", "label", F.col("n").cast("string").alias("value"))
    order = [F.col("score").desc(), F.col("published_at").desc(), F.col("story_id").asc()]
    stories = ranked_top(rows.filter("story is not null").select("template_id", "story.*"), ["template_id"], order, STORIES, "rank")
    stories = stories.select("template_id", F.lit("top_stories").alias("section"), "rank", F.col("title").alias("label"), F.col("url").alias("value"))
    return head.unionByName(voice).unionByName(sources).unionByName(stories)


def summary_report(articles: DataFrame, entities: dict[str, list[str]], days: int, as_of) -> DataFrame:
    """(section, rank, label, value) rows of one period: totals, sentiment, share of
    voice, top eight sources, top ten stories. ``articles`` carry the source struct.
    The articles are read twice: once for all counts, once for the stories."""
    rows = A.in_period(articles, days, as_of).select(F.lit(0).alias("template_id"), *_facts(entities))
    only = articles.sparkSession.range(1, numPartitions=1).select(F.lit(0).alias("template_id"))
    return _reports(rows, only, entities).drop("template_id")


def run_reports(articles: DataFrame, templates: DataFrame, entities: dict[str, list[str]], days: int, as_of) -> DataFrame:
    """The summary report of every stored template, each over its own filter, for any number of them.

    ``templates``: template_id (unique, not null), filters (JSON of a stored search). Templates are data: articles meet them
    through the reverse index of the saved searches, and the sections of all are counted together. A template that
    no article meets reports zeros.
    """
    searches = templates.select(F.col("template_id").alias("search_id"), F.col("filters").alias("query"))
    met = run_saved_searches(A.in_period(articles, days, as_of), searches, as_of, keep=_facts(entities))
    rows = materialize(met.select(F.col("search_id").alias("template_id"), "items", "story"), "report-rows")
    return _reports(rows, templates.select("template_id").filter("template_id is not null").distinct(), entities)
