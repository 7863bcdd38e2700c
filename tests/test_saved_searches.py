"""Thousands of stored searches against one search at a time."""

import json
import random

import pytest
from conftest import plan_text
from pyspark.sql import functions as F

from mentionlake.functions.scalars import literal_table
from mentionlake.operators import filters, saved

NOW = "2024-03-31 00:00:00"
DDL = "id int, title string, description string, source_name string, sentiment string, language string, published_at timestamp, source struct<name:string,country_code:string>, matched_keywords array<string>"


def articles(spark):
    import datetime as dt

    r = random.Random(5)
    words = ["wave", "tide", "micro", "wave-power", "naïve", "c++", "ai", "solar farm", "x"]
    rows = []
    for i in range(60):
        text = " ".join(r.choices(words, k=r.randint(0, 6)))
        at = dt.datetime(2024, 3, 31) - dt.timedelta(hours=r.randint(0, 24 * 400)) if i % 9 else None
        rows.append((i, text, r.choice([None, "tidal wave"]), r.choice(["A", None]), r.choice(["negative", "positive", None]), r.choice(["en", "de"]), at, r.choice([("A", "SE"), (None, "NO"), None]), r.choice([None, ["wave"]])))
    return spark.createDataFrame(rows, DDL)


def queries(n):
    r = random.Random(7)
    values = ["wave", "tid", "ai", "a", "solar farm", "naïve", "c++", "microwave", "POWER", "x"]
    for i in range(n):
        q = {"terms": [{"id": "t", "value": r.choice(values), "operator": r.choice(["AND", "AND", "OR", "OR", "NOT"]), "exact": r.random() < 0.4} for _ in range(r.randint(0, 4))]}
        for facet, options in (("sources", ["A", "B"]), ("countries", ["SE", "NO", ""]), ("sentiments", ["negative", "positive"]), ("languages", ["en"])):
            if r.random() < 0.25:
                q[facet] = r.sample(options, r.randint(0, len(options)))
        if r.random() < 0.4:
            q["dateRange"] = r.choice(["7d", "30d", "3m", "1y", "all", "odd"])
        if r.random() < 0.2:
            q["dateFrom"] = "2023-10-01"
        if r.random() < 0.2:
            q["dateTo"] = "2024-02-01"
        yield i, q


@pytest.mark.parametrize("chunk", [1000, 0])
def test_equal_to_each_search_alone(spark, chunk):
    a = articles(spark).cache()
    many = list(queries(70))
    want = a.select(F.array(*[F.when(filters.search_condition(q, NOW), i) for i, q in many]).alias("hit"), "id").select(F.explode(F.array_compact("hit")).alias("search_id"), "id")
    stored = literal_table(spark, "search_id int, query string", [(i, json.dumps(q)) for i, q in many])
    got = saved.run_saved_searches(a, stored.unionByName(stored), NOW, chunk)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    a.unpersist()


def test_any_number_of_searches_is_one_plan(spark):
    i = F.col("id")
    term = F.struct(F.lit("1").alias("id"), F.concat(F.lit("wave"), F.when(i % 100 == 0, "").otherwise(i.cast("string"))).alias("value"), F.lit("AND").alias("operator"), F.lit(False).alias("exact"))
    stored = spark.range(5000).select(i.cast("int").alias("search_id"), F.to_json(F.struct(F.array(term).alias("terms"))).alias("query"))
    a = articles(spark)
    out = saved.run_saved_searches(a, stored, NOW)
    text = plan_text(out)
    assert "NestedLoop" not in text and "Cartesian" not in text and "Union" not in text
    n = a.filter("lower(concat_ws(' ', title, description, array_join(matched_keywords, ' '))) like '%wave%'").count()
    assert out.count() == 50 * n


def test_odd_searches(spark):
    a = articles(spark)
    rows = [(1, ""), (2, None), (3, "{not json"), (4, '{"terms": [{"value": null, "operator": "NOT"}]}'), (5, '{"terms": [{"value": " ", "operator": "OR"}]}'),
            (6, '{"terms": [{"value": "", "operator": "NOT"}]}'), (7, '{"terms": [{"value": null, "operator": "OR"}]}'), (None, "{}")]
    hits = saved.run_saved_searches(a, literal_table(spark, "search_id int, query string", rows), NOW)
    assert {r.search_id: r.n for r in hits.groupBy("search_id").agg(F.count("*").alias("n")).collect()} == {1: 60, 2: 60, 3: 60, 5: 60}
    assert saved.run_saved_searches(a, literal_table(spark, "search_id int, query string", [(None, "")]), NOW).collect() == []
