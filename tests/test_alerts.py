"""Alert rules of every selectivity: both join forms against a plain loop, and even tasks under rules that accept all."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mentionlake.functions.scalars import literal_table
from mentionlake.operators import saved

RULES = "rule_id int, rule_type string, digest_schedule string, alert_category string, active boolean, conditions string"
ARTICLES = "id int, matched_keywords array<string>, sentiment string, source_name string, country string, source_category string, published_at string"


def _articles(n, rng):
    pick = lambda *values: rng.choice(values)
    return [(i, pick(None, [], ["Wave"], ["wave", "Tide", "wave"], ["tide", "reef"]), pick(None, "", "negative", "positive"), pick(None, "A", "B"),
             pick(None, "SE", "NO"), pick(None, "social", "media", "blog"), "2024-03-01") for i in range(n)]


def _rules(n, rng):
    some = lambda values: rng.sample(values, rng.choice([0, 0, 1, 2]))
    out = []
    for i in range(n):
        c = {"keywords": some(["WAVE", "tide", "reef"]), "sentiments": some(["negative", "positive"]), "sources": some(["A", "B"]), "countries": some(["SE", "NO"])}
        if i % 7 == 0:
            c = {"keywords": None}
        out.append((i, "instant", None, rng.choice(["media", "social"]), i % 11 != 10, json.dumps(c)))
    return out


def _accepts(rule, article):
    c, (_, words, sentiment, source, country, category, _) = json.loads(rule[5]), article
    if not rule[4] or (category == "social") != (rule[3] == "social"):
        return False
    wanted = {k.lower() for k in c.get("keywords") or []}
    facets = (("sentiments", sentiment), ("sources", source), ("countries", country))
    return (not wanted or bool(wanted & {w.lower() for w in words or []})) and all(not c.get(f) or (v or "") in c[f] for f, v in facets)


@pytest.mark.parametrize("decision_rows", [0, saved.DECISION_ROWS])
def test_both_forms_equal_a_loop(spark, decision_rows):
    rng = random.Random(5)
    articles, rules = _articles(150, rng), _rules(120, rng)
    want = sorted((r[0], a[0]) for r in rules for a in articles if _accepts(r, a))
    found = saved.evaluate_alerts(literal_table(spark, ARTICLES, articles), literal_table(spark, RULES, rules), decision_rows)
    assert sorted((r.rule_id, r.id) for r in found.collect()) == want and want


@pytest.mark.parametrize("decision_rows", [0, saved.DECISION_ROWS])
def test_no_rules_and_no_articles(spark, decision_rows):
    articles, rules = literal_table(spark, ARTICLES, _articles(5, random.Random(1))), literal_table(spark, RULES, _rules(5, random.Random(1)))
    assert saved.evaluate_alerts(articles, rules.limit(0), decision_rows).count() == 0
    assert saved.evaluate_alerts(articles.limit(0), rules, decision_rows).count() == 0


def test_many_rules_that_accept_everything_keep_tasks_even(spark):
    rules = spark.range(saved.DECISION_ROWS + 1).select(
        F.col("id").alias("rule_id"), F.lit("instant").alias("rule_type"), F.lit(None).cast("string").alias("digest_schedule"), F.lit("media").alias("alert_category"),
        F.lit(True).alias("active"), F.lit("{}").alias("conditions"))
    articles = spark.range(400).select(
        "id", F.array().cast("array<string>").alias("matched_keywords"), *[F.lit(None).cast("string").alias(c) for c in ("sentiment", "source_name", "country", "source_category")],
        F.current_timestamp().alias("published_at"))
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in plain}
    for name, value in plain.items():
        spark.conf.set(name, value)
    try:
        found = saved.evaluate_alerts(articles, rules)
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 400 * (saved.DECISION_ROWS + 1)
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 1.5 * sum(sizes) / len(sizes)


def test_few_rules_made_from_a_large_table_leave_articles_where_they_are(spark, tmp_path):
    from conftest import plan_text

    rng = random.Random(6)
    literal_table(spark, RULES, _rules(40, rng)).write.parquet(str(tmp_path / "rules"))
    literal_table(spark, ARTICLES, _articles(60, rng)).write.parquet(str(tmp_path / "articles"))
    rules, articles = spark.read.parquet(str(tmp_path / "rules")), spark.read.parquet(str(tmp_path / "articles"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        wide = rules.crossJoin(spark.range(200_000)).groupBy(*rules.columns).agg(F.count(F.lit(1)).alias("n")).drop("n")
        plan = plan_text(saved.evaluate_alerts(articles, wide))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
