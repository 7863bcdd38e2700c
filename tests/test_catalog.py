"""Every registered query against its SQL on DuckDB, and rules that hold for all plans."""

import re
from pathlib import Path

import pytest
from conftest import ROOT, SMALL, plan_text
from oracle_check import compare, duck

import __spark_entry__ as entry
from mentionlake.plans import catalog

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    status, _, _, diff = compare(spark, con, QUERIES[name], ORACLES.get(name), SMALL)
    assert status in ("ok", "rows-only"), diff


def test_entry(spark):
    assert entry.entry(spark).count() == 6


def test_every_query_has_sql():
    assert not set(QUERIES) - set(ORACLES)


def test_no_local_state_in_the_package():
    text = "\n".join(p.read_text() for p in Path(ROOT, "mentionlake").rglob("*.py") if p.parent.name != "llm")
    assert "localCheckpoint" not in text and ".toPandas(" not in text and "crossJoin" not in text
    hinted = re.findall(r"F\.broadcast\(([a-z]+)", text)
    assert sorted(hinted) == ["counts", "table"], "broadcast hints need a size bound: " + str(hinted)


@pytest.mark.parametrize("name", ["share_of_voice", "daily_volume", "top_sources", "dedup_first", "exclude_known", "route_topics", "alerts_batch"])
def test_plans_stay_in_the_jvm_without_cartesian_products(spark, name):
    text = plan_text(QUERIES[name](spark, SMALL))
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["share_of_voice", "match_word", "language_filter", "dedup_first"])
def test_labels_and_round_robin_stay_out_of_queries_that_need_neither(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_text(QUERIES[name](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "labels.parquet" not in text and "RoundRobin" not in text and "quality" not in text
