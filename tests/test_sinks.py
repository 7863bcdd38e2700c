"""The insert-ignore sink: what it reads of the stored table, and tables of either layout."""

from pyspark.sql import functions as F

from mentionlake.session import shared_path
from mentionlake.sources import sinks
from mentionlake.sources.buckets import bucket_of


def _urls(spark, lo, hi):
    return spark.range(lo, hi).select("id", F.concat(F.lit("https://h/"), "id").alias("url"), F.timestamp_seconds(F.col("id") * 3_600).alias("published_at"))


def test_only_touched_buckets_are_searched_and_stored_keys_are_not_shuffled(spark):
    target = shared_path(spark, "t")
    assert sinks.upsert_ignore(target, _urls(spark, 0, 300)) == 300
    assert sinks.upsert_ignore(target, _urls(spark, 298, 302)) == 2
    stored = spark.read.parquet(target)
    column = f"{sinks.BUCKET_COLUMN}{sinks.KEY_BUCKETS}"
    assert stored.count() == 302 and {"day", column} <= set(stored.columns)
    batch = _urls(spark, 7, 8)
    bucket = batch.select(bucket_of("url", sinks.KEY_BUCKETS)).first()[0]
    plan = sinks.new_rows(stored.filter(F.col(column).isin([bucket])), batch, "url", [F.col("url")])._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert column in scan.split("PartitionFilters")[1] and "ReadSchema: struct<url:string>" in scan
    assert "LeftSemi, BuildRight" in plan.split("Physical Plan")[1]


def test_the_first_row_of_an_unknown_key_is_new(spark):
    batch = _urls(spark, 5, 15).unionByName(_urls(spark, 12, 15)).unionByName(_urls(spark, 0, 1).withColumn("url", F.lit(None).cast("string")))
    rows = sinks.new_rows(_urls(spark, 0, 10), batch, "url", [F.col("id")])
    assert sorted(r.id for r in rows.collect()) == list(range(10, 15))


def test_a_table_without_buckets_keeps_its_layout(spark):
    target = shared_path(spark, "old")
    _urls(spark, 0, 10).withColumn("day", F.to_date("published_at")).write.partitionBy("day").parquet(target)
    assert sinks.upsert_ignore(target, _urls(spark, 5, 12)) == 2
    stored = spark.read.parquet(target)
    assert not [c for c in stored.columns if c.startswith(sinks.BUCKET_COLUMN)] and sorted(r.id for r in stored.collect()) == list(range(12))


def test_an_empty_batch_inserts_nothing(spark):
    target = shared_path(spark, "t")
    sinks.upsert_ignore(target, _urls(spark, 0, 3))
    assert sinks.upsert_ignore(target, _urls(spark, 0, 0)) == 0
    assert sinks.upsert_ignore(target, _urls(spark, 0, 3), buckets=5) == 0  # the table keeps its own number
    assert spark.read.parquet(target).count() == 3
