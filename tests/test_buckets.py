"""Bucketed snapshots: what a batch rewrites, replays, and what survives between versions."""

import pytest
from pyspark.sql import functions as F

from mentionlake.session import shared_path
from mentionlake.sources import buckets as B
from mentionlake.sources.sinks import apply_updates
from mentionlake.streaming import jobs


def _rows(spark, lo, hi, title="old"):
    return spark.range(lo, hi).select("id", F.lit(title).alias("title"), F.timestamp_seconds("id").alias("fetched_at"))


def _files(spark, root):
    return set(B._list(spark, f"{root}/bucket=*/batch=*/part-*"))


def test_a_small_batch_rewrites_only_its_buckets_and_a_replay_changes_nothing(spark):
    root, landed = shared_path(spark, "live"), shared_path(spark, "changes")
    B.create(root, _rows(spark, 0, 500), "id", 16)
    first = _files(spark, root)
    assert len({f.split("/")[-3] for f in first}) == 16
    _rows(spark, 7, 8, "new").unionByName(_rows(spark, 9_000, 9_001, "unknown")).write.parquet(landed)
    stream = lambda: spark.readStream.schema("id long, title string, fetched_at timestamp").parquet(landed)
    want = [(i, "new" if i == 7 else "old") for i in range(500)]
    for _ in range(2):  # the second run starts without its checkpoint and replays batch 0
        jobs.update_stream(stream(), root, shared_path(spark, "state"), buckets=16).awaitTermination()
        assert sorted(tuple(r) for r in jobs.latest_snapshot(spark, root).select("id", "title").collect()) == want
        fresh = _files(spark, root) - first
        assert 1 <= len({f.split("/")[-3] for f in fresh}) <= 2
        assert first <= _files(spark, root)


def test_unmarked_batches_are_not_read_and_old_versions_go(spark):
    root = shared_path(spark, "live")
    B.create(root, _rows(spark, 0, 20), "id", 1)
    late = _rows(spark, 0, 20, "torn").withColumn("bucket", F.lit(0)).withColumn("batch", F.lit(0))
    late.write.mode("append").partitionBy("bucket", "batch").parquet(root)
    assert {r.title for r in B.read(spark, root).collect()} == {"old"}
    change = lambda before, batch: apply_updates(before, batch, "id", [F.col("fetched_at").desc()])
    for n in range(4):
        assert B.merge(root, _rows(spark, n, n + 1, f"v{n}"), n, "id", change, 1) == {0}
    assert sorted(r.title for r in B.read(spark, root).filter("id < 4").collect()) == ["v0", "v1", "v2", "v3"]
    assert [b for b, _ in B.versions(spark, root)[0]] == [3, 2]
    assert B.read(spark, root).count() == 20


def test_null_keys_empty_batches_and_another_number_of_buckets(spark):
    root = shared_path(spark, "live")
    assert B.read(spark, root) is None and jobs.latest_snapshot(spark, root) is None
    odd = _rows(spark, 0, 3).withColumn("id", F.when(F.col("id") > 0, F.col("id")))
    B.create(root, odd, "id", 4)
    assert B.merge(root, odd.limit(0), 0, "id", lambda before, batch: batch, 4) == set()
    assert sorted(str(r.id) for r in B.read(spark, root).collect()) == ["1", "2", "None"]
    with pytest.raises(ValueError):
        B.merge(root, odd, 1, "id", lambda before, batch: batch, 8)


def test_notifications_touch_only_the_buckets_of_their_users(spark):
    path, snap, state = shared_path(spark, "n"), shared_path(spark, "snap"), shared_path(spark, "nstate")

    def step(users, start):
        rows = spark.range(start, start + 30 * users).select("id", (F.col("id") % users).cast("int").alias("user_id"), F.timestamp_seconds("id").alias("created_at"))
        rows.write.mode("append").parquet(path)
        stream = spark.readStream.schema("id bigint, user_id int, created_at timestamp").parquet(path)
        jobs.notification_feed(stream, snap, state, buckets=16).awaitTermination()

    step(40, 0)
    before = _files(spark, snap)
    step(1, 10_000)
    fresh = _files(spark, snap) - before
    assert len({f.split("/")[-3] for f in fresh}) == 1
    feed = jobs.latest_snapshot(spark, snap)
    assert feed.count() == 40 * 20
    assert sorted(r.id for r in feed.filter("user_id = 0").collect()) == list(range(10_010, 10_030))
