"""Streams: late rows, replays, and equality with the batch operators."""

from datetime import datetime, timedelta

from conftest import SMALL
from pyspark.sql import functions as F

from mentionlake.functions.scalars import literal_table
from mentionlake.operators import aggregates as A, saved
from mentionlake.operators.dedup import first_per_key
from mentionlake.plans.queries_rows import alert_rules
from mentionlake.session import shared_path
from mentionlake.sources import tables as T
from mentionlake.streaming import jobs

DDL = "id int, is_duplicate boolean, relevance_label string, fetched_at timestamp"


def _write(spark, path, rows):
    literal_table(spark, "id int, is_duplicate boolean, relevance_label string, fetched_at string", rows).withColumn(
        "fetched_at", F.col("fetched_at").cast("timestamp")).write.mode("append").parquet(path)


def test_live_feed_dedups_and_drops_late_rows(spark):
    path, target, state = shared_path(spark, "in"), shared_path(spark, "out"), shared_path(spark, "state")

    def step(rows):
        _write(spark, path, rows)
        feed = jobs.live_feed(spark.readStream.schema(DDL).parquet(path), delay="7 days")
        jobs._write_batches(feed, target, "append", state)
        return sorted(r.id for r in spark.read.parquet(target).collect())

    rows = [(1, None, None, "2024-03-01"), (1, False, "high", "2024-03-01"), (2, True, None, "2024-03-02"), (3, False, "noise", "2024-03-02"), (4, False, "low", "2024-03-20")]
    assert step(rows) == [1, 4]
    assert step([(4, False, "low", "2024-03-20"), (5, False, None, "2024-03-19"), (6, False, None, "2024-03-01")]) == [1, 4, 5]


def test_stream_volume_equals_batch(spark):
    events = jobs.stream_files(spark, f"{SMALL}/events.parquet", T.EVENTS_DDL)
    out = jobs.drain(jobs.stream_volume(T.event_articles(events)), "v", "update", ["window_start"])
    stream = {r.window_start.date(): (r.articles, r.negative) for r in out.collect()}
    batch = {r.day: (r.total, r.negative) for r in A.daily_volume(T.articles_from_events(spark, SMALL), 60, T.AS_OF).collect() if r.total}
    assert stream == batch


def test_alert_stream_equals_batch(spark):
    rules = alert_rules(spark, SMALL)
    events = jobs.stream_files(spark, f"{SMALL}/events.parquet", T.EVENTS_DDL)
    stream = jobs.drain(jobs.alert_stream(T.event_articles(events), rules).select("rule_id", "id"), "a")
    batch = saved.evaluate_alerts(T.articles_from_events(spark, SMALL), rules).select("rule_id", "id")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_run_status(spark):
    df = literal_table(spark, "run_id string, status string, at int", [("a", "running", 1), ("a", "success", 2), ("b", "running", 3)])
    status = jobs.run_status(df)
    assert {r.run_id: r.status for r in status.collect()} == {"a": "success", "b": "running"}
    assert jobs.is_fetching(status).first() == (True, 1)


def test_notifications_keep_newest_across_batches(spark):
    path, snap, state = shared_path(spark, "n"), shared_path(spark, "snap"), shared_path(spark, "nstate")
    for start in (0, 30, 60):
        spark.range(start, start + 30).select("id", F.lit(1).alias("user_id"), F.timestamp_seconds("id").alias("created_at"), F.lit(None).cast("timestamp").alias("read_at")).write.mode("append").parquet(path)
        stream = spark.readStream.schema("id bigint, user_id int, created_at timestamp, read_at timestamp").parquet(path)
        jobs.notification_feed(stream, snap, state).awaitTermination()
    assert sorted(r.id for r in jobs.latest_snapshot(spark, snap).collect()) == list(range(70, 90))


def test_ingest_replay_inserts_nothing(spark):
    path, target = shared_path(spark, "landed"), shared_path(spark, "articles")
    df = literal_table(spark, "url string, published_at string", [("a", "2024-03-01"), ("b", "2024-03-02")])
    df.write.parquet(path)
    read = lambda: spark.readStream.schema("url string, published_at string").parquet(path)
    for _ in range(2):
        jobs.start_ingest(read(), lambda b: b.withColumn("published_at", F.col("published_at").cast("timestamp")), target, shared_path(spark, "fresh-state")).awaitTermination()
    assert spark.read.parquet(target).count() == 2


def test_bursts_close_after_the_gap(spark):
    events = jobs.stream_files(spark, f"{SMALL}/events.parquet", T.EVENTS_DDL)
    out = jobs.drain(jobs.stream_bursts(T.event_articles(events), gap="2 hours", by=("source_category",), delay="1 hour"), "b")
    assert all(r.window_end > r.window_start for r in out.collect())
    assert isinstance(out.first().window_start, datetime)


def _land(spark, path, ddl, rows, times):
    df = literal_table(spark, ddl, rows)
    df.select(*[F.col(c).cast("timestamp").alias(c) if c in times else F.col(c) for c in df.columns]).write.mode("append").parquet(path)


def test_open_bursts_come_from_the_state_and_go_on_in_the_next_run(spark):
    path, target, state = shared_path(spark, "b"), shared_path(spark, "bout"), shared_path(spark, "bstate")
    read = lambda: spark.readStream.schema("source_id int, published_at timestamp").parquet(path)

    def step(*rows):
        _land(spark, path, "source_id int, published_at string", [(k, f"2024-03-01 {t}:00") for k, t in rows], ["published_at"])
        found = jobs.all_bursts(read(), target, state, "30 minutes", delay="1 hour").collect()
        return sorted((r.source_id, r.window_start.strftime("%H:%M"), r.articles, r.open) for r in found)

    assert step((1, "08:00"), (1, "08:20"), (2, "08:10")) == [(1, "08:00", 2, True), (2, "08:10", 1, True)]
    assert step((1, "08:45"), (1, "09:20")) == [(1, "08:00", 3, True), (1, "09:20", 1, True), (2, "08:10", 1, True)]
    assert step((3, "12:00")) == [(1, "08:00", 3, False), (1, "09:20", 1, False), (2, "08:10", 1, False), (3, "12:00", 1, True)]


def test_bursts_of_an_empty_folder(spark):
    path = shared_path(spark, "none")
    spark.range(0).select(F.lit(1).alias("source_id"), F.current_timestamp().alias("published_at")).write.parquet(path)
    stream = spark.readStream.schema("source_id int, published_at timestamp").parquet(path)
    assert jobs.all_bursts(stream, shared_path(spark, "o"), shared_path(spark, "s")).count() == 0


def test_runs_without_an_end_turn_stale_and_leave_the_state(spark):
    path, target, state = shared_path(spark, "r"), shared_path(spark, "rout"), shared_path(spark, "rstate")
    read = lambda: spark.readStream.schema("run_id string, status string, at timestamp").parquet(path)

    def step(*rows):
        _land(spark, path, "run_id string, status string, at string", rows, ["at"])
        status = jobs.run_status(read(), stale_after=timedelta(hours=6), delay="1 hour")
        jobs._write_batches(status, target, "update", state)
        last = first_per_key(spark.read.parquet(target), ["run_id"], [F.col("batch").desc()])
        held = {r[0] for r in spark.read.format("statestore").load(state).filter("value.groupState.status IS NOT NULL").select("key.run_id").collect()}
        return {r.run_id: (r.status, r.stale) for r in last.collect()}, held, jobs.is_fetching(last, count_stale=False).first().running

    out, held, running = step(("a", "running", "2024-03-01 08:00:00"), ("a", "success", "2024-03-01 09:00:00"), ("b", "running", "2024-03-01 09:00:00"), ("x", "running", None))
    assert out == {"a": ("success", False), "b": ("running", False)} and held == {"a", "b"} and running == 1
    out, held, running = step(("c", "running", "2024-03-02 08:00:00"))
    assert out == {"a": ("success", False), "b": ("running", True), "c": ("running", False)} and held == {"c"} and running == 1
    out, held, running = step(("b", "success", "2024-03-02 08:30:00"), ("c", "failed", "2024-03-02 08:00:00"))
    assert out == {"a": ("success", False), "b": ("success", False), "c": ("running", False)} and running == 1
