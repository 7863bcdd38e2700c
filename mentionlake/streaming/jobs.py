"""Structured Streaming jobs: live feed, volumes, run status, notifications, alerts,
scheduled ingest and registry changes.

State is bounded by a watermark on the arrival time. Writers that keep a
snapshot rewrite only the hash buckets a batch touches, under its batch id, so
a replayed batch overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from mentionlake.operators import saved
from mentionlake.operators.dedup import first_per_key, top_per_key
from mentionlake.operators.filters import visible
from mentionlake.operators.registry import sync_registry
from mentionlake.session import is_directory, path_exists, shared_path
from mentionlake.sources.buckets import BUCKETS, is_bucketed, merge as merge_buckets, read as read_buckets
from mentionlake.sources.sinks import apply_updates, upsert_ignore

ARRIVAL_DELAY = "7 days"


def stream_files(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """Stream of a folder, or of one file inside its folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if is_directory(spark, path):
        return reader.load(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).load(folder)


def live_feed(stream: DataFrame, delay: str = ARRIVAL_DELAY) -> DataFrame:
    """New visible articles, each id once; rows later than the watermark are dropped."""
    return visible(stream).withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["id"])


def stream_volume(
    stream: DataFrame, width: str = "1 day", slide: str | None = None, by: Sequence[str] = (), delay: str = ARRIVAL_DELAY
) -> DataFrame:
    """Mention volume per tumbling (or sliding) window of publication time."""
    w = F.window("published_at", width, slide) if slide else F.window("published_at", width)
    counts = stream.withWatermark("published_at", delay).groupBy(w.alias("w"), *by).agg(
        F.count(F.lit(1)).alias("articles"), F.count(F.when(F.col("sentiment") == "negative", 1)).alias("negative")
    )
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "articles", "negative")


def stream_bursts(stream: DataFrame, gap: str = "30 minutes", by: Sequence[str] = ("source_id",), delay: str = ARRIVAL_DELAY) -> DataFrame:
    """Bursts: runs of mentions of one group with no pause longer than ``gap``."""
    w = F.session_window("published_at", gap)
    return stream.withWatermark("published_at", delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("articles")).select(
        *by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "articles"
    )


def open_bursts(spark: SparkSession, checkpoint: str, by: Sequence[str] = ("source_id",)) -> DataFrame:
    """Bursts a stopped ``stream_bursts`` still holds open, read from its state."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(
        *[F.col(f"value.{c}") for c in by], F.col("value.session_window.start").alias("window_start"),
        F.col("value.session_window.end").alias("window_end"), F.col("value.count").alias("articles"),
    )


def all_bursts(
    stream: DataFrame, target: str, checkpoint: str, gap: str = "30 minutes", by: Sequence[str] = ("source_id",), delay: str = ARRIVAL_DELAY
) -> DataFrame:
    """Take everything that has arrived; returns the bursts of all runs so far, ``open`` telling those that may grow.

    A stream alone shows a burst once its watermark has passed it, so the last bursts of a
    bounded input would never come out. They are read from the state after the run, which is left as
    it is: the next run with the same ``checkpoint`` continues them.
    """
    spark = stream.sparkSession
    bursts = stream_bursts(stream, gap, by, delay)
    _write_batches(bursts, target, "append", checkpoint)
    if not path_exists(spark, target):
        return spark.createDataFrame([], bursts.schema).withColumn("open", F.lit(False))
    closed = spark.read.schema(bursts.schema).parquet(target).select(*bursts.columns, F.lit(False).alias("open"))
    return closed.unionByName(open_bursts(spark, checkpoint, by).withColumn("open", F.lit(True)))


#: The status of a run that has not ended.
RUNNING = "running"


def _track_run(stale_after_ms: int):
    """State of one run: its last change. A run without changes for the given time is reported once more and forgotten."""

    def track(key, frames, state):
        import pandas as pd

        row = lambda at, status, stale: pd.DataFrame({"run_id": [key[0]], "status": [status], "at": [at], "stale": [stale]})
        last = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield row(*last, last[1] == RUNNING)
            return
        rank = lambda change: (change[0], change[1] is not None, change[1] or "")
        changes = [(int(at), None if pd.isna(status) else status) for f in frames for at, status in zip(f["at_us"], f["status"])]
        last = max(changes if last is None else [*changes, tuple(last)], key=rank)
        state.update(last)
        state.setTimeoutTimestamp(last[0] // 1000 + stale_after_ms)
        yield row(*last, False)

    return track


def run_status(changes: DataFrame, stale_after: timedelta = timedelta(days=7), delay: str = "1 day") -> DataFrame:
    """Latest status per ingestion run; ``changes``: run_id, status, at. Of equal times the last status
    in order counts. Update mode.

    A stream also tells ``stale``: a run that is still running when the watermark (the newest change
    minus ``delay``) is ``stale_after`` beyond its last change. Its state goes then, as that of ended runs
    does, so state holds the runs of a bounded time. Changes without a time or behind the
    watermark take no part in a stream.
    """
    if not changes.isStreaming:
        return changes.groupBy("run_id").agg(F.max(F.struct("at", "status")).alias("last")).select("run_id", "last.status", "last.at")
    ms = max(1, int(stale_after.total_seconds() * 1000))
    timed = changes.filter("at IS NOT NULL").withWatermark("at", delay).select("run_id", "status", "at", F.unix_micros("at").alias("at_us"))
    out = f"run_id {changes.schema['run_id'].dataType.simpleString()}, status string, at long, stale boolean"
    tracked = timed.groupBy("run_id").applyInPandasWithState(_track_run(ms), out, "at long, status string", "update", GroupStateTimeout.EventTimeTimeout)
    return tracked.withColumn("at", F.timestamp_micros("at"))


def is_fetching(status: DataFrame, count_stale: bool = True) -> DataFrame:
    """One row: is any run still running, and how many; with ``count_stale=False`` runs given up do not count."""
    counted = F.lit(True) if count_stale else ~F.coalesce("stale", F.lit(False))
    running = F.count(F.when((F.col("status") == RUNNING) & counted, 1))
    return status.agg((running > 0).alias("fetching"), running.alias("running"))


def alert_stream(stream: DataFrame, rules: DataFrame, delay: str = ARRIVAL_DELAY) -> DataFrame:
    """Alerts of a streaming feed against the static rule table."""
    return saved.evaluate_alerts(stream.withWatermark("published_at", delay), rules)


def _write_batches(df: DataFrame, target: str, mode: str, checkpoint: str) -> None:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def drain(df: DataFrame, label: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream over everything available and read its output back.

    In update mode the last value per ``keys`` counts. Output and state live in
    the shared folder.
    """
    spark = df.sparkSession
    target = shared_path(spark, label)
    _write_batches(df, target, mode, shared_path(spark, f"{label}-state"))
    out = spark.read.parquet(target)
    if mode == "update":
        out = first_per_key(out, list(keys), [F.col("batch").desc()])
    return out.drop("batch")


def notification_feed(stream: DataFrame, snapshot: str, checkpoint: str, k: int = 20, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the newest ``k`` notifications per user in ``snapshot``, bucketed by user.

    A batch rewrites the lists of the buckets its users fall into; the snapshot holds at most
    ``k`` rows per user, whatever has arrived. Of equal times the largest id counts as newest.
    """

    def newest(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch if before is None else before.unionByName(batch)
        return top_per_key(rows.dropDuplicates(["id"]), ["user_id"], [F.col("created_at").desc(), F.col("id").desc()], k)

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_buckets(snapshot, batch, batch_id, "user_id", newest, buckets)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()


def latest_snapshot(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """Newest state below ``root`` (older than batch ``before``), or None: the current version of
    every bucket, or the newest batch folder of a snapshot without buckets."""
    if is_bucketed(spark, root):
        return read_buckets(spark, root, before)
    if not path_exists(spark, root):
        return None
    jvm = spark.sparkContext._jvm
    hroot = jvm.org.apache.hadoop.fs.Path(root)
    fs = hroot.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    ids = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(hroot) if s.getPath().getName().startswith("batch=")]
    ids = [i for i in ids if before is None or i < before]
    return spark.read.parquet(f"{root}/batch={max(ids)}") if ids else None


def update_stream(
    stream: DataFrame, snapshot: str, checkpoint: str, order: str = "fetched_at", key: str = "id", buckets: int = BUCKETS
) -> StreamingQuery:
    """Apply article updates to a snapshot made by ``buckets.create``; only touched buckets are rewritten.

    Updates of unknown ids are ignored; of several updates of an id in a batch the latest counts.
    """

    def update(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        return batch.limit(0) if before is None else apply_updates(before, batch, key, [F.col(order).desc()])

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_buckets(snapshot, batch, batch_id, key, update, buckets)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()


def registry_stream(changes: DataFrame, snapshot: str, checkpoint: str) -> StreamingQuery:
    """Registry change feed: every batch yields a new source snapshot."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        sources = latest_snapshot(batch.sparkSession, snapshot, batch_id)
        sync_registry(batch, sources).write.mode("overwrite").parquet(f"{snapshot}/batch={batch_id}")

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()


def start_ingest(
    landed: DataFrame, pipeline: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "url"
) -> StreamingQuery:
    """Scheduled ingest: take what has landed, run the batch pipeline, insert unseen rows.

    Started hourly by any scheduler; a replayed batch inserts nothing twice
    because stored URLs are ignored.
    """

    def insert(batch: DataFrame, batch_id: int) -> None:
        upsert_ignore(target, pipeline(batch), key=key)

    return landed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(insert).trigger(availableNow=True).start()
