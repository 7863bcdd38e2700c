"""Keyed Parquet snapshots in hash buckets.

A row lies in the bucket of its key's hash, and every bucket keeps its own
versions: ``bucket=7/batch=3`` is bucket 7 as batch 3 left it. A batch reads and
rewrites the buckets its keys fall into and no others; a success marker makes
all its versions current at once. A replayed batch starts from the versions
before it and overwrites its own. The two newest versions of a bucket stay, so
readers that opened the former one can finish.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mentionlake.session import path_exists

BUCKETS = 64
MARKERS = "_done"


def bucket_of(key: str, buckets: int) -> Column:
    """Bucket number of a key; rows without a key share the bucket of the hash of null."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def _list(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob on whatever file system it names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [str(f.getPath()) for f in found or []]


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _mark(spark: SparkSession, root: str, buckets: int, batch_id: int) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{MARKERS}/{buckets}_{batch_id}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True).close()


def is_bucketed(spark: SparkSession, root: str) -> bool:
    return path_exists(spark, f"{root}/{MARKERS}")


def committed(spark: SparkSession, root: str) -> tuple[int | None, set[int]]:
    """(number of buckets, batches with a success marker) of a snapshot; (None, empty) of none."""
    marks = [tuple(map(int, p.rpartition("/")[2].split("_"))) for p in _list(spark, f"{root}/{MARKERS}/*_*")]
    return (marks[0][0] if marks else None), {batch for _, batch in marks}


def versions(spark: SparkSession, root: str, before: int | None = None) -> dict[int, list[tuple[int, str]]]:
    """Committed (batch, path) of every bucket, newest first; with ``before`` only older batches."""
    done = {b for b in committed(spark, root)[1] if before is None or b < before}
    out: dict[int, list[tuple[int, str]]] = {}
    for path in _list(spark, f"{root}/bucket=*/batch=*"):
        bucket, batch = (int(part.rpartition("=")[2]) for part in path.split("/")[-2:])
        if batch in done:
            out.setdefault(bucket, []).append((batch, path))
    return {bucket: sorted(held, reverse=True) for bucket, held in out.items()}


def read(spark: SparkSession, root: str, before: int | None = None, only: set[int] | None = None) -> DataFrame | None:
    """The current rows (of the buckets ``only``), or None where nothing is stored."""
    paths = [held[0][1] for bucket, held in sorted(versions(spark, root, before).items()) if only is None or bucket in only]
    return spark.read.parquet(*paths) if paths else None


def merge(
    root: str, batch: DataFrame, batch_id: int, key: str, change: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = BUCKETS
) -> set[int]:
    """Store ``change(before, batch)`` as the new version of the buckets that ``batch`` touches; returns these.

    ``before`` holds all rows of the touched buckets, None if there are none. Rows of ``change``
    must keep to the keys of its inputs. An empty batch only leaves its marker. The number of
    buckets is fixed by the first batch. At most ``buckets`` numbers reach the driver.
    """
    spark = batch.sparkSession
    stored, _ = committed(spark, root)
    if stored not in (None, buckets):
        raise ValueError(f"{root} has {stored} buckets, not {buckets}")
    batch = batch.persist()
    try:
        touched = {r[0] for r in batch.select(bucket_of(key, buckets)).distinct().collect()}
        if touched:
            rows = change(read(spark, root, batch_id, touched), batch)
            placed = rows.withColumn("bucket", bucket_of(key, buckets)).withColumn("batch", F.lit(batch_id)).hint("rebalance", "bucket")
            placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(root)
        _mark(spark, root, buckets, batch_id)
    finally:
        batch.unpersist()
    for bucket, held in versions(spark, root).items():
        if bucket in touched:
            for _, path in held[2:]:
                _delete(spark, path)
    return touched


def create(root: str, rows: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """The first version of a snapshot, as batch -1."""
    merge(root, rows, -1, key, lambda _, first: first, buckets)
