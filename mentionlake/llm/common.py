"""What several operators share: reading tables, shipping the package to workers, text arithmetic."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import mentionlake
from mentionlake.session import materialize
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(mentionlake.__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it lies at the driver's path.

    Workers that already have it (``--py-files``, an installed wheel) are unaffected.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [ROOT])
    return spark


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, jobs hand Python workers at most ``rows`` rows at once and read Parquet in vectors of 512 rows: long texts
    and sets need less memory."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.parquet.columnarReaderBatchSize": "512"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once what was made of it is itself written."""
    files = df.inputFiles()
    if files:
        jvm = df.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(text: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes sum to about ``limit``; a larger item stands alone.

    Nothing is left out: this only bounds how much of a batch is unpacked at once.
    """
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def running(df: DataFrame, label: str, group: list[str], order: list[str], values: dict[str, str] | None = None, facts: DataFrame | None = None) -> DataFrame:
    """``df`` with ``__index``, a row's place in its group (from 0), and per item of ``values`` the sum of that column before it.

    Rows are range-partitioned by group and order, so a group of any size lies in many partitions; only
    counts and sums per group and partition meet, and each partition numbers its own rows. Fully equal rows are
    interchangeable and dealt out by a salt. Null groups and null order values are groups and values like others, null
    order values last. ``facts`` (one row per group) are joined where only those sums are, never to the rows.
    """
    values = values or {}
    spread = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    by = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    cut = materialize(spread.repartitionByRange(*by, "__salt").drop("__salt").withColumn("__part", F.spark_partition_id()), label)
    sums = cut.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(c) for c in values])
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = {"__n": F.sum("__n").over(earlier)} | {c: F.sum(c).over(earlier) for c in values}
    if facts is not None:
        same = F.lit(True)
        for c in group:
            same = same & sums[c].eqNullSafe(facts[c])
        sums = sums.join(facts, same).select(*[sums[c] for c in sums.columns], *[facts[c] for c in facts.columns if c not in group])
    extra = [] if facts is None else [c for c in facts.columns if c not in group]
    sums = sums.select(*[F.col(c).alias(f"__g_{c}") for c in group], F.col("__part").alias("__p"), *extra, *[F.coalesce(v, F.lit(0)).alias(f"__b_{c}") for c, v in base.items()])
    on = F.col("__part") == F.col("__p")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    here = Window.partitionBy(*group, "__part").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    upto = here.rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.join(sums, on).withColumns(
        {"__index": F.col("__b___n") + F.row_number().over(here) - 1}
        | {name: F.col(f"__b_{c}") + F.coalesce(F.sum(c).over(upto), F.lit(0)) for c, name in values.items()}
    )
    return placed.select(*df.columns, *extra, "__index", *values.values())
