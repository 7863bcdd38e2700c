"""Session set-up and the few places where a job touches the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession


def get_session(app: str = "mentionlake", master: str | None = None, shuffle: int | None = None) -> SparkSession:
    """Build a session; on a cluster leave ``master`` unset so spark-submit decides."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle))
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Day buckets are UTC days whatever the caller's locale."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir``.

    A machine-local fallback is allowed only in local mode, where driver and
    executors share one disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        import tempfile

        configured = tempfile.mkdtemp(prefix="mentionlake-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for intermediate tables and stream state."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost
    executors, and later readers prune columns.

    The result asks for merge joins: copies compress so well that the file size
    would suggest a broadcast of a table that does not fit in memory.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written once and read back; Catalyst makes a join with it a broadcast only if the files are small."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_directory(spark: SparkSession, path: str) -> bool:
    """True when ``path`` is a directory on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath) and fs.getFileStatus(hpath).isDirectory()


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def bounded_rows(df: DataFrame, max_rows: int) -> list[Row] | None:
    """Rows of a dictionary table if it has at most ``max_rows`` rows, else None.

    Only ``max_rows + 1`` rows can ever reach the driver. Callers must have a
    distributed way for the None case.
    """
    rows = df.limit(max_rows + 1).collect()
    return None if len(rows) > max_rows else rows
