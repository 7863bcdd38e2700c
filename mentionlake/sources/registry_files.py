"""Bulk import of publisher registries (CSV with header, or JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mentionlake.functions.text import first_non_empty
from mentionlake.operators.dedup import first_per_key

_DDL = """name string, domain string, country_code string, region string, language string,
          source_type string, feed_url string, active string"""


def read_registry(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Raw rows; CSV columns are found by (case-insensitive) header name, quoted commas are kept."""
    fmt = fmt or ("json" if path.endswith(".json") else "csv")
    if fmt == "json":
        return spark.read.schema(_DDL).option("multiLine", True).json(path)
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).csv(path)
    present = {c.strip().lower(): c for c in raw.columns}
    names = [f.split()[0] for f in _DDL.split(",")]
    return raw.select(*[(F.col(f"`{present[n]}`") if n in present else F.lit(None).cast("string")).alias(n) for n in names])


def import_registry(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """New pending registry rows with defaults; domains already present are ignored."""
    blank = lambda c, default: F.coalesce(first_non_empty(F.col(c)), F.lit(default)).alias(c)
    typed = rows.select(
        first_non_empty(F.col("name"), F.col("domain")).alias("name"), "domain", blank("country_code", "US"), blank("region", "global"),
        blank("language", "en"), blank("source_type", "rss"), first_non_empty(F.col("feed_url")).alias("feed_url"),
        F.lit("pending").alias("approval_status"), (F.lower(F.coalesce("active", F.lit("true"))) != "false").alias("active"),
    ).filter(F.coalesce("domain", F.lit("")) != "")
    unique = first_per_key(typed, ["domain"], [F.col("name").asc(), F.col("feed_url").asc_nulls_last()])
    return unique.join(existing.select("domain"), "domain", "left_anti")
