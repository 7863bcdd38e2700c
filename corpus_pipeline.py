"""The corpus pipeline: documents in, cleaned and tokenised documents out.

``STAGES`` lists the steps in order. Each takes (spark, docs, sf_dir), works on every row it
gets and returns a DataFrame; ``run`` writes each result as Parquet to the shared folder and
reads it again for the next one, so a lost executor costs one stage's tasks at most. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm import bpe, decontamination, factorisation, jaccard_join, pii
from mentionlake.llm.common import table
from mentionlake.session import shared_path

LEAST_QUALITY = 0.3
#: What a stage holds at once: bytes of a batch handed to a Python worker, bytes of a row group that is being written,
#: rows that the Parquet reader unpacks.
PORTIONS = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "parquet.block.size": str(16 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def in_portions(spark: SparkSession) -> SparkSession:
    """From here on the session moves whole texts in small portions; long texts still travel whole."""
    for name, value in PORTIONS.items():
        spark.conf.set(name, value)
    return spark


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts; it learns from the labels of its input."""
    model = factorisation.train(docs, table(in_portions(spark), sf_dir, "labels"))
    scored = factorisation.score_documents(docs, model, out="__score")
    return scored.filter(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    in_portions(spark)
    return jaccard_join.keep_one(docs, width=5, percent=80).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontamination.decontaminate(docs, table(in_portions(spark), sf_dir, "benchmark")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the new text."""
    in_portions(spark)
    masked = pii.redact(docs, pii.train(docs))
    counted = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return masked.withColumns(counted).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether decoding gives the text back."""
    in_portions(spark)
    path = bpe.default_path("byte_bpe_50k.json")
    coded = bpe.round_trip_documents(docs, path, ids="ids", decoded="__decoded")
    return coded.select(
        *docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("__decoded") == F.coalesce("text", F.lit(""))).alias("exact")
    )


STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("bpe_encoding", tokens),
]

#: SQL cannot state the classifier, the trees or the coder; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
