"""A training corpus from ``documents``: reject, deduplicate, decontaminate, mask, encode.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept; all but the
last return the columns of ``docs``. ``run`` writes each stage's rows to the shared folder and reads
them again, so that no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.common import ready, written
from shoal.llm.decontaminate import decontaminated
from shoal.llm.jaccard_join import one_of_each
from shoal.llm.quality_classifier import accepted, fit_quality
from shoal.llm.registry import PIECE_MODEL
from shoal.llm.secret_scan import mask_secrets
from shoal.llm.unigram import encoded

# No SQL can train the classifier or search the best sequence of pieces.
ORACLE_SQL = None


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    ready(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return accepted(docs, fit_quality(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of the 0.8-Jaccard join on five-word shingles."""
    ready(spark)
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window (or a whole shorter item) of the benchmark."""
    ready(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_found_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; ``n_chars`` follows the text."""
    ready(spark)
    masked = mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, log_score, decoded)`` of every document."""
    ready(spark)
    out = encoded(docs, PIECE_MODEL, ["doc_id"])
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "log_score", "decoded")


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_found_secrets),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
