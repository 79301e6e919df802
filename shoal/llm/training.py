"""Labelled rows for the classifiers: a bounded sample by hash, never the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo five; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, text_col: str = "text") -> DataFrame:
    """``(doc_id, label, fold, text)`` of at most ``per_class`` training ids of each label.

    The ids are the first by hash among the labelled ids outside fold 0, so the sample is the same on every
    run. At most ``2 * per_class`` ids are broadcast. Ids that are null, labelled twice
    differently or without text are left out; of repeated documents one is taken.
    """
    ids = labels.select(F.col("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold_of(F.col("doc_id")) != 0))
    ids = ids.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other"))
    ids = ids.where(F.col("label") == F.col("_other")).select("doc_id", "label")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    taken = [ids.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    few = F.broadcast(taken[0].unionByName(taken[1]))
    texts = docs.select(F.col("doc_id"), F.col(f"`{text_col}`").alias("text")).where(F.col("text") != "")
    rows = texts.join(few, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return rows.select("doc_id", "label", fold_of(F.col("doc_id")).cast("int").alias("fold"), "text")
