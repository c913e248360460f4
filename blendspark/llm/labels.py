"""Labelled rows for fitting, without the held-out fold."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the doc_id as text is divisible by ``FOLDS`` (null: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, y (0 or 1): one row per labelled document outside the held-out fold (of
    several labels the larger; rows without id or label are left out)."""
    rows = labels.select("doc_id", F.col(column).cast("int").alias("y")).where("doc_id is not null and y is not null")
    return rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("y") > 0).cast("int")).alias("y"))


def with_fold(scored: DataFrame, threshold: float) -> DataFrame:
    """scored (doc_id, score, more) with held_out and the decision at a threshold."""
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), *[c for c in scored.columns if c not in ("doc_id", "score")],
    )
