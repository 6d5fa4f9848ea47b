"""Labelled rows for training: a bounded sample, the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(col, folds: int):
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(col.cast("string").cast("binary")) % folds


def sample(labels: DataFrame, id_col: str, label: str, folds: int, out: int, most: int) -> DataFrame:
    """(id, y) of at most `most` ids outside fold `out`: those whose hashes are smallest; of several labels the largest."""
    own = labels.select(labels[id_col].cast("long").alias("id"), labels[label].cast("int").alias("y")).where("id is not null and y is not null")
    return own.where(fold(F.col("id"), folds) != out).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
