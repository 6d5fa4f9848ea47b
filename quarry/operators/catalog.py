"""Joins, totals and unions over a catalog of objects, uploads and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_optional(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of other, null where it has no row; uploads or parts with their checksums."""
    return rows.join(other, on, "left")


def members(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among the keys, each once."""
    return rows.join(keys.select(*on), on, "left_semi")


def merged_planes(warm: DataFrame, cold: DataFrame, on: list[str]) -> DataFrame:
    """Rows of both planes; of a key in both, the warm ones."""
    return warm.unionByName(cold.join(warm.select(*on), on, "left_anti"))


def first_of(rows: DataFrame, key: list[str | Column], order: str) -> DataFrame:
    """Of each key the row with the smallest order; an aggregate that combines before the shuffle, not a window."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), order).alias("__r")).select("__r.*")


def upload_sizes(parts: DataFrame, upload: str = "upload_id", size: str = "size") -> DataFrame:
    return parts.groupBy(upload).agg(F.sum(size).alias("size"), F.count("*").alias("parts"))


def gauges(objects: DataFrame, bucket: str = "bucket", size: str = "size") -> DataFrame:
    """One row: buckets, objects and bytes. Buckets are counted after a partial aggregate of each."""
    each = objects.groupBy(bucket).agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    return each.agg(F.count(bucket).alias("buckets"), F.coalesce(F.sum("n"), F.lit(0)).alias("objects"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))


def idle(objects: DataFrame, now: Column, seconds: int, modified: str = "mtime") -> DataFrame:
    """Objects at least so old; the comparison is on the bare column, so that it reaches the scan."""
    return objects.where(F.col(modified) <= now - F.make_dt_interval(secs=F.lit(seconds)))


def upsert(current: DataFrame, changes: DataFrame, on: list[str]) -> DataFrame:
    """current with the rows of changes in place of those with their keys."""
    return merged_planes(changes, current, on)
