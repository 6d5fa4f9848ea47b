"""Folders for objects that a query makes itself, where the driver and all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir; in a temporary folder only for local mode, where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="quarry-objects-")
    return f"{at}/object-{uuid.uuid4().hex}"


def put_text(lines: DataFrame, order: str, head: str | None = None, compression: str = "none", end: str = "\n", parts: bool = False) -> str:
    """Writes (value) in the order of a column of `lines` as one object, a first line before it if any; its path.

    With parts it is as many files as the sort has partitions, in the order of their names, each with whole values.
    """
    spark = lines.sparkSession
    own = lines.select(F.lit(1).alias("k"), F.col(order).alias("o"), "value")
    if head is not None:
        first = spark.range(1).select(F.lit(0).alias("k"), F.lit(None).cast(own.schema["o"].dataType).alias("o"), F.lit(head).alias("value"))
        own = first.union(own)
    at = folder(spark)
    own = own.orderBy("k", "o") if parts else own.repartition(1).sortWithinPartitions("k", "o")
    own.select("value").write.option("compression", compression).option("lineSep", end).text(at)
    return at
