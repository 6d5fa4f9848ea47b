"""Session helpers that the operators share: shared-folder tables, partition counts, components."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside the operators; no real id may have this value.
NULL_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only for local mode, where it is unset."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="quarry-")
    sc.setCheckpointDir(at)
    return sc._jsc.sc().getCheckpointDir().get()


#: Tables that cut() wrote: path -> weak reference to the JVM's file index, which each plan over the table holds.
_written: dict = {}
#: Writes that took so many seconds are followed by a collection of the driver's garbage, which takes less.
_COLLECT_S = 1.0
_collected = 0.0


def release(spark: SparkSession, collect: bool = True) -> None:
    """Delete the tables of cut() that no frame's plan reads any longer. The collection that tells this lets
    Spark's own cleaner drop the shuffle files of finished steps, too."""
    jvm = spark.sparkContext._jvm
    if collect:
        jvm.System.gc()
    for at, (owner, index) in list(_written.items()):
        if owner is not spark.sparkContext:  # its JVM's folder is no longer ours
            del _written[at]
        elif index.get() is None:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            del _written[at]


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors.

    The table is deleted by a later call once nothing reads it.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}"
    global _collected
    began = time.monotonic()
    if began - _collected >= 5 * _COLLECT_S:  # what ended before this operator began
        release(spark)
        _collected = time.monotonic()
    df.write.option("compression", "zstd").parquet(at)
    release(spark, time.monotonic() - began >= _COLLECT_S)
    out = spark.read.schema(df.schema).parquet(at)
    index = out._jdf.queryExecution().analyzed().relation().location()
    _written[at] = (spark.sparkContext, spark.sparkContext._jvm.java.lang.ref.WeakReference(index))
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (null: NULL_ID) and the text, whatever other columns there are."""
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("id"), docs[text_col].cast("string").alias("text")
    )


def real_id(col) -> "F.Column":
    """NULL_ID back to null."""
    return F.when(col != NULL_ID, col)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in the edges (a, b); component is the smallest id reachable.

    Alternating large-star and small-star steps on a distributed edge table, each step written to the
    shared folder; O(log^2 n) rounds. A hub's rows are joined to one row of minima, so an adaptive skew
    join can split them. Self-loops and repeated edges are allowed; an empty table gives an empty result.
    """
    e = edges.where("a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct()
    e = cut(e)
    before = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or mark[0] == 0:
            break
        before = tuple(mark)
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.join(low, "u").where("v > u").selectExpr("v u", "m v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("v u", "m v").union(low).where("u <> v")
        e = cut(small.distinct())
    return e.selectExpr("u id", "v component").union(e.selectExpr("v id", "v component").distinct())
