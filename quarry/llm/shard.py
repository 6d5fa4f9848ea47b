"""K-d tree sharding in DataFrame operations only.

All leaves hold near-equal bytes: a node that stands for k shards is cut at the weighted quantile
floor(k / 2) / k of its widest metadata dimension (extent over the extent of the whole table), all nodes of a
level at once. The quantile is exact: rows are range-partitioned by (node, value, crc, id), each range adds
up its bytes, and running sums start from the sums of the ranges before. No task gets a whole node. Nodes are rows of
a table, too; the driver gets one row, the bytes and extents of the whole. The texts are read once, for their sizes.

Rows with equal coordinates are in the order of their texts' crc and id, so copies stay together unless
a cut falls between them; a group larger than a shard must be cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm._spark import NULL_ID, cut, partitions, real_id

SHARDS, OVERHEAD = 24, 8
#: Nodes of a level, of 24 bytes each, up to which their table is broadcast; larger levels are joined.
BROADCAST_NODES = 100_000
DIMENSIONS = ("n_chars", "lang", "source")


def _ranges(t: DataFrame, parts: int, keys: list[str]) -> DataFrame:
    """t range-partitioned by keys and written, with the range of each row as pid."""
    return cut(t.repartitionByRange(parts, *keys).withColumn("pid", F.spark_partition_id()))


def _ahead(ranged: DataFrame, group: str, value) -> DataFrame:
    """(group, pid, ahead): sum of value over the group's earlier ranges; a row for each range and group in it."""
    before = Window.partitionBy(group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(group, "pid").agg(value.alias("s"))
    return sums.select(group, "pid", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("ahead"))


def _numbers(t: DataFrame, parts: int, name: str) -> DataFrame:
    """t with a number in the order of the column in its place; of strings the rank among the distinct ones; null: -1."""
    if t.schema[name].dataType.typeName() != "string":
        return t.withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(-1.0)))
    values = _ranges(t.where(F.col(name).isNotNull()).select(name, F.lit(0).alias("all")).distinct(), parts, [name])
    own = F.row_number().over(Window.partitionBy("pid").orderBy(name)) - 1
    ranks = values.withColumn("r", own).join(_ahead(values, "all", F.count("*")), ["all", "pid"])
    ranks = ranks.select(name, (F.col("r") + F.col("ahead")).cast("double").alias("rank"))
    return t.join(ranks, name, "left").withColumn(name, F.coalesce("rank", F.lit(-1.0))).drop("rank")


def kd_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dimensions: tuple[str, ...] = DIMENSIONS,
    shards: int | None = None,
    target_bytes: int | None = None,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards 0 to shards - 1 of near-equal bytes, slots gapless from 0.

    size is the text's UTF-8 bytes (null: none) plus 8. Either shards or target_bytes is given; with the latter nodes
    are split until the mean of the leaves is at most that. Dimensions that docs lacks don't count; strings count by their rank
    among the distinct ones; null values come first; a
    null id comes last and stays null. Ties are cut by the crc of the text, then the id; repeated rows are rows of
    their own. With fewer rows than shards some shards are empty; an empty table gives none.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    spark = docs.sparkSession
    parts = partitions(spark)
    names = [d for d in dimensions if d in docs.columns]
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    t = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        *(docs[d].alias(f"d{k}") for k, d in enumerate(names)),
        F.monotonically_increasing_id().alias("u"),  # tells equal rows apart
        F.lit(0).cast("long").alias("node"),
    )
    t = cut(t)
    dims = [f"d{k}" for k in range(len(names))]
    if dims:
        t = cut(reduce(lambda u, d: _numbers(u, parts, d), dims, t))
    bounds = t.agg(F.sum("size").alias("bytes"), *(F.min(d).alias(f"{d}_lo") for d in dims), *(F.max(d).alias(f"{d}_hi") for d in dims)).first()
    k = shards if shards is not None else max(1, -(-(bounds["bytes"] or 0) // target_bytes))
    nodes = spark.range(1).select(F.lit(0).cast("long").alias("node"), F.lit(k).cast("long").alias("k"), F.lit(0).cast("long").alias("first"))

    def near(table: DataFrame, level: int) -> DataFrame:
        return F.broadcast(table) if min(k, 2**level) <= BROADCAST_NODES else table

    for level in range((k - 1).bit_length() if bounds["bytes"] else 0):
        extents = [f"struct((max({d}) - min({d})) / {float(bounds[f'{d}_hi'] - bounds[f'{d}_lo']) or 1.0}D as extent, {-n} as minus)" for n, d in enumerate(dims)]
        widest = f"-array_max(array({', '.join(extents)})).minus" if dims else "0"
        stats = t.groupBy("node").agg(F.sum("size").alias("bytes"), F.expr(widest).alias("widest")).join(near(nodes, level), "node")
        # a node of one shard, or without rows, is not split
        plan = cut(stats.selectExpr("node", "widest", "if(k = 1, 9e18D, bytes * (k div 2) / k) goal"))
        key = F.expr(f"element_at(array({', '.join(dims)}), widest + 1)" if dims else "0D")
        ranged = _ranges(t.join(near(plan, level), "node").withColumn("key", key), parts, ["node", "key", "crc", "id", "u"])
        own = Window.partitionBy("node", "pid").orderBy("key", "crc", "id", "u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = ranged.withColumn("run", F.sum("size").over(own)).join(_ahead(ranged, "node", F.sum("size")), ["node", "pid"])
        right = F.expr("if(run + ahead - size / 2 > goal, 1L, 0L)")
        t = cut(running.withColumn("node", 2 * F.col("node") + right).select("id", "size", "crc", "u", *dims, "node"))
        halves = "array(struct(2 * node as node, k div 2 as k, first as first), struct(2 * node + 1 as node, k - k div 2 as k, first + k div 2 as first))"
        nodes = nodes.selectExpr(f"inline(if(k = 1, array(struct(2 * node as node, k as k, first as first)), {halves}))")
    placed = t.join(near(nodes, (k - 1).bit_length()), "node").select("id", "size", "crc", "u", F.col("first").cast("int").alias("shard")) if bounds["bytes"] else t.select("id", "size", "crc", "u", F.lit(0).alias("shard"))
    ranged = _ranges(placed, parts, ["shard", "crc", "id", "u"])
    own = Window.partitionBy("shard", "pid").orderBy("crc", "id", "u")
    placed = ranged.withColumn("r", F.row_number().over(own) - 1).join(_ahead(ranged, "shard", F.count("*")), ["shard", "pid"])
    return placed.select(
        real_id(F.col("id")).alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("r") + F.col("ahead")).cast("long").alias("slot")
    )

