"""Contiguous shards of balanced bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty


def shard_by_bytes(docs: DataFrame, *, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the rows, in the order of their ids, into ``shards`` contiguous runs of nearly equal bytes.

    A row's size is the UTF-8 length of its text plus 1.  Only (id, size, crc) is sorted, by range partitioning; each
    range's total is summed, the totals' prefix sums (one row per range) are broadcast, and each row adds its running
    sum within its range.  A row belongs to the shard in which the middle of its bytes lies, so each cut is off its
    target by at most half a row.

    Returns ``id_col``, size, text_crc32 (unsigned), law ('bytes'), shard, slot (gapless from 0 in each shard, in order),
    grown_shard (null: the law is not by key).

    Null text has no bytes (size 1, CRC of the empty text).  Null ids come first; rows with equal ids are ordered by
    where they were read, and may be cut apart.  Other columns are ignored; an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession)
    text = text_or_empty(F.col(text_col))
    light = work.save(
        docs.select(
            F.col(id_col).cast("bigint").alias("id"),
            F.monotonically_increasing_id().alias("row"),
            (F.octet_length(text).cast("bigint") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "light",
    )
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = light.repartitionByRange(ranges, "id", "row").sortWithinPartitions("id", "row")
    ranged = work.save(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("all_bytes"),
    )
    within = Window.partitionBy("part").orderBy("id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(F.broadcast(totals), "part").select(
        "id",
        "size",
        "text_crc32",
        "all_bytes",
        (F.col("bytes_before") + F.sum("size").over(within)).alias("end"),
        (F.col("rows_before") + F.count(F.lit(1)).over(within) - 1).alias("index"),
    )
    shard = F.least(F.lit(shards - 1), F.expr(f"(end * 2 - size) * {shards}L div (all_bytes * 2)").cast("int"))
    placed = work.save(placed.withColumn("shard", shard), "placed")
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("index").alias("first")))  # one row per shard
    return placed.join(firsts, "shard").select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("index") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
