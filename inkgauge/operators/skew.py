"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with over 1/HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such keys, however large the input.
HOT_SHARE = 2_000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner-join ``rows`` with ``table`` (one narrow row per key; ``weight`` = rows of that key), whatever the skew.

    Keys with more than ``total / HOT_SHARE`` rows number fewer than HOT_SHARE: only those are broadcast.  The others
    meet by an ordinary shuffle, where no key is large.
    """
    hot = F.col(weight) * HOT_SHARE > F.lit(total)
    few = F.broadcast(table.filter(hot).select(*keys, F.lit(True).alias("__hot")))
    marked = rows.join(few, keys, "left")
    held = marked.filter(F.col("__hot")).drop("__hot").join(F.broadcast(table.filter(hot)), keys)
    rest = marked.filter(F.col("__hot").isNull()).drop("__hot").join(table.filter(~hot), keys)
    return held.unionByName(rest)


def split_join(rows: DataFrame, table: DataFrame, key: str, by: str, total: int, keys: DataFrame | None = None) -> DataFrame:
    """Inner-join ``rows`` with ``table`` (one row per ``key``, of any width) by a shuffle in which no key is large.

    A hot key's rows are dealt to as many parts as it takes to bring each below ``total / HOT_SHARE`` rows, by a hash of
    ``by``; its row of ``table`` goes to each part.  What is broadcast are the numbers of parts of fewer than HOT_SHARE keys.
    ``keys`` has the same keys as ``rows``, as often, and is counted in their place where it is cheaper to read.
    """
    counts = (rows if keys is None else keys).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") * HOT_SHARE > F.lit(total))
    parts = F.broadcast(counts.select(key, F.ceil(F.col("__n") * HOT_SHARE / F.lit(float(max(total, 1)))).cast("int").alias("__parts")))
    dealt = rows.join(parts, key, "left").withColumn("__part", F.pmod(F.xxhash64(by), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    copies = table.join(parts, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copies, [key, "__part"]).drop("__part")
