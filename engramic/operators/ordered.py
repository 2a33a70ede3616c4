"""Running values along long sequences, in blocks, so that no sequence is gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a block; a sequence costs one task a row for each block, beside its blocks.
BLOCK = 4096


def running_sum(rows: DataFrame, key: str, at: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row, by ``at`` (a whole number, unique in its key).

    Windows run inside blocks of places; the sums of the blocks before come from a window over blocks.
    """
    dealt = rows.withColumn("_block", F.floor(F.col(at) / BLOCK)).withColumn("_value", value)
    inside = Window.partitionBy(key, "_block").orderBy(at)
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy(key, "_block").agg(F.sum("_value").alias("_all"))
    blocks = blocks.select(key, "_block", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    return dealt.join(blocks, [key, "_block"]).withColumn(name, F.col("_before") + F.sum("_value").over(inside)).drop("_block", "_value", "_before")


def last_before(rows: DataFrame, key: str, at: str, marked: Column, name: str) -> DataFrame:
    """``rows`` with the greatest ``at`` of a marked row before each row, or null."""
    dealt = rows.withColumn("_block", F.floor(F.col(at) / BLOCK)).withColumn("_mark", F.when(marked, F.col(at)))
    inside = Window.partitionBy(key, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy(key, "_block").agg(F.max("_mark").alias("_last"))
    blocks = blocks.select(key, "_block", F.max("_last").over(earlier).alias("_before"))
    return dealt.join(blocks, [key, "_block"]).withColumn(name, F.coalesce(F.max("_mark").over(inside), "_before")).drop("_block", "_mark", "_before")
