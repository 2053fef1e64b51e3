"""Ranks that never need one task to hold a whole table or a whole hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.runtime import checkpointed

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def dense_index(df: DataFrame, order: list[Column], out: str, start: int = 0) -> DataFrame:
    """Number all rows of ``df`` along ``order`` without a single-task sort.

    Rows are range-partitioned and numbered inside each partition; the numbering is
    checkpointed, because a second range shuffle may choose other bounds, and the offset
    table added afterwards has one row per partition.
    """
    local = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    local = checkpointed(local).withColumn("_part", F.shiftright("_row", _ROW_BITS))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        local.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    position = F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + start
    return (
        local.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(out, position)
        .drop("_part", "_row", "_before")
    )


def rank_within(
    df: DataFrame, key: str, order: list[Column], bucket: Column,
    rank: str = "rank", size: str = "group_size",
) -> DataFrame:
    """1-based rank inside each ``key`` group, plus the group size.

    ``bucket`` must grow with ``order``. The window sorts one (key, bucket) slice at a
    time, and the slices are chained through their row counts, so a key that holds a large
    share of the table is ranked by many tasks.
    """
    sliced = df.withColumn("_bucket", bucket)
    counts = sliced.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    per_key = W.partitionBy(key)
    before = per_key.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    chained = counts.select(
        F.col(key), F.col("_bucket"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(per_key).alias(size),
    )
    local = F.row_number().over(W.partitionBy(key, "_bucket").orderBy(*order))
    return (
        sliced.withColumn("_local", local)
        .join(chained, [key, "_bucket"])
        .withColumn(rank, F.col("_before") + F.col("_local"))
        .drop("_bucket", "_before", "_local")
    )


def running_total(df: DataFrame, index: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """Sum of ``value`` over all rows before this one, for a dense integer ``index``.

    Slices of ``width`` indexes are summed first; a slice offset is then the running sum
    over the slice table, itself ``width`` times smaller, so the unpartitioned window only
    sees ``rows / width²`` offsets after a second level of slices.
    """
    level1 = df.withColumn("_s1", F.floor(F.col(index) / width)).withColumn(
        "_s2", F.floor(F.col(index) / (width * width)))
    sums1 = level1.groupBy("_s2", "_s1").agg(F.sum(value).alias("_t"))
    sums2 = sums1.groupBy("_s2").agg(F.sum("_t").alias("_t2"))
    off2 = sums2.select("_s2", _before(F.sum("_t2"), W.orderBy("_s2")).alias("_o2"))
    off1 = sums1.select(
        "_s2", "_s1", _before(F.sum("_t"), W.partitionBy("_s2").orderBy("_s1")).alias("_o1"))
    inner = _before(F.sum(value), W.partitionBy("_s1").orderBy(index))
    return (
        level1.withColumn("_o0", inner)
        .join(off1.join(off2, "_s2").drop("_s2"), "_s1")
        .withColumn(out, F.col("_o0") + F.col("_o1") + F.col("_o2"))
        .drop("_s1", "_s2", "_o0", "_o1", "_o2")
    )


def _before(total: Column, window) -> Column:
    return F.coalesce(total.over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def top_n_per_key(df: DataFrame, key: str, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group; Spark prunes to ``n`` per task before the shuffle."""
    return (
        df.withColumn(rank, F.row_number().over(W.partitionBy(key).orderBy(*order)))
        .where(F.col(rank) <= n)
    )
