"""Queues of documents by source, in a fixed random order, with the tokens that come before each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DOCS_A_BUCKET = 2_000


def queue_positions(items: DataFrame, key: str, size: str, order: list[str], buckets: int) -> DataFrame:
    """Adds ``before``: the sum of ``size`` over the items of the same key that come earlier.

    The order is that of a hash of ``order``. Sums are taken per bucket of the
    hash and then over buckets, so no task ever holds a whole queue: a bucket
    has a bounded expected size, and only one row per bucket is summed up.
    """
    mixed = F.xxhash64(*order)
    placed = items.withColumn("_h", mixed).withColumn("_b", F.floor((F.col("_h").cast("double") / float(1 << 63) + 1) / 2 * buckets).cast("int"))
    sums = placed.groupBy(key, "_b").agg(F.sum(size).alias("_s"))
    over = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(key).alias("_key"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_start"))
    within = Window.partitionBy(key, "_b").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_in", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return (
        summed.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_bb")))
        .withColumn("before", F.col("_start") + F.col("_in"))
        .drop("_h", "_b", "_bb", "_key", "_start", "_in")
    )


def bucket_count(rows: int) -> int:
    return max(1, -(-rows // DOCS_A_BUCKET))
