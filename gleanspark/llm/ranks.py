"""Gapless ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grouped_rank(rows: DataFrame, keys: list[str], order: list[str], name: str, total: int) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... without gaps within each group of ``keys``.

    Groups are salted into hash buckets of ``order`` (columns that tell rows
    apart): ranks follow the bucket, then the order. ``total`` is the number of
    rows; from it follows the number of buckets. Only the buckets' counts are
    summed up in order.
    """
    buckets = max(1, min(8192, total // 1000))
    salted = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1
    return salted.withColumn("_w", within).join(offsets, [*keys, "_b"]).withColumn(name, (F.col("_w") + F.col("_before")).cast("long")).drop("_b", "_w", "_before")
