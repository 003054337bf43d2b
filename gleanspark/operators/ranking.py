"""Exact values of given ranks, without a sort and without all values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that a pass divides an interval into.
RANGES = 4096


def values_of_ranks(table: DataFrame, column: str, ranks: list[int], weight: str | None = None) -> list[int]:
    """The whole numbers of ``column`` that have these ranks, from 0, in ascending order; ``weight`` counts a row several times.

    Each pass counts the rows of ``RANGES`` ranges of an interval and keeps the
    one that holds the rank: three passes for values that differ by up to 6e10.
    """
    bounds = table.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    found = {k: (int(bounds["low"]), int(bounds["high"]), k) for k in ranks}
    n = F.sum(weight) if weight else F.count(F.lit(1))
    while any(low < high for low, high, _ in found.values()):
        cases = [(k, low, (high - low) // RANGES + 1, high) for k, (low, high, _) in found.items() if low < high]
        rows = F.array(*(F.when(F.col(column).between(low, high), F.struct(F.lit(k).alias("k"), F.floor((F.col(column) - low) / width).cast("long").alias("p"))) for k, low, width, high in cases))
        at = [F.col(weight)] if weight else []
        counted = table.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r"), *at).groupBy("r.k", "r.p").agg(n.alias("n")).collect()
        for k, low, width, high in cases:
            left = found[k][2]
            for r in sorted((r for r in counted if r["k"] == k), key=lambda r: r["p"]):
                if left < r["n"]:
                    found[k] = (low + r["p"] * width, min(high, low + (r["p"] + 1) * width - 1), left)
                    break
                left -= r["n"]
    return [found[k][0] for k in ranks]
