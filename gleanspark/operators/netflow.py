"""Flow triage over (src, dst, bytes, proto) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .ranking import values_of_ranks

# Fixed values of the two anomaly rules.
SCAN_LEAST, SCAN_RATIO, EXFIL_RATIO, TOP = 20, 5, 10, 5


def totals(flows: DataFrame) -> DataFrame:
    return flows.agg(F.count(F.lit(1)).alias("packets"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("proto") == 6).alias("tcp"), F.count_if(F.col("proto") == 17).alias("udp"), F.count_distinct("src", "dst").alias("pairs"))


def pair_bytes(flows: DataFrame) -> DataFrame:
    return flows.groupBy("src", "dst").agg(F.sum("bytes").alias("metric"))


def fan_out(pairs: DataFrame) -> DataFrame:
    """Distinct destinations of each source, from distinct pairs."""
    return pairs.groupBy("src").agg(F.count(F.lit(1)).alias("metric"))


def fan_in(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("dst").agg(F.count(F.lit(1)).alias("metric"))


def top(ranked: DataFrame, keys: list[str], k: int = TOP) -> DataFrame:
    return ranked.orderBy(F.desc("metric"), *keys).limit(k)


def baseline_without_top(ranked: DataFrame) -> DataFrame:
    """One row: the upper median of the metric without one largest value; 0 for one value or none.

    Equal values are counted once and the counts stored, so that what ``ranked`` stands for is worked out once.
    """
    counts = stored(ranked.groupBy("metric").agg(F.count(F.lit(1)).alias("n")), "metrics")
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = values_of_ranks(counts, "metric", [(n - 1) // 2], "n")[0] if n > 1 else 0
    discard(counts)
    return ranked.sparkSession.createDataFrame([(found,)], "baseline long")


def anomalies(pairs: DataFrame) -> DataFrame:
    """``kind``, ``name``, ``metric``, ``baseline``, ``ratio``: a scanning source, an exfiltrating pair."""
    out = fan_out(pairs)
    scan = top(out, ["src"], 1).crossJoin(F.broadcast(baseline_without_top(out))).withColumn("ratio", F.col("metric") / F.greatest("baseline", F.lit(1))).where((F.col("metric") >= SCAN_LEAST) & (F.col("ratio") >= SCAN_RATIO))
    talk = top(pairs, ["src", "dst"], 1).crossJoin(F.broadcast(baseline_without_top(pairs))).withColumn("ratio", F.col("metric") / F.greatest("baseline", F.lit(1))).where(F.col("ratio") >= EXFIL_RATIO)
    cols = [F.col("metric").cast("double"), F.col("baseline").cast("double"), "ratio"]
    return scan.select(F.lit("scan").alias("kind"), F.col("src").cast("string").alias("name"), *cols).unionByName(talk.select(F.lit("exfil").alias("kind"), F.concat_ws(" -> ", "src", "dst").alias("name"), *cols))
