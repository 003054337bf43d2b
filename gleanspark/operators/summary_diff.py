"""What changed between two summaries: numbers, texts and categories, matched by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timekey import decode


def diff_numbers(a: DataFrame, b: DataFrame) -> DataFrame:
    """``name``, ``count`` of b, and b - a of ``min max mean sum``; names of one side only are marked."""
    stats = ["min", "max", "mean", "sum"]
    left = a.select("name", F.struct("count", *stats).alias("a"))
    right = b.select("name", F.struct("count", *stats).alias("b"))
    both = left.join(right, "name", "full_outer")
    name = F.when(F.col("a").isNull(), F.concat(F.lit("[appeared] "), "name")).when(F.col("b").isNull(), F.concat(F.lit("[disappeared] "), "name")).otherwise(F.col("name"))
    return both.select(name.alias("name"), F.coalesce("b.count", "a.count").alias("count"), *((F.col(f"b.{s}") - F.col(f"a.{s}")).alias(s) for s in stats))


def diff_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Categories ``name``, ``count``: ``+name`` or ``-name`` with the change, unchanged ones left out, new and lost ones marked."""
    both = a.select("name", F.col("count").alias("a")).join(b.select("name", F.col("count").alias("b")), "name", "full_outer")
    change = F.col("b") - F.col("a")
    name = F.when(F.col("a").isNull(), F.concat(F.lit("[appeared] "), "name")).when(F.col("b").isNull(), F.concat(F.lit("[disappeared] "), "name")).otherwise(F.concat(F.when(change > 0, "+").otherwise("-"), "name"))
    return both.where("a IS NULL OR b IS NULL OR a <> b").select(name.alias("name"), F.coalesce(F.abs(change), "b", "a").alias("count"))


def diff_fields(a: DataFrame, b: DataFrame) -> DataFrame:
    """``name``, ``kind``, ``count``, ``min max mean sum``: what changed between two field tables of :func:`tabular.json_profile`.

    Numbers differ by each statistic. Bools give ``name.true_delta`` and
    ``name.false_delta``; timestamps ``name.unique_delta``, ``name.min_shift_s`` and
    ``name.max_shift_s``; texts ``name.unique_delta`` and ``name:value.count_delta`` for
    values in both tops, each with one number in all four statistics, and only
    where it changed (bools always). Values in one top only, names in one table
    only, and names of another kind are marked and have kind ``mixed``.
    """
    stats = ["min", "max", "mean", "sum"]
    both = a.select("name", F.struct(*(c for c in a.columns if c != "name")).alias("a")).join(b.select("name", F.struct(*(c for c in b.columns if c != "name")).alias("b")), "name", "full_outer")

    def out(name: Column, kind: str, count: Column, *values: Column) -> Column:
        held = values or [F.lit(None)] * 4
        return F.struct(name.alias("name"), F.lit(kind).alias("kind"), count.cast("long").alias("count"), *(v.cast("double").alias(s) for v, s in zip(held * 4 if len(held) == 1 else held, stats)))

    name, ca, cb = F.col("name"), F.col("a.count"), F.col("b.count")

    def change(suffix: str, value: Column, always: bool = False) -> Column:
        row = out(F.concat("name", F.lit(suffix)), "number", cb, value)
        return F.when(value.isNotNull() if always else value != 0, row)

    def moved(column: str) -> Column:
        return decode(F.substring(f"b.{column}", 1, 19), "iso8601") - decode(F.substring(f"a.{column}", 1, 19), "iso8601")

    unique = F.col("b.unique") - F.col("a.unique")
    top_a, top_b = (F.coalesce(F.col(f"{x}.top"), F.array().cast("array<struct<value:string,count:long>>")) for x in "ab")

    def of(top: Column, value: Column) -> Column:
        return F.get(F.filter(top, lambda t: t["value"] == value), F.lit(0))["count"]

    common = F.transform(F.filter(top_b, lambda t: (of(top_a, t["value"]) != t["count"])), lambda t: out(F.concat("name", F.lit(":"), t["value"], F.lit(".count_delta")), "number", cb, t["count"] - of(top_a, t["value"])))
    new = F.transform(F.filter(top_b, lambda t: of(top_a, t["value"]).isNull()), lambda t: out(F.concat(F.lit("[appeared in top] "), "name", F.lit(":"), t["value"]), "mixed", t["count"]))
    lost = F.transform(F.filter(top_a, lambda t: of(top_b, t["value"]).isNull()), lambda t: out(F.concat(F.lit("[disappeared from top] "), "name", F.lit(":"), t["value"]), "mixed", t["count"]))
    kind_a, kind_b = F.col("a.kind"), F.col("b.kind")
    rows = (
        F.when(F.col("a").isNull(), F.array(out(F.concat(F.lit("[appeared] "), name), "mixed", cb)))
        .when(F.col("b").isNull(), F.array(out(F.concat(F.lit("[disappeared] "), name), "mixed", ca)))
        .when((kind_a != kind_b) | (kind_b == "mixed"), F.array(out(F.concat(F.lit("[kind-changed] "), name), "mixed", cb)))
        .when(kind_b == "number", F.array(out(name, "number", cb, *(F.col(f"b.{s}") - F.col(f"a.{s}") for s in stats))))
        .when(kind_b == "bool", F.array(*(change(f".{x}_delta", F.col(f"b.{x}_count") - F.col(f"a.{x}_count"), always=True) for x in ("true", "false"))))
        .when(kind_b == "timestamp", F.array(change(".unique_delta", unique), change(".min_shift_s", moved("first")), change(".max_shift_s", moved("last"))))
        .otherwise(F.concat(F.array(change(".unique_delta", unique)), common, new, lost))
    )
    return both.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")
