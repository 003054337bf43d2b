"""Connected components of a link table, by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .common import fitted

#: Tasks that write a small table of links: rounds are many, and each file costs more than its rows.
LEAST = 3


def connected_components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(``id``, ``root``) for every id in ``links``: root is the smallest id that links lead to.

    Each round hangs larger neighbours on a row's smallest one, then smaller
    ones and itself on the smallest; both are an aggregation and a join, so a
    row with very many links is summed before the shuffle and split in the join.
    Links may repeat, point both ways or at themselves. Null ends are ignored.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    n = ends.count()

    def few(table: DataFrame) -> DataFrame:
        return fitted(table, n, least=LEAST)

    edges = stored(few(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), "edges")
    for _ in range(most_rounds):
        # Large stars: a row's larger neighbours point at its smallest neighbour or itself.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = few(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = stored(few(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()), "large")
        # Small stars: a row and its smaller neighbours point at the smallest of them.
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stored(few(hung.union(least.select("u", F.col("m").alias("v"))).distinct()), "small")
        discard(edges)
        discard(large)
        edges = small
        # Done when there are stars only: what hangs on a row hangs on no other, and nothing hangs on it.
        places = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if not few(places.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))).agg(F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    ids = ends.select(F.col("u").alias("id")).union(ends.select("v")).distinct()
    return ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
