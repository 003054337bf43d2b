"""Sharding by balanced label propagation: linked documents move to their neighbours' shards by even swaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .ranks import grouped_rank

#: Parts of groups that count as large, at most.
MOST_LARGE = 10_000
ROW = ["doc", "size", "text_crc32", "g"]


def cycle_in(wanted: np.ndarray) -> list[int] | None:
    """Shards that want to move rows around in a ring; None if there is no ring."""
    state, path = [0] * len(wanted), []

    def visit(a: int) -> list[int] | None:
        state[a] = 1
        path.append(a)
        for b in np.flatnonzero(wanted[a]).tolist():
            if state[b] == 1:
                return path[path.index(b) :]
            if not state[b] and (found := visit(b)):
                return found
        state[a] = 2
        path.pop()
        return None

    return next((found for a in range(len(wanted)) if not state[a] and (found := visit(a))), None)


def allowed_moves(wanted: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(moves, displaced) by (from, to): quotas that leave every shard's row count as it is.

    Moves against each other cancel, and so do rings of moves; for each other
    move into a shard one of its ``free`` rows, which nothing ties to it, is
    displaced to where the mover was.
    """
    moves = np.minimum(wanted, wanted.T)
    rest = wanted - moves
    while ring := cycle_in(rest):
        edges = (ring, [*ring[1:], ring[0]])
        most = rest[edges].min()
        rest[edges] -= most
        moves[edges] += most
    into = rest.sum(axis=0)
    scale = np.where(into > free, free / np.maximum(into, 1), 1.0)
    rest = np.floor(rest * scale + 1e-9).astype(np.int64)
    return moves + rest, rest


def shard_documents(docs: DataFrame, shards: int = 24, doc: str = "doc_id", text: str = "text", rounds: int = 30) -> DataFrame:
    """One row per row of ``docs``: ``doc``, ``size``, ``text_crc32``, ``shard``, ``slot``.

    Documents of equal text are linked. Row counts of shards are at most one
    apart: rows start dealt out evenly in hash order, and every round moves
    linked rows to the shard where most of their group is, under quotas that
    keep all counts. A group too large for a quarter of a shard counts as
    several, so that hot groups spread over shards. A shard that more rows want
    to enter than can has a price, which its votes must exceed, so that groups
    meet elsewhere. Rounds end when nothing wants to move, when three in a row
    could move nothing, or after ``rounds``. ``slot`` counts 0, 1, 2, ... within a shard.

    Size is the text's UTF-8 bytes plus 8. A null text counts as empty. Null or
    repeated ids are rows like others. An empty table gives an empty result.
    Other columns of ``docs`` are not returned.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(F.col(doc).alias("doc"), (F.octet_length(whole) + 8).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole).alias("g")), "rows")
    total = rows.count()
    chunk = max(2, total // (4 * shards))
    groups = stored(rows.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "groups")
    dealt = grouped_rank(rows.withColumn("_all", F.lit(0)), ["_all"], ROW, "_r", total).withColumn("shard", F.pmod("_r", F.lit(shards)).cast("int")).drop("_r", "_all")
    # u: the group, or a part of a large one; null where nothing is linked
    piece = F.pmod(F.xxhash64("doc", F.lit("piece")), F.ceil(F.col("m") / chunk))
    # Parts of groups with so many rows or more are few whatever the table's size, so what they want is broadcast.
    many = max(100, total // MOST_LARGE)
    state = stored(dealt.join(groups, "g", "left").withColumn("u", F.when(F.col("m").isNotNull(), F.xxhash64("g", piece))).drop("m"), "state")
    price, idle = np.zeros(shards), 0
    for _ in range(rounds):
        votes = state.where("u IS NOT NULL").groupBy("u", "shard").agg(F.count(F.lit(1)).alias("n"))
        favourite = stored(votes.groupBy("u").agg(F.sum("n").alias("rows"), F.max_by("shard", F.struct(F.col("n") - F.element_at(F.lit(price.tolist()), F.col("shard") + 1), F.xxhash64("u", "shard"))).alias("target")), "favourites")
        large = F.broadcast(favourite.where(F.col("rows") >= many).select("u", "target"))
        small = favourite.where(F.col("rows") < many).select("u", "target")
        linked = state.where("u IS NOT NULL")
        aimed = stored(
            linked.join(large, "u").unionByName(linked.join(large, "u", "left_anti").join(small, "u")).unionByName(state.where("u IS NULL").withColumn("target", F.lit(-1)))
            .withColumn("target", F.when(F.col("target") == F.col("shard"), F.lit(-2)).otherwise(F.col("target"))),
            "aimed",
        )
        # target: where a row wants to go; -1 if it is free, -2 if it stays
        counts = {(r["shard"], r["target"]): r["n"] for r in aimed.groupBy("shard", "target").agg(F.count(F.lit(1)).alias("n")).collect()}
        wanted, free = np.zeros((shards, shards), dtype=np.int64), np.zeros(shards, dtype=np.int64)
        for (a, b), n in counts.items():
            if b >= 0:
                wanted[a, b] = n
            elif b == -1:
                free[a] = n
        discard(favourite)
        moves, displaced = allowed_moves(wanted, free)
        unmet = (wanted - moves).sum(axis=0) > 0
        price = np.where(unmet, price + 0.6, price / 2)
        if not moves.any():
            discard(aimed)
            idle += 1
            if idle == 3 or not wanted.any():
                break
            continue
        idle = 0
        # (shard, target, lo, hi, to): rows of that rank go there; at most 2 * shards ** 2 rows
        quotas = [(a, b, 0, int(moves[a, b]), b) for a in range(shards) for b in range(shards) if moves[a, b]]
        for b in range(shards):
            lo = 0
            for a in range(shards):
                if n := int(displaced[a, b]):
                    quotas.append((b, -1, lo, lo + n, a))
                    lo += n
        table = spark.createDataFrame(quotas, "_a int, _t int, lo long, hi long, to int")
        ranked = grouped_rank(aimed, ["shard", "target"], ROW, "_r", total)
        fits = (F.col("shard") == F.col("_a")) & (F.col("target") == F.col("_t")) & (F.col("_r") >= F.col("lo")) & (F.col("_r") < F.col("hi"))
        moved = ranked.join(F.broadcast(table), fits, "left").withColumn("shard", F.coalesce("to", "shard")).select(*ROW, "shard", "u")
        before, state = state, stored(moved, "state")
        discard(before)
        discard(aimed)
    placed = grouped_rank(state, ["shard"], ROW, "slot", total)
    return placed.select(F.col("doc").alias(doc), "size", "text_crc32", "shard", "slot")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document of ``documents`` in one of 24 shards, row counts at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    placed = shard_documents(docs, 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
