"""Importance resampling towards a target's distribution, drawn exactly by a histogram of integer scores.

Features are hashed into buckets. A document's weight is the floored mean of its
buckets' gains, looked up in one array; a Gumbel number from a hash of its id is
added. Scores are integers, so a histogram of them, summed up from the highest,
tells every score's first rank and the score at which the draw is full; only rows
of that score or above are put in order, within each score by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import discard, stored
from .common import by_bytes, small_batches, utf8

#: What stays of a byte: a-z, 0-9 and all beyond ASCII; A-Z as a-z, the others as blanks.
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Columns that the operator makes; extra ones of these names are not carried.
MADE = ("n_words", "buckets")


def feature_buckets(text: bytes, longest: int, buckets: int, most: int = 1 << 20) -> tuple[int, np.ndarray]:
    """(words, buckets of all runs of 1 to ``longest`` words) of a text's UTF-8 bytes, in stretches of about ``most`` bytes."""
    words, out, before = 0, [], []
    at = 0
    text = text.translate(KEPT)
    while at < len(text):
        stop = text.find(b" ", at + most)
        stop = len(text) if stop < 0 else stop
        new = text[at:stop].split()
        at = stop + 1
        words += len(new)
        every = before + new
        fresh = len(before)  # runs that end before here were counted with the stretch before
        sums = np.fromiter(map(crc32, every), dtype=np.uint32, count=len(every))
        out.append(sums[fresh:] % buckets)
        behind = [b" " + w for w in every]
        for n in range(2, longest + 1):
            sums = np.fromiter(map(crc32, behind[n - 1 :], sums[:-1].tolist()), dtype=np.uint32, count=max(0, len(every) - n + 1))
            out.append(sums[max(0, fresh - n + 1) :] % buckets)
        before = every[len(every) - longest + 1 :] if longest > 1 else []
    return words, np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def with_buckets(docs: DataFrame, text: str, key: str | None, longest: int, buckets: int) -> DataFrame:
    """(``key``, ``n_words``, ``n_features``, ``buckets``): the buckets as little-endian unsigned 32-bit integers."""
    key_type = docs.schema[key].dataType if key else None
    schema = pa.schema([*([(key, to_arrow_type(key_type))] if key else []), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "t", 2 << 20):
            found = [feature_buckets(t, longest, buckets) for t in utf8(batch.column("t"))]
            columns = [batch.column("k").cast(schema.field(0).type)] if key else []
            columns += [pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()), pa.array([b.astype("<u4").tobytes() for _, b in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    own = [F.col(f"`{text}`").alias("t"), *([F.col(f"`{key}`").alias("k")] if key else [])]
    return docs.select(own).mapInArrow(run, (f"`{key}` {key_type.simpleString()}, " if key else "") + "n_words long, n_features long, buckets binary")


def bucket_counts(hashed: DataFrame, buckets: int) -> list[int]:
    """How often each bucket occurs. Every task counts its own; the result has ``buckets`` numbers, whatever the table's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column("buckets"):
                counts += np.bincount(np.frombuffer(value.as_buffer(), dtype="<u4"), minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(counts[met], pa.int64())], ["b", "n"])

    out = [0] * buckets
    for row in hashed.select("buckets").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[row["b"]] = row["n"]
    return out


def gains_of(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln of the target's share over the source's) of each bucket, both smoothed by one."""
    n, s_all, t_all = len(source), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source, target)]


def weighed(hashed: DataFrame, key: str, gains: list[int]) -> DataFrame:
    """(``key``, ``n_words``, ``n_features``, ``weight``): the floored mean of the gains, 0 without features."""
    key_type = hashed.schema[key].dataType
    schema = pa.schema([(key, to_arrow_type(key_type)), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
    table = np.array(gains, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(v.as_buffer(), dtype="<u4") for v in batch.column("buckets")]
            weights = [int(table[b].sum()) // len(b) if len(b) else 0 for b in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), batch.column(1), batch.column(2), pa.array(weights, pa.int64())], schema=schema)

    return hashed.select(key, "n_words", "n_features", "buckets").mapInArrow(run, f"`{key}` {key_type.simpleString()}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, longest: int = 2, buckets: int = 10_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ``n_features``, ``weight``, ``score``, ``rank``) of every row of ``docs``.

    ``percent`` of the rows with ``least_words`` words or more are drawn without
    replacement, as if each had a chance in proportion to exp(weight / 1000); the
    drawn have a rank 1, 2, 3, ... by falling score, ties by ``key``; the others null.
    Weights are counted over all rows of both tables.

    A null text has no words and weighs 0, like an empty one. A null key takes part in
    the draw like one with the name ``null`` and comes first among equals. Rows of
    one key and text have one score and follow one another in rank; which of them is
    first is told by their number of features, else they are alike. With an empty
    ``docs`` the result is empty; with an empty target all its shares are even.
    Other columns are not returned. Scores are integers in a range that follows from
    the smoothing (under 100,000 values for any table that Spark can count), so
    that their histogram is small whatever the table's size; equal rows are numbered
    together by their count, so that no group of copies is put in order row by row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    hashed = stored(with_buckets(docs, text, key, longest, buckets), "buckets")
    gains = gains_of(bucket_counts(hashed, buckets), bucket_counts(with_buckets(target, text, None, longest, buckets), buckets))
    unit = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    gumbel = F.floor(-1000 * F.log(-F.log(unit))).cast("long")
    scored = stored(weighed(hashed, key, gains).withColumn("score", F.col("weight") + gumbel), "scores")
    discard(hashed)

    may = F.col("n_words") >= least_words
    histogram = sorted(((r["score"], r["n"]) for r in scored.where(may).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    drawn = percent * sum(n for _, n in histogram) // 100
    first, offsets = 0, []
    for score, n in histogram:
        if first >= drawn:
            break
        offsets.append((score, first))
        first += n
    if not offsets:
        return scored.select(key, "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))

    in_draw = F.coalesce(may & (F.col("score") >= offsets[-1][0]), F.lit(False))
    same = [key, "n_features", "weight", "score"]
    groups = scored.where(in_draw).groupBy(*same).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("score").orderBy(key, "n_features").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = F.broadcast(spark.createDataFrame(offsets, "score long, _first long"))
    placed = groups.withColumn("_to", before).join(starts, "score").withColumn("_to", F.col("_to") + F.col("_first"))
    # Copies are told apart by their number, a stretch of ranks at a time.
    width = 10_000
    stretches = placed.withColumn("_from", F.explode(F.sequence(F.col("_to") - F.col("_n") + 1, F.col("_to"), F.lit(width))))
    ranked = stretches.withColumn("rank", F.explode(F.sequence("_from", F.least(F.col("_from") + width - 1, F.col("_to"))))).select(*same, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    others = scored.where(~in_draw).select(*same, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(others).select(key, "n_features", "weight", "score", "rank")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: a quarter of the documents drawn towards the benchmark's distribution."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, target)


#: CRC-32 bit by bit: eight shifts make the table of bytes, and a fold over the bytes uses it.
SQL = r"""
WITH table_of AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
listed AS (SELECT side, row_number() OVER () AS n, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (SELECT side, n, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM listed),
coded AS (SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: CAST(('0x' || substr(hex(encode(f)), 2 * i + 1, 2)) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT f FROM features), table_of),
placed AS (SELECT side, n, b FROM features JOIN coded USING (f)),
sums AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM placed GROUP BY b),
totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums),
gains AS (SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS g FROM sums, totals),
weights AS (SELECT n, count(*) AS n_features, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM placed JOIN gains USING (b) WHERE side = 0 GROUP BY n),
scored AS (SELECT l.n, id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM listed l LEFT JOIN weights USING (n) WHERE side = 0),
ranked AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS every FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * every // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (n)
"""
