"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

#: The characters that separate words everywhere in this subpackage: blank, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Hand whole texts to Python in Arrow batches of about ``most`` bytes at most; a lower setting of the session stays."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES)) > most:
        spark.conf.set(BATCH_BYTES, most)


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(column, UPPER, LOWER)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` has about ``most`` bytes in each, and one row at least."""
    for batch in batches:
        lengths = batch.column(column).cast(pa.large_binary())
        start, held = 0, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(lengths), 0).to_pylist()
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


#: Rows that a task of a small table takes at least; tables are written by so few tasks, but by 8 at least.
ROWS_A_TASK = 100_000


def fitted(table: DataFrame, rows: int, each: int = ROWS_A_TASK, least: int = 8) -> DataFrame:
    """``table`` of about ``rows`` rows in as many partitions as they are worth and ``least``, if it has more."""
    return table.coalesce(max(least, rows // each))


def may_hold(table: DataFrame, key: Column, ids: DataFrame, name: str, most_bits: int = 1 << 26) -> DataFrame:
    """``table`` with ``name``: whether ``key`` may be among ``ids`` (column ``d``), by a bitmap of their hashes.

    The bitmap is at most ``most_bits`` (8 MB) whatever the number of ids, so that
    it is broadcast; with too many of them it lets more pass, and loses none.
    """
    bits = 1 << 15
    n = ids.count()
    while bits < 64 * n and bits < most_bits:
        bits *= 2

    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column.cast("long")), F.lit(bits)) + 1

    pages = ids.select(place(F.col("d")).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("_page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("_bits"))
    pages = stored(pages.coalesce(8), "bitmap")
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("bitmap._bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))
    met = table.alias("held").join(F.broadcast(pages.alias("bitmap")), F.bitmap_bucket_number(place(key)) == F.col("bitmap._page"), "left")
    return met.select("held.*", held.alias(name))
