"""Readers: text lines with numbers, packet captures, SQL dumps, Parquet column statistics and footers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dumps import dump_dialect, dump_dialects, dump_statements, read_dumps  # noqa: F401


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of each line; only LF ends a line."""
    return spark.read.text(path, lineSep="\n")


def parquet_statistics(table: DataFrame) -> DataFrame:
    """``name``, ``count`` (nulls too), ``null_count``, ``min``, ``max`` as text, for each column, in one pass."""
    stats = [F.struct(F.lit(c).alias("name"), F.count(F.lit(1)).alias("count"), F.count_if(F.col(c).isNull()).alias("null_count"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max")) for c, t in table.dtypes if not t.startswith(("array", "map", "struct"))]
    return table.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def open_input(uri: str):
    """A seekable input file of pyarrow, for a path of Spark's with or without a scheme."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
    return system.open_input_file(path)


def read_footers(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``row_group``, ``name``, ``count``, ``null_count``, ``min``, ``max`` (as texts) of Parquet files, from their footers alone.

    A column without statistics in a group has nulls. Files are read in parallel, no data page is.
    """
    files = spark.read.format("binaryFile").load(path).select("path")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for part in parts:
            for name in part["path"]:
                with open_input(name) as f:
                    meta = pq.ParquetFile(f).metadata
                    rows = []
                    for g in range(meta.num_row_groups):
                        for c in range(meta.num_columns):
                            column = meta.row_group(g).column(c)
                            known = column.statistics if column.is_stats_set else None
                            limits = (str(known.min), str(known.max)) if known is not None and known.has_min_max else (None, None)
                            rows.append((name, g, column.path_in_schema, column.num_values, known.null_count if known is not None and known.has_null_count else None, *limits))
                yield pd.DataFrame(rows, columns=["path", "row_group", "name", "count", "null_count", "min", "max"]).astype({"null_count": "Int64"})

    return files.mapInPandas(run, "path string, row_group int, name string, count long, null_count long, min string, max string")


def footer_statistics(footers: DataFrame, numeric: bool = True) -> DataFrame:
    """``name``, ``count``, ``null_count``, ``min``, ``max`` of each column over all row groups; limits as numbers, or as texts."""

    def limit(c: str):
        return F.col(c).try_cast("double") if numeric else F.col(c)

    return footers.groupBy("name").agg(F.sum("count").alias("count"), F.sum("null_count").alias("null_count"), F.min(limit("min")).alias("min"), F.max(limit("max")).alias("max"))


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``, ``file``, ``block`` (its split's first byte), ``n`` (from 1) and ``at`` (bytes before it) of every line within its split; only LF ends a line.

    Lengths are those of the raw bytes, also of a line that is no valid UTF-8.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), (F.octet_length("value") + 1).cast("long").alias("size"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n, at = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block, size = batch.column("file"), batch.column("block"), batch.column("size").to_numpy()
            changed = pc.or_(*(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)) for c in (file, block))).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
            which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
            numbers = np.arange(batch.num_rows) - starts[which] + 1
            before = np.cumsum(size) - size
            offsets = before - before[starts][which]
            if (file[0].as_py(), block[0].as_py()) == place:
                numbers[which == 0] += n
                offsets[which == 0] += at
            place, n, at = (file[-1].as_py(), block[-1].as_py()), int(numbers[-1]), int(offsets[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([batch.column("value"), file, block, pa.array(numbers), pa.array(offsets)], ["value", "file", "block", "n", "at"])

    return lines.mapInArrow(number, "value string, file string, block long, n long, at long")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line`` (from 1), ``offset`` (of its first byte) and ``value`` of every line; only LF ends a line.

    Lines are counted by split first, a row a split; each split then numbers its own.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    counted = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    own = placed_lines(spark, path)
    return own.join(F.broadcast(starts), ["file", "block"]).select("file", (F.col("n") + F.col("lines_before")).alias("line"), (F.col("at") + F.col("bytes_before")).alias("offset"), "value")


def history_tail(spark: SparkSession, path: str, most: int = 16 << 20) -> DataFrame:
    """The whole lines in the last ``most`` bytes of a file, without a CR at their end."""
    numbered = numbered_lines(spark, path)
    size = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    return numbered.where(F.col("offset") >= size - most).select("line", F.regexp_replace("value", "\r$", "").alias("value"))


def file_heads(spark: SparkSession, path: str, size: int) -> DataFrame:
    """``file`` and ``head``, the first ``size`` bytes of each file as text; nothing else of it is read. Files of no bytes are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("file"))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for name in part["file"]:
                with open_input(name) as f:
                    found.append(f.read(size).decode("utf-8", "replace"))
            yield part.assign(head=found)

    return files.mapInPandas(read, "file string, head string")


def log_container(spark: SparkSession, path: str, head: int = 4096) -> str:
    """``jsonl`` if over half of the whole lines in a log's first bytes begin with a brace and a level is named, else ``plaintext``."""
    row = file_heads(spark, path, head).orderBy("file").first()
    text = row["head"] if row else ""
    lines = text.split("\n")[:-1]
    braced = sum(line.lstrip(" \t").startswith("{") for line in lines)
    return "jsonl" if 2 * braced > len(lines) and ('"level"' in text or '"severity"' in text) else "plaintext"


def grep(spark: SparkSession, path: str, pattern: str, ignore_case: bool = False, most: int = 200) -> DataFrame:
    """``file``, ``line``, ``value``: the first ``most`` lines of each file that match a regular expression."""
    hits = numbered_lines(spark, path).where(F.col("value").rlike(("(?i)" if ignore_case else "") + pattern))
    return hits.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("line"))).where(F.col("k") <= most).select("file", "line", "value")


def packets(source, window: int = 16 << 20) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(proto, src, dst, sport, dport, bytes) of TCP and UDP over IPv4 and Ethernet, with one VLAN tag at most.

    ``source`` is a capture's bytes or an open file, which is read by windows; a
    record that crosses windows is carried over.
    """
    import io

    file = io.BytesIO(source) if isinstance(source, (bytes, bytearray)) else source
    raw = file.read(24)
    if len(raw) < 24:
        raise ValueError("capture is shorter than its header")
    magic, link = struct.unpack_from("<I", raw, 0)[0], struct.unpack_from("<I", raw, 20)[0]
    if magic in (0xD4C3B2A1, 0x4D3CB2A1):
        raise ValueError("big-endian captures are not supported")
    if magic not in (0xA1B2C3D4, 0xA1B23C4D):
        raise ValueError("not a capture")
    if link != 1:
        raise ValueError(f"link type {link} is not Ethernet")
    rest = b""
    while piece := file.read(window):
        raw = rest + piece
        at = 0
        while at + 16 <= len(raw):
            (size,) = struct.unpack_from("<i", raw, at + 8)
            if size < 0:
                return
            if at + 16 + size > len(raw):
                break
            found = packet(raw, at + 16, size)
            at += 16 + size
            if found:
                yield found
        rest = raw[at:]


def packet(raw: bytes, frame: int, size: int) -> tuple[int, int, int, int, int, int] | None:
    """The packet in a frame of ``size`` bytes; None for other protocols and what is cut off."""
    head = 14
    if size < head:
        return None
    (kind,) = struct.unpack_from(">H", raw, frame + 12)
    if kind == 0x8100 and size >= 18:
        head = 18
        (kind,) = struct.unpack_from(">H", raw, frame + 16)
    if kind != 0x0800 or size < head + 20:
        return None
    ip = frame + head
    length = (raw[ip] & 15) * 4
    proto = raw[ip + 9]
    if raw[ip] >> 4 != 4 or length < 20 or proto not in (6, 17) or head + length + 4 > size:
        return None
    src, dst = struct.unpack_from(">II", raw, ip + 12)
    sport, dport = struct.unpack_from(">HH", raw, ip + length)
    return proto, src, dst, sport, dport, size


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per packet of all capture files; files are read in parallel, each by windows."""
    schema = "path string, proto int, src long, dst long, sport int, dport int, bytes long"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from itertools import batched

        for part in parts:
            for name in part["path"]:
                with open_input(name) as f:
                    for some in batched(packets(f), 100_000):
                        yield pd.DataFrame([(name, *p) for p in some], columns=["path", "proto", "src", "dst", "sport", "dport", "bytes"])

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, schema)
