"""CSV files as tables of text cells: quotes, line feeds within them, blank lines and ragged rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import unquote
from .readers import placed_lines

#: Stands for a comma between cells, and what escapes it where a record has one of the two itself.
BETWEEN, ESCAPE = "\uffff", "\ufffe"


def cells(record: Column) -> Column:
    """The raw cells of a record; quotes toggle, and commas within them are no separators."""

    def cut(text: Column) -> Column:
        # Every second stretch between quotes is within them.
        marked = F.array_join(F.transform(F.split(text, '"', -1), lambda x, i: F.when(i % 2 == 0, F.translate(x, ",", BETWEEN)).otherwise(x)), '"')
        return F.split(marked, BETWEEN, -1)

    def swap(text: Column, *pairs: tuple[str, str]) -> Column:
        for old, new in pairs:
            text = F.replace(text, F.lit(old), F.lit(new))
        return text

    escaped = cut(swap(record, (ESCAPE, ESCAPE + "0"), (BETWEEN, ESCAPE + "1")))
    back = F.transform(escaped, lambda x: swap(x, (ESCAPE + "1", BETWEEN), (ESCAPE + "0", ESCAPE)))
    quoted = record.contains('"')
    return F.when(quoted & (record.contains(BETWEEN) | record.contains(ESCAPE)), back).when(quoted, cut(record)).otherwise(F.split(record, ",", -1))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``block``, ``at``, ``record``: the records of CSV files, in order of the three first columns.

    Line feeds within quotes belong to the record. Files are split as Spark
    splits texts: a first pass counts quotes, so that each split knows whether it
    starts within a quoted cell; a record that crosses splits is put together
    from its parts. The line feed at the end of a file ends the last record; a
    blank line is a record of one empty cell.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # A row a split, whatever the files' sizes.
    counted = lines.groupBy("file", "block").agg(F.sum(quotes).alias("q"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = {(r["file"], r["block"]): r["inside"] for r in counted.select("file", "block", (F.coalesce(F.sum("q").over(before), F.lit(0)) % 2 == 1).alias("inside")).collect()}
    if not any(inside.values()) and counted.where(F.col("q") % 2 == 1).isEmpty() and lines.where(quotes % 2 == 1).isEmpty():
        return placed_lines(spark, path).select("file", "block", F.col("n").alias("at"), F.col("value").alias("record"))
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("record", pa.string()), ("opens", pa.bool_()), ("closes", pa.bool_())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records; ``opens`` false if the first part is in the split before, ``closes`` false if the rest is in the next."""
        place, held, at, odd, opens = None, [], 0, False, True
        for batch in batches:
            out: list[tuple] = []
            for line, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != place:
                    if held:
                        out.append((*place, at, "\n".join(held), opens, False))
                    place, held, at = (file, block), [], 0
                    odd = inside[place]
                    opens = not odd
                held.append(line)
                odd ^= line.count('"') % 2 == 1
                if not odd:
                    out.append((file, block, at, "\n".join(held), opens, True))
                    held, at, opens = [], at + 1, True
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*place, at, "\n".join(held), opens, False), schema)], schema=schema)

    found = lines.mapInArrow(join, "file string, block long, at long, record string, opens boolean, closes boolean")
    whole = found.where("opens AND closes").select("file", "block", "at", "record")
    # Two parts a split at most, and those between.
    parts = found.where("NOT (opens AND closes)")
    order = Window.partitionBy("file").orderBy("block", "at")
    named = parts.withColumn("r", F.sum(F.col("opens").cast("int")).over(order))
    joined = named.groupBy("file", "r").agg(F.min(F.struct("block", "at")).alias("p"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "record"))), lambda x: x["record"]), "\n").alias("record"))
    return whole.unionByName(joined.select("file", "p.block", "p.at", "record"))


def header(record: str) -> list[str]:
    """Column names of a header record, trimmed and without quotes; repeated ones get a number."""
    names: list[str] = []
    cell, quoted = "", False
    for c in record + ",":
        if c == "," and not quoted:
            name = cell.strip()
            name = name[1:-1].replace('""', '"') if len(name) > 1 and name[0] == name[-1] == '"' else name
            names.append(name if name not in names else f"{name}_{len(names)}")
            cell = ""
        else:
            quoted ^= c == '"'
            cell += c
    return names


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The table of CSV files with equal headers: a text column per name, each cell trimmed and unquoted.

    A cell that a short row lacks is null, an empty one is an empty text; cells
    beyond the header are dropped. Every file's first record is its header. A
    blank line is a row of one empty cell.
    """
    found = records(spark, path)
    # The least (block, at) of each file is its header: a row a file.
    heads = found.groupBy("file").agg(F.min_by("record", F.struct("block", "at")).alias("h"), F.min(F.struct("block", "at")).alias("p"))
    one = heads.orderBy("file").first()
    if one is None:
        return spark.createDataFrame([], "value string")
    names = header(one["h"])
    rows = found.join(F.broadcast(heads.select("file", "p")), "file").where(F.struct("block", "at") != F.col("p"))
    split = rows.select(cells(F.col("record")).alias("c"))

    def cell(k: int) -> Column:
        raw = F.get("c", F.lit(k))
        return unquote(F.regexp_replace(raw, r"^\s+|\s+$", ""))

    return split.select(*(cell(k).alias(n) for k, n in enumerate(names)))
