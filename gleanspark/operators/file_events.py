"""Events of many log files of mixed grammars: each file's own grammar, its stamps, and which of them an error belongs to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timekey import GRAMMARS, decode
from ..session import stored
from ..sources.readers import file_heads
from .incident import streams_of, timeline
from .logs import BOUND

# What of a file tells its grammar, and how many stamps count at most.
HEAD_BYTES, MOST_HITS = 64 * 1024, 4096
ERROR_WORD = rf"(?i:(?:^|(?<={BOUND}))(?:error|critical|fatal)(?=$|{BOUND}))"
ERRORS = {g: ERROR_WORD for g in GRAMMARS} | {"clf": r'" 5\d\d ', "json-epoch": rf'{ERROR_WORD}|"level": ?(?:[5-9]\d(?!\d)|\d{{3,}})'}


def file_grammars(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``grammar``: the grammar with most stamps in each file's first 64 KB; the earlier of equals, ``iso8601`` without any.

    Only the heads are read. Files of no bytes are left out.
    """
    hits = [F.struct(F.least(F.size(F.regexp_extract_all("head", F.lit(p), F.lit(1))), F.lit(MOST_HITS)).alias("n"), F.lit(-k).alias("k"), F.lit(g).alias("grammar")) for k, (g, p) in enumerate(GRAMMARS.items())]
    return file_heads(spark, path, HEAD_BYTES).select("file", F.array_max(F.array(*hits))["grammar"].alias("grammar"))


def marks(line: Column, grammar: Column) -> Column:
    """The stamps of a line as they are, and an empty text for each error hit, in their order."""
    out = F.array().cast("array<string>")
    for g, stamp in GRAMMARS.items():
        out = F.when(grammar == g, F.regexp_extract_all(line, F.lit(f"{stamp}|{ERRORS[g]}"), F.lit(1))).otherwise(out)
    return out


FOUND = pa.schema([("file", pa.string()), ("block", pa.int64()), ("grammar", pa.string()), ("marks", pa.list_(pa.string())), ("hit", pa.bool_()), ("last", pa.bool_()), ("orphan", pa.bool_())])


def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stamped lines of each split in their order; ``hit``: an error that comes before the next stamp stands in a later line.

    ``last`` marks a split's last stamped line; an ``orphan`` row tells that an
    error stands before the first stamp of a split. One row is held at a time.
    """

    def rows(table: pa.RecordBatch, at: np.ndarray, hit: np.ndarray, last: np.ndarray, orphan: bool) -> pa.RecordBatch:
        own = table.take(pa.array(at))
        flags = [pa.array(hit, pa.bool_()), pa.array(last, pa.bool_()), pa.array(np.full(len(at), orphan), pa.bool_())]
        return pa.RecordBatch.from_arrays([*(own.column(c).cast(FOUND.field(c).type) for c in ("file", "block", "grammar", "marks")), *flags], schema=FOUND)

    held, held_hit = None, False
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        first = batch.slice(0, batch.num_rows - 1), batch.slice(1)
        changed = [pc.not_equal(first[1].column(c), first[0].column(c)).to_numpy(zero_copy_only=False) for c in ("file", "block")]
        split = np.concatenate([[0], np.cumsum(changed[0] | changed[1])])
        stamped, lead = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("stamped", "lead"))
        at = np.flatnonzero(stamped)
        # An error at a line's start belongs to the stamped line before it.
        target = np.cumsum(stamped) - stamped - 1
        known = target >= 0
        known[known] = split[at[target[known]]] == split[known]
        hit = np.zeros(len(at), dtype=bool)
        own_start = held is not None  # the held line's own start was looked at when it came
        leads = lead.copy()
        if own_start:
            leads[0] = False
            hit[0] = held_hit
        hit[target[leads & known]] = True
        lost = np.flatnonzero(leads & ~known)
        if len(lost):
            lost = lost[np.unique(split[lost], return_index=True)[1]]
            yield rows(batch, lost, np.zeros(len(lost), bool), np.zeros(len(lost), bool), True)
        last = np.append(split[at][1:] != split[at][:-1], True) if len(at) else np.zeros(0, bool)
        held, held_hit = None, False
        if len(at) and split[at[-1]] == split[-1]:
            held, held_hit = batch.slice(int(at[-1]), 1), bool(hit[-1])
            at, hit, last = at[:-1], hit[:-1], last[:-1]
        yield rows(batch, at, hit, last, False)
    if held is not None:
        yield rows(held, np.array([0]), np.array([held_hit]), np.array([True]), False)


def events_of_files(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``grammar``, ``epoch``, ``is_error`` of every stamp of the log files under ``path``, each by its file's own grammar.

    An error (a level word; a 5xx answer in access logs; a numeric level of 50 or
    more in JSON) belongs to the last stamp before it, so that a stack trace's
    line without a stamp counts for the line above it; one before a file's first
    stamp counts for none. A stamp is one event, however many errors belong to it;
    one that can not be decoded is none. Splits are read in parallel: each tells
    its last stamped line, and whether an error comes before its first; a row a
    split then carries errors over the borders. Empty files and files without
    stamps have no events.
    """
    grammars = file_grammars(spark, path)
    lines = spark.read.option("recursiveFileLookup", True).text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # A row a file, of its path and a word.
    told = lines.join(F.broadcast(grammars), "file").select("file", "block", "grammar", marks(F.col("value"), F.col("grammar")).alias("marks")).where(F.size("marks") > 0)
    marked = told.select("*", F.exists("marks", lambda x: x != "").alias("stamped"), (F.col("marks")[0] == "").alias("lead"))
    found = stored(marked.mapInArrow(attribute, "file string, block long, grammar string, marks array<string>, hit boolean, last boolean, orphan boolean"), "marks")

    ends = found.where("last OR orphan").groupBy("file", "block").agg(F.bool_or("last").alias("stamps"), F.bool_or("orphan").alias("orphan"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = ends.withColumn("to", F.last(F.when(F.col("stamps"), F.col("block")), ignorenulls=True).over(earlier)).where("orphan AND to IS NOT NULL").select("file", F.col("to").alias("block"), F.lit(True).alias("over")).distinct()
    lasts = found.where("last").join(over, ["file", "block"], "left").withColumn("hit", F.col("hit") | F.coalesce("over", F.lit(False))).drop("over")
    every = found.where("NOT last AND NOT orphan").unionByName(lasts)

    end = F.array_max(F.transform("marks", lambda x, i: F.when(x != "", i)))
    one = every.select("file", "grammar", "hit", end.alias("end"), "marks", F.posexplode("marks").alias("i", "stamp")).where("stamp <> ''")
    epoch = F.lit(None).cast("long")
    for g in GRAMMARS:
        epoch = F.when(F.col("grammar") == g, decode(F.col("stamp"), g)).otherwise(epoch)
    is_error = F.coalesce(F.get("marks", F.col("i") + 1) == "", F.lit(False)) | (F.col("hit") & (F.col("i") == F.col("end")))
    return one.select("file", "grammar", epoch.alias("epoch"), is_error.alias("is_error")).where("epoch IS NOT NULL")


def incident_of_files(spark: SparkSession, path: str) -> dict | None:
    """The incident that the log files under ``path`` tell of; see :func:`.incident.timeline`. Names are those of the files."""
    events = events_of_files(spark, path).withColumn("file", F.element_at(F.split("file", "/"), -1))
    streams, triggers = streams_of(stored(events, "events"))
    return timeline(streams, triggers)
