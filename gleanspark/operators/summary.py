"""The result record that all analyzers share: one struct, written and read as a line of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The version, and the record's fields. Sections after ``samples`` are left out when they are null.
VERSION = 1
SCHEMA = """
schema_version long, analyzer string, analyzer_version long, success boolean,
source struct<path:string,bytes:long,format:string>,
totals struct<rows:long,scan_us:long>,
fields array<struct<name:string,kind:string,count:long,null_count:long,
  numeric:struct<min:double,max:double,mean:double,sum:double>,
  text:struct<unique:long,top:array<struct<value:string,count:long>>>,
  bool:struct<true_count:long,false_count:long>,
  timestamp:struct<min:string,max:string,unique:long>>>,
categories array<struct<name:string,count:long>>,
samples array<struct<byte_offset:long,line:long,timestamp:string,text:string>>,
anomalies array<struct<bucket:string,count:long,baseline:double,ratio:double,score:double>>,
correlations array<struct<stream_a:string,stream_b:string,lag_seconds:long,score:double,peak_bucket:string,events_a:long,events_b:long,width_seconds:long>>,
groups array<struct<key:string,count:long,aggs:array<struct<op:string,col:string,value:double>>>>,
group_by string, error string
"""
#: Sections of a summary are small by what they are; no more entries than this are put in one record.
MOST = 10_000


def record(spark: SparkSession, analyzer: str, rows: int, fields: DataFrame | None = None, categories: DataFrame | None = None, groups: DataFrame | None = None, group_by: str | None = None) -> DataFrame:
    """One row of ``SCHEMA`` from an analyzer's result tables, each of at most ``MOST`` rows.

    ``fields``: ``name count min max mean sum``; ``categories``: ``name count``;
    ``groups``: ``key count``.
    """

    def entries(table: DataFrame | None) -> list[dict]:
        if table is None:
            return []
        found = table.limit(MOST + 1).collect()
        if len(found) > MOST:
            raise ValueError(f"a summary holds {MOST} entries at most")
        return [r.asDict() for r in found]

    numbers = [{"name": r["name"], "kind": "number", "count": r["count"], "numeric": {k: r[k] for k in ("min", "max", "mean", "sum")}} for r in entries(fields)]
    row = {"schema_version": VERSION, "analyzer": analyzer, "analyzer_version": 1, "success": True, "totals": {"rows": rows, "scan_us": 0}, "fields": numbers, "categories": entries(categories), "samples": [], "group_by": group_by}
    if groups is not None:
        row["groups"] = [{"key": r["key"], "count": r["count"], "aggs": [{"op": k.partition("_")[0], "col": k.partition("_")[2], "value": None if v is None else float(v)} for k, v in r.items() if k not in ("key", "count")]} for r in entries(groups)]
    return spark.createDataFrame([row], SCHEMA)


def to_lines(summaries: DataFrame) -> DataFrame:
    """``value``: each record as one line of JSON, null sections left out."""
    return summaries.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def from_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Records from lines of JSON; raises on another version."""
    read = lines.select(F.from_json(line, SCHEMA).alias("r")).select("r.*")
    checked = F.when(F.col("schema_version") == VERSION, F.col("schema_version")).otherwise(F.raise_error(F.concat(F.lit("unsupported schema_version: "), F.coalesce(F.col("schema_version").cast("string"), F.lit("missing")))).cast("long"))
    return read.withColumn("schema_version", checked)


def analyzer_for(name: str, head: bytes) -> str | None:
    """Which analyzer a file goes to, by its extension, or by its first bytes if it has none or is a log."""
    import re

    base = re.split(r"[/\\]", name)[-1]
    stem, dot, extension = base.rpartition(".")
    known = {"csv": "profile", "jsonl": "json_profile", "ndjson": "json_profile", "json": "json_profile", "parquet": "parquet_statistics", "sql": "dumps", "pcap": "flows", "pcapng": "flows"}
    stamped = re.search(rb"\d{4}-\d\d-\d\d|\d\d/[A-Za-z]{3}/\d{4}", head[:8192])
    if dot and stem:
        extension = extension.lower()
        if extension in ("log", "txt"):
            return "time_series" if stamped else "severity"
        return known.get(extension)
    if head[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\xa1\xb2\x3c\x4d", b"\x0a\x0d\x0d\x0a"):
        return "flows"
    return "time_series" if stamped else "severity"
