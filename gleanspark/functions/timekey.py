"""Timestamps in text lines: six grammars, found at every offset and decoded to Unix seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grammars in order of preference, and the year of grammars that have none.
GRAMMARS = {
    "iso8601": r"(?=(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}))",
    "clf": r"(?=(\[\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}))",
    "apache-error": r"(?=(\[.{3} .{3} [ \d]\d \d{2}:\d{2}:\d{2}(?:\.\d+)? \d{4}))",
    "syslog": r"(?=((?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) [ \d]\d \d{2}:\d{2}:\d{2}))",
    "hdfs": r"(?=(\d{6} \d{6}))",
    "json-epoch": r'"(?:ts|time|timestamp|@timestamp)": ?(\d{1,19})(?!\d)',
}
SYSLOG_YEAR = 2024
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
NICE_WIDTHS = [1, 5, 10, 30, 60, 300, 600, 1800, 3600, 21600, 43200, 86400, 604800]


def month_number(name: Column) -> Column:
    """1 to 12 for an English abbreviation in either case; null for anything else."""
    at = F.call_function("instr", F.lit(MONTHS), F.lower(name))
    return F.when((F.length(name) == 3) & (at % 3 == 1), F.floor((at + 2) / 3).cast("int"))


def civil_seconds(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Unix seconds; null out of range. A day up to 31 is added to the month's first, whatever the month's length."""
    ok = month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 60)
    safe = F.when(ok, month)
    days = F.datediff(F.make_date(year, safe, F.when(ok, F.lit(1))), F.lit("1970-01-01").cast("date")) + day - 1
    return F.when(ok, days.cast("long") * 86400 + hour * 3600 + minute * 60 + second)


def decode(stamp: Column, grammar: str) -> Column:
    """Unix seconds of a stamp found by a grammar's pattern, or null."""

    def n(start: int, length: int) -> Column:
        return F.trim(F.substring(stamp, start, length)).try_cast("int")

    if grammar == "iso8601":
        return civil_seconds(n(1, 4), n(6, 2), n(9, 2), n(12, 2), n(15, 2), n(18, 2))
    if grammar == "clf":
        return civil_seconds(n(9, 4), month_number(F.substring(stamp, 5, 3)), n(2, 2), n(14, 2), n(17, 2), n(20, 2))
    if grammar == "apache-error":
        return civil_seconds(F.substring(stamp, -4, 4).try_cast("int"), month_number(F.substring(stamp, 6, 3)), n(10, 2), n(13, 2), n(16, 2), n(19, 2))
    if grammar == "syslog":
        return civil_seconds(F.lit(SYSLOG_YEAR), month_number(F.substring(stamp, 1, 3)), n(5, 2), n(8, 2), n(11, 2), n(14, 2))
    if grammar == "hdfs":
        return civil_seconds(n(1, 2) + 2000, n(3, 2), n(5, 2), n(8, 2), n(10, 2), n(12, 2))
    value, digits = stamp.try_cast("long"), F.length(stamp)

    def whole(unit: int) -> Column:
        return F.round((value - value % unit) / unit).cast("long")

    return F.when(digits <= 11, value).when(digits <= 14, whole(1000)).when(digits <= 17, whole(1_000_000)).otherwise(whole(1_000_000_000))


#: How many of a unit are a second (fixed value).
UNITS = {"seconds": 1, "millis": 1_000, "micros": 1_000_000, "nanos": 1_000_000_000}


def whole_seconds(raw: Column, unit: str) -> Column:
    """Whole seconds of a count of ``unit`` since 1970, rounded down, also before it."""
    n = raw.cast("long")
    # Whole division cuts towards zero, so one less where something was cut off below it.
    cut = F.call_function("div", n, F.lit(UNITS[unit]).cast("long"))
    return cut - F.when((n < 0) & (n % UNITS[unit] != 0), 1).otherwise(0)


def stamps(line: Column, grammar: str) -> Column:
    """All stamps of a line, overlapping ones too."""
    return F.regexp_extract_all(line, F.lit(GRAMMARS[grammar]), F.lit(1))


def line_epochs(lines: DataFrame, grammar: str, line: str = "value") -> DataFrame:
    """``lines`` with one row per decodable stamp and its Unix seconds as ``epoch``; lines without one are dropped."""
    found = lines.withColumn("_stamp", F.explode(stamps(F.col(line), grammar)))
    return found.withColumn("epoch", decode(F.col("_stamp"), grammar)).where("epoch IS NOT NULL").drop("_stamp")


def sniff_grammar(lines: DataFrame, line: str = "value", head: int = 2000) -> str | None:
    """The grammar with most stamps in the first lines; the earlier of equals; None if there is none."""
    row = lines.limit(head).agg(*(F.coalesce(F.sum(F.size(stamps(F.col(line), g))), F.lit(0)).alias(g) for g in GRAMMARS)).first()
    best = max(GRAMMARS, key=lambda g: row[g])
    return best if row[best] else None


def auto_width(span: int, target: int) -> int:
    """The first nice width of ``span // target`` seconds or more."""
    raw = span // target
    return next((w for w in NICE_WIDTHS if w >= raw), NICE_WIDTHS[-1])


def iso_label(epoch: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` in UTC, whatever the session's zone."""
    days = F.floor(epoch / 86400).cast("int")
    rest = F.pmod(epoch, F.lit(86400))
    return F.concat(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd"), F.lit("T"), *(x for k, (d, sep) in enumerate(((3600, ":"), (60, ":"), (1, ""))) for x in (F.lpad((F.floor(rest / d) % (60 if k else 24)).cast("string"), 2, "0"), F.lit(sep))))
