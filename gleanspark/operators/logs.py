"""Log severity: counts of level words, samples of the worst lines, and error events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Level words, and what bounds a word.
BOUND = r'[ \t\r\n\[\]":]'
LEVEL = rf"(?i)(?:^|(?<={BOUND}))(debug|info|warning|warn|error|critical|fatal)(?=$|{BOUND})"
LEVELS = ["DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
TRIGGER_SERVER_ERROR = r'" 5\d\d '
NUMERIC_LEVEL = r'"level": ?([5-9]\d(?!\d)|\d{3,})'


def levels(line: Column) -> Column:
    """Level of every level word of a line, in order."""
    return F.transform(F.regexp_extract_all(line, F.lit(LEVEL), F.lit(1)), lambda w: F.when(F.upper(w) == "WARNING", "WARN").when(F.upper(w) == "CRITICAL", "FATAL").otherwise(F.upper(w)))


WORDS = {"DEBUG": ["debug"], "INFO": ["info"], "WARN": ["warning", "warn"], "ERROR": ["error"], "FATAL": ["critical", "fatal"]}


def level_count(line: Column, level: str) -> Column:
    """How many words of a level a line has. Only lines that hold the letters are searched for a bounded word."""
    low = F.lower(line)
    held = low.contains(WORDS[level][-1]) if level != "FATAL" else low.contains("critical") | low.contains("fatal")
    pattern = rf"(?i)(?:^|(?<={BOUND}))(?:{'|'.join(WORDS[level])})(?=$|{BOUND})"
    return F.when(held, F.regexp_count(line, F.lit(pattern))).otherwise(0)


def severity(lines: DataFrame, line: str = "value") -> DataFrame:
    """``level``, ``count`` of words and ``percent`` of all lines, for each of the five levels."""
    # The five counts and the line count in one pass, without a row or an array per line.
    row = lines.agg(F.count(F.lit(1)).alias("lines"), *(F.coalesce(F.sum(level_count(F.col(line), v)), F.lit(0)).alias(v) for v in LEVELS))
    return row.select(F.explode(F.array(*(F.struct(F.lit(v).alias("level"), F.col(v).alias("count")) for v in LEVELS))).alias("s"), "lines").select("s.level", "s.count", F.coalesce(F.try_divide(F.col("s.count") * 100.0, F.col("lines")), F.lit(0.0)).alias("percent"))


def worst_lines(lines: DataFrame, order: str, line: str = "value", most: int = 5, width: int = 160) -> DataFrame:
    """The lines of the first ``most`` ERROR or FATAL words by ``order``, each line once, cut to ``width``."""
    hits = F.size(F.filter(levels(F.col(line)), lambda x: x.isin("ERROR", "FATAL")))
    first = lines.withColumn("_n", hits).where("_n > 0").orderBy(order).limit(most)
    from pyspark.sql import Window

    before = F.coalesce(F.sum("_n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.when(F.length(line) > width, F.concat(F.substring(line, 1, width), F.lit("…"))).otherwise(F.col(line))
    return first.withColumn("_b", before).where(F.col("_b") < most).select(order, cut.alias("text"))


def error_lines(lines: DataFrame, grammar: str, line: str = "value") -> DataFrame:
    """Lines that tell of an error, in the way of their grammar: level words, 5xx answers, numeric levels."""
    words = F.exists(levels(F.col(line)), lambda x: x.isin("ERROR", "FATAL"))
    if grammar == "clf":
        return lines.where(F.col(line).rlike(TRIGGER_SERVER_ERROR))
    if grammar == "json-epoch":
        return lines.where(words | F.col(line).rlike(NUMERIC_LEVEL))
    return lines.where(words)
